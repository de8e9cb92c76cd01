"""Column expressions on cell numbers: the first dimension runs fastest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793


def div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("long")


def coordinates(cell: Column, dims: Sequence[int]) -> list[Column]:
    """One coordinate for each dimension."""
    out, rest = [], cell
    for d in dims:
        out.append(F.pmod(rest, F.lit(d)).cast("long"))
        rest = div(rest, d)
    return out


def index(coordinate: Sequence[Column], dims: Sequence[int | Column]) -> Column:
    out, step = F.lit(0).cast("long"), F.lit(1).cast("long")
    for c, d in zip(coordinate, dims, strict=True):
        out = out + c * step
        step = step * (F.lit(d) if isinstance(d, int) else d)
    return out


def shifted(coordinate: Sequence[Column], offset: Sequence[Column], dims: Sequence[int | Column], axes: Sequence[int] | None = None) -> tuple[Column, Column]:
    """Cell at an offset with every axis wrapped, and whether no axis had to be. Offsets count on ``axes`` only."""
    moved = [c + (o if axes is None or i in axes else F.lit(0)) for i, (c, o) in enumerate(zip(coordinate, offset, strict=True))]
    wide = [F.lit(d) if isinstance(d, int) else d for d in dims]
    inside = F.lit(True)
    for m, d in zip(moved, wide, strict=True):
        inside = inside & (m >= 0) & (m < d)
    return index([F.pmod(m, d) for m, d in zip(moved, wide, strict=True)], dims), inside


def uniform(*parts: Column | str | int) -> Column:
    """Uniform number in [0, 1) that depends on the parts only: the first 32 bits of their MD5."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def seed_from_unit(u: Column) -> Column:
    """A seed below 2**32 from a number: null, NaN and what is not positive give 0, 1 and above the largest."""
    most = (1 << 32) - 1
    return F.when(u.isNull() | F.isnan(u) | (u <= 0), 0).when(u >= 1, most).otherwise(F.floor(u * float(most))).cast("long")


def pack(cell: Column, ti: Column, count: int) -> Column:
    """Provenance as one number: cell * number of training images + image."""
    return (cell * count + ti).cast("long")


def unpack(packed: Column, count: int) -> tuple[Column, Column]:
    return div(packed, count), F.pmod(packed, F.lit(count)).cast("long")


def half_away(x: Column) -> Column:
    """Nearest integer, halves away from zero; settled to 9 digits first, so that both engines agree."""
    return F.round(F.round(x, 9), 0).cast("long")


def rotated_2d(x: Column, y: Column, angle: Column, scale: Column | None = None) -> tuple[Column, Column]:
    """An offset scaled, turned by an angle in radians, and rounded."""
    s = valid_scale(scale) if scale is not None else F.lit(1.0)
    x, y = x * s, y * s
    return half_away(F.cos(angle) * x - F.sin(angle) * y), half_away(F.sin(angle) * x + F.cos(angle) * y)


def valid_scale(s: Column) -> Column:
    return F.when(s.isNotNull() & ~F.isnan(s) & (s > 0) & (s < float("inf")), s).otherwise(1.0)


def rotated_3d(v: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    """An offset turned by a quaternion (w, x, y, z); one that is nearly zero turns nothing."""
    w, a, b, c = q
    norm = w * w + a * a + b * b + c * c
    bad = norm.isNull() | F.isnan(norm) | (norm < 1e-12)
    w, a, b, c = (F.when(bad, keep).otherwise(p / F.sqrt(norm)) for p, keep in zip((w, a, b, c), (1.0, 0.0, 0.0, 0.0), strict=True))
    x, y, z = v
    return [
        half_away((1 - 2 * (b * b + c * c)) * x + 2 * (a * b - w * c) * y + 2 * (a * c + w * b) * z),
        half_away(2 * (a * b + w * c) * x + (1 - 2 * (a * a + c * c)) * y + 2 * (b * c - w * a) * z),
        half_away(2 * (a * c - w * b) * x + 2 * (b * c + w * a) * y + (1 - 2 * (a * a + b * b)) * z),
    ]


def tolerance_draw(centre: Column, tolerance: Column, u: Column, quantum: float) -> Column:
    """centre + (2u - 1) * tolerance in whole quanta."""
    return F.round(F.round((centre + (2 * u - 1) * tolerance) / quantum, 9), 0) * quantum + 0.0


def smooth(n: Column) -> Column:
    """Whether a size has the factors 2, 3, 5 and 7 only, but for one 11 or 13."""
    def without(rest: Column, p: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(12)), rest, lambda r, _: F.when(F.pmod(r, F.lit(p)) == 0, div(r, p)).otherwise(r))

    rest = n
    for p in (2, 3, 5, 7):
        rest = without(rest, p)
    return rest.isin(1, 11, 13)


def unix_ms(stamp: Column) -> Column:
    """Whole milliseconds since 1970 of a timestamp, with or without a time zone."""
    return F.unix_millis(stamp.cast("timestamp"))


def from_unix_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)
