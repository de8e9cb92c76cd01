"""Vectorised hashing of UTF-8 text in Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit polynomials over a
table of random values per byte, taken from prefix sums modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
LONG, STEP = 4 << 20, 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_random = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
RAW = _random.copy()
LOWER = _random.copy()
LOWER[65:91] = LOWER[97:123]


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all bits."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off and len(column) else np.zeros(len(column) + 1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return bytes_, offsets


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes, a longer document alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def cuts(flag: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """A long text in runs of about ``STEP`` bytes that end before a byte that ``flag`` marks."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + STEP)
        while b < n and not flag[data[b]]:
            more = np.flatnonzero(flag[data[b : b + STEP]])
            b = b + int(more[0]) if len(more) else min(n, b + STEP)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and the number of words per document (offsets start at 0).

    A document above ``LONG`` bytes must come alone; it is hashed in runs, so that memory beyond its bytes
    and its words' hashes is bounded, but for a single word of that length.
    """
    if len(offsets) == 2 and len(data) > LONG:
        parts = [_words(data[a:b], np.array([0, b - a]), table)[0] for a, b in cuts(SPACE, data)]
        return np.concatenate(parts), np.array([sum(map(len, parts))])
    return _words(data, offsets, table)


def _words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    docs = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    space = SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = ~space
    start[1:] &= space[:-1] | first[1:n]
    starts = np.flatnonzero(start)
    end = np.ones(n + 1, bool)
    end[:n] = space | first[:n]
    end[1:] &= ~space
    end[0] = False
    ends = np.flatnonzero(end)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * powers(BASE, n), out=total[1:])
    value = (total[ends] - total[starts]) * powers(INVERSE, n)[starts]
    per = np.diff(np.searchsorted(starts, offsets))
    return mix(value ^ (ends - starts).astype(np.uint64)), per


def shingles(hashes: np.ndarray, per: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words and their number per document; fewer words give one shingle."""
    n = len(hashes)
    ends = np.cumsum(per)
    starts = ends - per
    q = powers(0xC2B2AE3D27D4EB4F, size + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(size, n)):
        rolled[: n - j] += hashes[j:] * q[j]
    valid = np.ones(n, bool)
    short = per < size
    tail = np.minimum(size - 1, per)
    cut = np.repeat(ends - tail, tail) + (np.arange(tail.sum()) - np.repeat(np.cumsum(tail) - tail, tail))
    valid[cut] = False
    few = np.flatnonzero(short & (per > 0))
    if len(few):
        some = np.repeat(starts[few], per[few])
        begin = np.cumsum(per[few]) - per[few]
        inside = np.arange(len(some)) - np.repeat(begin, per[few])
        valid[starts[few]] = True
        rolled[starts[few]] = np.add.reduceat(hashes[some + inside] * q[inside], begin) + q[size] * per[few].astype(np.uint64)
    count = np.where(short, np.minimum(per, 1), per - size + 1)
    return mix(rolled[valid]), count
