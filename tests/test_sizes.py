"""What keeps queries within their limits on large tables: plans without large broadcasts, rows that are not made."""

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pytest

from lacuna.functions.digest import Numbers
from lacuna.operators import correlate as K
from lacuna.operators import match as M
from lacuna.operators import pick as P
from lacuna.operators import places as N
from lacuna.operators import scan as S
from lacuna.operators import simulate as Q
from lacuna.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["data_event_circular", "data_event_gather", "ds_gap_fill_one_shot"])
def test_a_grid_is_not_broadcast(spark, name):
    assert "Broadcast" not in plan(catalogue.QUERIES[name](spark, DIR))


@pytest.mark.parametrize("name", ["ds_first_accept", "ds_scan_permutation", "ds_gap_fill_one_shot"])
def test_pairs_of_a_scan_are_not_shuffled(spark, name):
    above = plan(catalogue.QUERIES[name](spark, DIR)).split("MapInArrow")
    assert len(above) == 2 and "Window" not in above[0]


def test_digests_equal_md5():
    numbers = np.array([0, 7, -3, 10, 99999, 123456789012, -(10**17), 2**63 - 1])
    for prefix in (b"", b"1", b"13:5:", b"13:1234567:", b"13:-99999999999999:"):
        want = [hashlib.md5(prefix + str(v).encode()).hexdigest() for v in numbers]
        assert [f"{int(a):016x}{int(b):016x}" for a, b in zip(*Numbers(numbers).md5(prefix), strict=True)] == want


def test_scan_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, "ab"[int(i % 7 == 0)] if i else None, None if i % 11 == 0 else int(r.integers(0, 400))) for i in range(300)] + [(900, "alone", 1), (901, "null", None), (902, "null", None)]
    g = spark.createDataFrame(rows, "cell long, group string, value int")
    want, chosen = set(), {}
    for t, group, own in rows:
        others = [x for x in rows if x[1] == group and x[0] != t] if group is not None else []
        order = sorted(others, key=lambda x: (hashlib.md5(f"5:{t}:{x[0]}".encode()).hexdigest(), x[0]))
        want |= {(t, x[0], i) for i, x in enumerate(order)}
        if order:
            seen = [(None if own is None or x[2] is None else abs(x[2] - own), i, x[0]) for i, x in enumerate(order[: math.ceil(len(order) * 0.1)])]
            some = [x for x in seen if x[0] is not None]
            good = [x for x in some if x[0] <= 3]
            best = min(good, key=lambda x: x[1]) if good else min(some, default=(None, None, None))
            chosen[t] = (best[2], best[1], bool(good) if some else None)
    targets = g.withColumnRenamed("cell", "target")
    assert {tuple(x) for x in S.permutation(targets, g, 5).collect()} == want
    got = {x.target: (x.cell, x.scan, x.accepted) for x in S.first_within(targets, g, 5, 3, 0.1).collect()}
    assert got == chosen
    assert {a for _, _, a in chosen.values()} == {True, False, None}


def test_a_scan_is_written_in_few_bytes(spark, tmp_path):
    """A random order of 4000 takes 1.5 bytes a row; targets and scans, which repeat, take next to nothing."""
    g = spark.range(4000).selectExpr("id AS cell", "'a' AS group", "1 AS value")
    S.permutation(g.where("cell % 80 = 0").withColumnRenamed("cell", "target"), g, 5).write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 3 * 50 * 3999


def test_ties_meet_only_the_places_of_the_values_needed(spark):
    r = np.random.default_rng(4)
    rows = [(i, None if i % 50 == 3 else "ab"[i % 2], None if i % 40 == 0 else int(r.integers(0, 30))) for i in range(400)] + [(999, "alone", 5)]
    g = spark.createDataFrame(rows, "cell long, group string, value int")
    got = P.nearest_levels(g.where("cell % 50 = 0 or cell = 999").withColumnRenamed("cell", "target"), g, 4).collect()
    want = set()
    for t, group, own in rows:
        if group is None or not (t % 50 == 0 or t == 999):
            continue
        gap = {c: math.inf if own is None or v is None else abs(v - own) for c, other, v in rows if other == group and c != t}
        if gap:
            fourth = sorted(gap.values())[3]
            want |= {(t, c, None if d == math.inf else d) for c, d in gap.items() if d <= fourth}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_equal_patterns_of_categories_are_compared_once(spark):
    @dataclass(frozen=True)
    class FewPlaces(M.Similarity):
        """A measure that refuses repeated events and more than two equal places."""

        def __call__(self, event, place):
            for rows, most in ((event, 1), (place, 2)):
                if np.unique(rows, axis=0, return_counts=True)[1].max(initial=0) > most:
                    raise ValueError("equal patterns are compared again and again")
            return super().__call__(event, place)

    r = np.random.default_rng(5)
    rows = [(i, [None if x == 4 else float(x) for x in r.integers(0, 5, 3)]) for i in range(600)]
    p = spark.createDataFrame(rows, "cell long, p array<double>")
    events = p.where("cell % 5 = 0").selectExpr("cell as target", "p")
    layout = M.Layout.of([1, 2, 4], ["cat"])
    got = sorted(tuple(x) for x in M.best_matches(events, p, FewPlaces(layout), 2).collect())
    want = []
    for t, e in rows[::5]:
        scores = [(-sum(w for w, a, b in zip((1, 2, 4), e, q, strict=True) if a is not None and a == b), c) for c, q in rows if all(b is not None for a, b in zip(e, q, strict=True) if a is not None)]
        want += [(t, i + 1, c, float(-s)) for i, (s, c) in enumerate(sorted(scores)[:2])]
    assert got == want


def test_correlation_without_padding_is_right_inside():
    r = np.random.default_rng(6)
    image = r.integers(0, 9, (14, 11)).astype(float)
    image[4, 5] = np.nan
    offsets, weights = np.array([(-2, 0), (0, 1), (2, 2)]), np.array([1.0, 2.0, 3.0])
    events = r.integers(0, 9, (6, 3)).astype(float)
    events[1, 0], events[2] = np.nan, np.nan
    got = K.Correlator(image, offsets, weights, inner=True)(events)
    for e, out in zip(events, got, strict=True):
        for y in range(2, 12):
            for x in range(2, 9):
                there = [(w, v, image[y + dy, x + dx]) for (dy, dx), w, v in zip(offsets, weights, e, strict=True) if not np.isnan(v)]
                want = -sum(w * (v - c) ** 2 for w, v, c in there) if there else -np.inf
                assert np.isclose(out[y, x], -np.inf if np.isnan(want) else want)


LARGE = np.random.default_rng(7).integers(1, 51, (500, 80, 1)).astype(float)


def filled(images, grid, settings, sort_from, monkeypatch):
    monkeypatch.setattr(Q, "SORT_FROM", sort_from, raising=False)
    run = Q.METHODS["qs"](Q.Run(images, grid, settings, 3))
    return run.grid, run.source, run.random.random()


def test_a_large_image_is_not_compared_as_a_whole(monkeypatch):
    def refused(*_):
        raise AssertionError("every place of the image is compared")

    grid = np.where(np.random.default_rng(8).random((16, 16, 1)) < 0.2, np.nan, LARGE[100:116, 20:36])
    want = filled([LARGE], grid, Q.Settings(n=5, radius=3), 1 << 60, monkeypatch)
    monkeypatch.setattr(Q.Run, "mismatch", refused)
    got = filled([LARGE], grid, Q.Settings(n=5, radius=3), 1 << 15, monkeypatch)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


@pytest.mark.parametrize("settings", [Q.Settings(n=5, k=2.6, radius=3), Q.Settings(n=3, k=1.5, radius=2, kinds=("num", "cat"), circular=True), Q.Settings(n=4, kinds=("cat", "num"), full=True, power=1.3, kernel=np.random.default_rng(1).random((5, 5)))])
@pytest.mark.parametrize("share", [0.0, 0.05])
def test_sorted_places_give_what_all_places_give(settings, share, monkeypatch):
    r = np.random.default_rng(9)
    image = np.stack([r.normal(size=(90, 70)) if kind == "num" else r.integers(0, 6, (90, 70)) for kind in settings.kinds], axis=-1).astype(float)
    grid = np.where(r.random((12, 12, 1)) < 0.4, np.nan, image[20:32, 30:42])
    image[r.random((90, 70)) < share] = np.nan
    images = [np.vstack([image, image[::-1]]), image[:60].copy()]
    want, got = filled(images, grid, settings, 1 << 60, monkeypatch), filled(images, grid, settings, 0, monkeypatch)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


def test_some_random_numbers_of_many():
    for n, at in ((10_000, [0, 1, 77, 9_999]), (10_000, []), (5, [1, 4])):
        a, b = np.random.default_rng(4), np.random.default_rng(4)
        for r in (a, b):
            r.integers(9)  # leaves half a number
        assert (a.random(n)[at] == N.random_at(b, n, np.array(at, int))).all()
        assert a.bit_generator.state == b.bit_generator.state
