import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.functions import cells as C
from lacuna.operators import distribute as D
from lacuna.operators import events as E
from lacuna.operators import grid as G
from lacuna.operators import match as M


def cells(spark, w, h, seed=1, holes=0.0):
    r = np.random.default_rng(seed)
    rows = [(y * w + x, x, y, None if r.random() < holes else int(r.integers(0, 9)), int(r.integers(0, 3))) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "cell long, x long, y long, v long, c long")


def test_pad_then_crop_is_identity(spark):
    g = cells(spark, 7, 5)
    back = G.crop(G.pad(g, 7, 5, 3, ["v"], -1), 13, 11, 3, ["v"])
    assert sorted((r.cell, r.x, r.y, r.v) for r in back.collect()) == sorted((r.cell, r.x, r.y, r.v) for r in g.collect())


def test_turning_four_times_and_scaling_by_one(spark):
    k = spark.createDataFrame([(x, y) for x in range(-4, 5) for y in range(-4, 5)], "x long, y long")
    a, b = F.col("x"), F.col("y")
    for _ in range(4):
        a, b = C.rotated_2d(a, b, F.lit(C.PI / 2))
    c, d = C.rotated_2d(F.col("x"), F.col("y"), F.lit(0.0), F.lit(1.0))
    e = C.rotated_3d([F.col("x"), F.col("y"), F.lit(2)], [F.lit(0.0)] * 4)
    for r in k.select("x", "y", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), *[v.alias(f"e{i}") for i, v in enumerate(e)]).collect():
        assert (r.a, r.b) == (r.c, r.d) == (r.e0, r.e1) == (r.x, r.y) and r.e2 == 2


def test_index_inverts_coordinates(spark):
    xs = C.coordinates(F.col("id"), [3, 5, 4])
    for r in spark.range(60).select("id", C.index(xs, [3, 5, 4]).alias("again"), *[x.alias(f"x{i}") for i, x in enumerate(xs)]).collect():
        assert r.id == r.again and r.x0 < 3 and r.x1 < 5 and r.x2 < 4


def test_seed_from_unit(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.0,), (0.5,), (1.0,), (7.0,)], "u double")
    assert [r[0] for r in df.select(C.seed_from_unit(F.col("u"))).collect()] == [0, 0, 0, 0, 2147483647, 4294967295, 4294967295]


@pytest.mark.parametrize("circular", [False, True])
def test_patterns_equal_numpy(spark, circular):
    g = cells(spark, 6, 5, holes=0.2)
    t = [(-1, 0, 1), (2, 1, 1), (0, -1, 1)]
    grid = {(r.x, r.y): r.v for r in g.collect()}
    got = {r.cell: r.p for r in G.patterns(g, t, ["v"], 6, 5, circular).collect()}
    for (x, y), _ in grid.items():
        at = [((x + dx) % 6, (y + dy) % 5) if circular else (x + dx, y + dy) for dx, dy, _ in t]
        assert got[y * 6 + x] == [None if (v := grid.get(p)) is None else float(v) for p in at]


def brute_best(events, places, score, k):
    out = []
    for t, e in events:
        s = sorted((-v if v is not None else 0, c, v) for c, p in places if (v := score(e, p)) is not None)
        out += [(t, i + 1, c, v) for i, (_, c, v) in enumerate(s[:k])]
    return sorted(out)


@limits(max_examples=10, deadline=None)
@given(st.integers(0, 1000), st.sampled_from([True, False]))
def test_similarity_equals_brute_force(spark, seed, compensate):
    r = np.random.default_rng(seed)
    value = lambda: None if r.random() < 0.25 else float(r.integers(0, 4))
    places = [(i, [value() for _ in range(4)]) for i in range(30)]
    events = [(i, [value() for _ in range(4)]) for i in range(5)]
    w, cat = (1.0, 1.0, 2.0, 2.0), (False, True, False, True)

    def score(e, p):
        total = support = 0.0
        for a, b, x, c in zip(e, p, w, cat):
            if a is None:
                continue
            if b is None:
                if not compensate:
                    return None
                continue
            total += (x * (a == b) - (x if compensate else 0)) if c else -x * (a - b) ** 2
            support += x
        if not compensate:
            return round(total, 9)
        return round(-abs(total / support**4), 9) if support else None

    schema = "cell long, p array<double>"
    got = M.best_matches(spark.createDataFrame(events, schema.replace("cell", "target")), spark.createDataFrame(places, schema), M.Similarity(M.Layout(w, cat), compensate), 3)
    assert [(*r[:3], r[3] + 0.0) for r in sorted(map(tuple, got.collect()))] == [(*x[:3], x[3] + 0.0) for x in brute_best(events, places, score, 3)]


def test_distance_rules_out_incomplete_places(spark):
    d = M.Distance(M.Layout((1.0, 3.0), (False, False)), 1, 1.0)
    got = d(np.array([[1.0, np.nan], [1.0, 2.0], [np.nan, np.nan]]), np.array([[2.0, np.nan], [3.0, 4.0]]))
    assert got.tolist() == [[1.0, 2.0], [np.inf, 2.0], [np.inf, np.inf]]


def test_blocks_of_events_give_the_same(spark, monkeypatch):
    g = cells(spark, 8, 8)
    p = G.patterns(g, [(-1, 0, 1), (1, 0, 1)], ["v"], 8, 8)
    e = p.select(F.col("cell").alias("target"), "p")
    m = M.Similarity(M.Layout((1.0, 1.0), (False, False)))
    one = sorted(map(tuple, M.best_matches(e, p, m, 2).collect()))
    monkeypatch.setattr(M, "BLOCK", 7)
    assert sorted(map(tuple, M.best_matches(e, p, m, 2).collect())) == one


def test_levels_allow_simulating_at_once(spark):
    g = E.random_path(cells(spark, 9, 9), 3)
    ring = [(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1)]
    found = E.gather(g.select("cell", "x", "y", "ord"), g.select("cell", "ord", "v"), ring, 9, 9)
    level = {r.cell: r.level for r in E.dependency_levels(found, g).collect()}
    for r in found.collect():
        assert level[r.cell] > level[r.to]
    assert sorted(r.ord for r in g.collect()) == list(range(81))


def test_halo_equals_padding(spark):
    g = cells(spark, 12, 8)
    b = g.select(C.div(F.col("x"), 4).alias("bx"), C.div(F.col("y"), 4).alias("by"), F.pmod("x", F.lit(4)).alias("x"), F.pmod("y", F.lit(4)).alias("y"), F.col("v").alias("value"))
    grid = {(r.x, r.y): r.v for r in g.collect()}
    got = {(r.bx, r.by, r.x, r.y): r.value for r in D.halo(b, 4, 4, 2).collect()}
    want = {(bx, by, x, y): grid[bx * 4 + x, by * 4 + y] for bx in range(3) for by in range(2) for x in range(-2, 6) for y in range(-2, 6) if not (0 <= x < 4 and 0 <= y < 4) and (bx * 4 + x, by * 4 + y) in grid}
    assert got == want


def test_faulty_job_grids_are_told(spark):
    g = spark.createDataFrame([("ok", "[[1,2],[3,4]]"), ("ragged", "[[1,2],[3]]"), ("twice", "[[1,2],[2,3]]")], "id string, grid string")
    assert sorted((r.id, r.ragged, r.repeated) for r in D.job_grid_faults(D.flatten_jobs(g)).collect()) == [("ragged", True, False), ("twice", False, True)]
