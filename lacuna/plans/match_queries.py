"""Queries on data events, matching, picking and gap filling, with their SQL.

Searches take as data events the cells whose number is divisible by 50, against all places.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import assess as A
from ..operators import correlate as K
from ..operators import events as E
from ..operators import grid as G
from ..operators import match as M
from ..operators import pick as P
from ..operators import scan as S
from ..sources.store import materialise
from . import tables as T

QUERIES: dict = {}
ORACLES: dict = {}

CROSS = [(-1, 0, 1), (1, 0, 1), (0, -1, 2), (0, 1, 2)]
CROSS_SQL = "t(rank, dx, dy, w) AS (VALUES (1, -1, 0, 1), (2, 1, 0, 1), (3, 0, -1, 2), (4, 0, 1, 2))"
RING = [*((dx, dy, 1) for dx, dy in ((0, -1), (-1, 0), (1, 0), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)))]
RING_SQL = "t(rank, dx, dy) AS (VALUES (1, 0, -1), (2, -1, 0), (3, 1, 0), (4, 0, 1), (5, -1, -1), (6, 1, -1), (7, -1, 1), (8, 1, 1))"


def in_query_set():
    return F.pmod(F.col("cell"), F.lit(50)) == 0



def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _search(grid, template, values, kinds, measure, k, largest=True, width=T.PART_WIDTH, circular=False):
    p = materialise(G.patterns(grid, template, values, width, T.height(grid), circular))
    events = p.where(in_query_set()).select(F.col("cell").alias("target"), "p")
    return M.best_matches(events, p, measure, k, largest)


def _pairs(grid_sql: str, values: str, width: int, inside: bool = True) -> str:
    """SQL for (target, cell, rank, w, event value e*, place value c*): every event's offset at every place."""
    v = values.split(",")
    e = ", ".join(f"{x.strip()} AS e{i}" for i, x in enumerate(v))
    return f"""WITH {grid_sql}, {CROSS_SQL},
n AS (SELECT g.cell, t.rank, t.w, m.cell AS at FROM g CROSS JOIN t JOIN g m ON m.x = g.x + t.dx AND m.y = g.y + t.dy),
ev AS (SELECT n.cell AS target, rank, w, {e} FROM n JOIN g ON g.cell = n.at WHERE n.cell % 50 = 0),
pl AS (SELECT n.cell, rank, {e.replace(" AS e", " AS c")} FROM n JOIN g ON g.cell = n.at)"""


def _top(score: str, where: str = "", k: int = 3, largest: bool = True) -> str:
    order = "DESC" if largest else "ASC"
    return f"""SELECT target, CAST(rank AS INTEGER) AS rank, cell, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score {order}, cell) AS rank FROM (
{score})) WHERE rank <= {k} {where}"""


_COMPLETE = "(SELECT target, count(*) AS n FROM ev GROUP BY target) q"
_SUM = f"SELECT ev.target, pl.cell, round({{0}}, 9) AS score FROM ev JOIN pl USING (rank) JOIN {_COMPLETE} ON q.target = ev.target GROUP BY ev.target, pl.cell, q.n HAVING count(*) = q.n"


#: All offsets up to three cells away, weighted by nearness.
WIDE = [(dx, dy, 7 - abs(dx) - abs(dy)) for dy in range(-3, 4) for dx in range(-3, 4) if dx or dy]
WIDE_SQL = f"t(rank, dx, dy, w) AS (VALUES {', '.join(str((i + 1, *o)) for i, o in enumerate(WIDE))})"


@query(_pairs(T.PART, "p_size", 40).replace(CROSS_SQL, WIDE_SQL) + _top(_SUM.format("CAST(-sum(w * (c0 - e0) * (c0 - e0)) AS DOUBLE)")))
def qs_score_fft(spark, d):
    """As pattern_topk with a template of 48 offsets, scored by cross-correlation of tiles in the frequency domain."""
    g = T.part(spark, d)
    events = G.patterns(g, WIDE, ["p_size"], T.PART_WIDTH, T.height(g)).where(in_query_set()).select(F.col("cell").alias("target"), "p")
    return K.correlated(events, g, WIDE, "p_size", 3)


@query(_pairs(T.PART, "p_size", 40) + _top(_SUM.format("CAST(-sum(w * (c0 - e0) * (c0 - e0)) AS DOUBLE)")))
def pattern_topk(spark, d):
    """The three places of the part grid most like each event, by weighted squared differences of size."""
    return _search(T.part(spark, d), CROSS, ["p_size"], ["num"], M.Similarity(M.Layout.of([o[2] for o in CROSS], ["num"])), 3)


def _status(g):
    return g.withColumn("s", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)).withColumn("q", F.substring("o_orderpriority", 1, 1).cast("int"))


_ORDERS = T.ORDERS.replace("o_orderstatus, o_orderpriority, o_totalprice FROM", "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS s, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS q, o_totalprice FROM")


@query(_pairs(_ORDERS, "s, q", 120) + _top(_SUM.format("CAST(sum(CASE WHEN c0 = e0 THEN w ELSE 0 END + CASE WHEN c1 = e1 THEN w ELSE 0 END) AS DOUBLE)")))
def qs_score_categorical(spark, d):
    """As pattern_topk, for the order grid's status and priority: the weights of equal categories."""
    kinds = ["cat", "cat"]
    return _search(_status(T.orders(spark, d)), CROSS, ["s", "q"], kinds, M.Similarity(M.Layout.of([o[2] for o in CROSS], kinds)), 3, width=T.ORDER_WIDTH)


_BRAND = T.PART.replace("p_brand, p_type FROM", "CAST(substr(p_brand, 7) AS INTEGER) AS b FROM")


def _brand(g):
    return g.withColumn("b", F.substring("p_brand", 7, 9).cast("int"))


@query(_pairs(_BRAND, "p_size, b", 40) + _top(_SUM.format("CAST(sum(CASE WHEN c1 = e1 THEN w ELSE 0 END - w * (c0 - e0) * (c0 - e0)) AS DOUBLE)")))
def qs_score_mixed(spark, d):
    """Size as a number and brand as a category together."""
    kinds = ["num", "cat"]
    return _search(_brand(T.part(spark, d)), CROSS, ["p_size", "b"], kinds, M.Similarity(M.Layout.of([o[2] for o in CROSS], kinds)), 3)


@query(
    f"""WITH {T.EVENTS}, {CROSS_SQL}, c AS (SELECT cell, x, y, n FROM g WHERE event_type = 'click'),
f AS (SELECT i AS cell, i % 24 AS x, i // 24 AS y FROM (SELECT unnest(range(720)) AS i)),
n AS (SELECT f.cell, t.rank, t.w, c.n FROM f CROSS JOIN t JOIN c ON c.x = f.x + t.dx AND c.y = f.y + t.dy),
s AS (SELECT a.cell AS target, b.cell, -abs(sum(a.w * (a.n - b.n) * (a.n - b.n)) / pow(sum(a.w), 4)) AS score FROM n a JOIN n b USING (rank) WHERE a.cell % 50 = 0 GROUP BY 1, 2)
"""
    + _top("SELECT target, cell, round(score, 9) + 0.0 AS score FROM s")
)
def qs_score_missing(spark, d):
    """With holes in image and events: penalties compensated by the support to the fourth power."""
    g = T.events(spark, d).where("event_type = 'click'")
    whole = G.frame(spark, T.HOURS, T.DAYS).join(g.select("cell", "n"), "cell", "left")
    p = materialise(G.patterns(whole, CROSS, ["n"], T.HOURS, T.DAYS))
    best = M.best_matches(p.where(in_query_set()).select(F.col("cell").alias("target"), "p"), p, M.Similarity(M.Layout.of([o[2] for o in CROSS], ["num"]), compensate=True), 3)
    return best.withColumn("score", F.col("score") + 0.0)


def _distance(name: str, power: float, sql: str, values, kinds, grid=T.part, prepare=lambda g: g, grid_sql=T.PART):
    def run(spark, d):
        layout = M.Layout.of([o[2] for o in CROSS], kinds)
        return _search(prepare(grid(spark, d)), CROSS, values, kinds, M.Distance(layout, len(kinds), power), 3, largest=False)

    run.__name__ = name
    run.__doc__ = f"The three places at the smallest distance: {', '.join(values)} with power {power:g}."
    query(_pairs(grid_sql, ", ".join(values), 40) + _top(_SUM.format(sql), largest=False))(run)


_distance("ds_distance_l1", 1.0, "CAST(sum(w * abs(c0 - e0)) AS DOUBLE) / sum(w)", ["p_size"], ["num"])
_distance("ds_distance_l2", 2.0, "sqrt(CAST(sum(w * (c0 - e0) * (c0 - e0)) AS DOUBLE) / sum(w))", ["p_size"], ["num"])
_distance("ds_distance_categorical", 2.0, "CAST(sum(CASE WHEN c0 <> e0 THEN w ELSE 0 END) AS DOUBLE) / sum(w)", ["b"], ["cat"], prepare=_brand, grid_sql=_BRAND)
_distance("ds_distance_mixed", 2.0, "(sqrt(CAST(sum(w * (c0 - e0) * (c0 - e0)) AS DOUBLE) / sum(w)) + CAST(sum(CASE WHEN c1 <> e1 THEN w ELSE 0 END) AS DOUBLE) / sum(w)) / 2", ["p_size", "b"], ["num", "cat"], prepare=_brand, grid_sql=_BRAND)


# --- data events ---------------------------------------------------------------------------------

_PATH = f"o AS (SELECT cell, CASE WHEN {T.unit('3', 'cell')} < 0.2 THEN -1 ELSE CAST(floor({T.unit('4', 'cell')} * 4294967296) AS BIGINT) END AS ord FROM g)"


def _posterior(g):
    """A fifth of the cells is hard data (order -1), the others come in hashed order."""
    u = C.uniform(3, F.col("cell"))
    return g.withColumn("ord", F.when(u < 0.2, E.HARD).otherwise(F.floor(C.uniform(4, F.col("cell")) * 4294967296.0).cast("long")))


_GATHER = f"""WITH {T.PART}, {RING_SQL}, {_PATH},
f AS (SELECT g.cell, t.rank, m.cell AS "to", m.p_size AS v, p.ord FROM g JOIN o USING (cell) CROSS JOIN t JOIN g m ON m.x = g.x + t.dx AND m.y = g.y + t.dy JOIN o p ON p.cell = m.cell WHERE o.ord >= 0 AND p.ord < o.ord)
"""


def _found(spark, d, circular=False):
    g = _posterior(T.part(spark, d))
    return E.gather(g.where("ord >= 0").select("cell", "x", "y", "ord"), g.select("cell", "ord", F.col("p_size").alias("v")), RING, T.PART_WIDTH, T.height(g), circular)


@query(_GATHER + 'SELECT cell, rank, "to", v, ord FROM f')
def data_event_gather(spark, d):
    """The informed neighbours of every cell of the path."""
    return _found(spark, d).select("cell", "rank", "to", "v", "ord")


@query(_GATHER + 'SELECT cell, rank, v, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cell ORDER BY rank) AS INTEGER) AS nth FROM f) WHERE nth <= 3')
def data_event_n_nearest(spark, d):
    return E.nearest(_found(spark, d), 3).select("cell", "rank", "v", "nth")


@query(
    f"""WITH {T.PART}, {RING_SQL}, {_PATH}
SELECT g.cell, t.rank, m.cell AS "to", m.p_size AS v FROM g JOIN o USING (cell) CROSS JOIN t CROSS JOIN dim JOIN g m ON m.x = (g.x + t.dx + 40) % 40 AND m.y = (g.y + t.dy + h) % h JOIN o p ON p.cell = m.cell WHERE o.ord >= 0 AND p.ord < o.ord"""
)
def data_event_circular(spark, d):
    return _found(spark, d, circular=True).select("cell", "rank", "to", "v")


@query(_GATHER + "SELECT cell, rank, v, nth, n FROM (SELECT f.*, CAST(row_number() OVER (PARTITION BY cell ORDER BY rank) AS INTEGER) AS nth, CAST(1 + cell % 4 AS INTEGER) AS n FROM f) WHERE nth <= n")
def control_map_neighbours(spark, d):
    """The number of neighbours from a map by cell, joined to the events."""
    found = _found(spark, d)
    control = T.part(spark, d).select("cell", (1 + F.pmod(F.col("cell"), F.lit(4))).cast("int").alias("n"))
    return E.nearest(found.join(control, "cell"), F.col("n")).select("cell", "rank", "v", "nth", "n")


@query(
    _GATHER
    + f""", k AS (SELECT 1 AS kernel, rank, dx, dy FROM t UNION ALL SELECT 2, 9 - rank, dx, dy FROM t),
h AS (SELECT f.cell, k.kernel, k.rank AS place FROM f JOIN t USING (rank) JOIN k ON k.dx = t.dx AND k.dy = t.dy),
r AS (SELECT *, row_number() OVER (PARTITION BY cell, kernel ORDER BY place) AS nth FROM h),
p AS (SELECT cell, kernel, count(*) AS n_found, min(place) FILTER (nth = 2) AS reach FROM r GROUP BY cell, kernel)
SELECT cell, kernel, CAST(coalesce(reach, 0) AS INTEGER) AS reach, n_found FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY reach NULLS LAST, n_found DESC, {T.unit('8', 'cell', 'kernel')}, kernel) AS b FROM p) WHERE b = 1"""
)
def kernel_autoselect(spark, d):
    """Of two kernels the one that finds two neighbours sooner, for every cell."""
    rows = [(k, i + 1 if k == 1 else 8 - i, dx, dy) for k in (1, 2) for i, (dx, dy, _) in enumerate(RING)]
    kernels = spark.createDataFrame(rows, "kernel int, rank int, dx long, dy long")
    return E.choose_kernel(_found(spark, d), kernels, 2, 8).select("cell", "kernel", F.coalesce("reach", F.lit(0)).alias("reach"), "n_found")


@query(f"WITH {T.PART} SELECT cell, row_number() OVER (ORDER BY md5(concat_ws(':', '11', cell)), cell) - 1 AS ord FROM g")
def random_path(spark, d):
    return E.random_path(T.part(spark, d).select("cell"), 11).select("cell", "ord")


@query(_GATHER + "SELECT o.cell, coalesce(max(f.ord), -1) AS dependency, CAST(count(f.ord) FILTER (f.ord >= 0) AS BIGINT) AS n FROM o LEFT JOIN f ON f.cell = o.cell WHERE o.ord >= 0 GROUP BY o.cell")
def path_dependency(spark, d):
    """The latest order on which every cell of the path depends."""
    g = _posterior(T.part(spark, d)).where("ord >= 0").select("cell")
    f = _found(spark, d).groupBy("cell").agg(F.max("ord").alias("dependency"), F.count(F.when(F.col("ord") >= 0, 1)).alias("n"))
    return g.join(f, "cell", "left").select("cell", F.coalesce("dependency", F.lit(-1)).cast("long").alias("dependency"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    _GATHER.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, d AS (SELECT DISTINCT f.cell, f."to" AS at FROM f WHERE f.ord >= 0),
l(cell, level) AS (SELECT cell, 0 FROM o WHERE ord >= 0 UNION SELECT d.cell, l.level + 1 FROM l JOIN d ON d.at = l.cell)
SELECT cell, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY cell"""
)
def path_levels(spark, d):
    """Which cells can be simulated at once: levels of the dependency graph."""
    g = _posterior(T.part(spark, d))
    return E.dependency_levels(_found(spark, d), g.where("ord >= 0"))


# --- encodings -----------------------------------------------------------------------------------


@query(f"WITH {T.ORDERS} SELECT cell, " + ", ".join(f"CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END AS s{i}" for i, s in enumerate("FOP")) + " FROM g")
def onehot_category(spark, d):
    return G.one_hot(T.orders(spark, d), "o_orderstatus", list("FOP"), "s").select("cell", "s0", "s1", "s2")


@query(f"WITH {T.EVENTS} SELECT f.i AS cell, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS valid, coalesce(n, 0) AS value, coalesce(n * n, 0) AS square FROM (SELECT unnest(range(720)) AS i) f LEFT JOIN g ON g.cell = f.i AND event_type = 'click'")
def moment_layers(spark, d):
    g = T.events(spark, d).where("event_type = 'click'")
    return G.moments(G.frame(spark, T.HOURS, T.DAYS).join(g.select("cell", "n"), "cell", "left"), "n")


@query("SELECT o_orderpriority AS category, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 9) AS share FROM orders GROUP BY 1")
def category_marginals(spark, d):
    c = T.orders(spark, d).groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 9))


@query("SELECT 'part' AS image, p_brand AS category, count(*) AS n, min(p_partkey) AS first_cell FROM part GROUP BY 2 UNION ALL SELECT 'orders', o_orderstatus, count(*), min(o_orderkey) FROM orders GROUP BY 2")
def category_values(spark, d):
    """The categories of each image with their number and where each is seen first."""
    a = T.part(spark, d).select(F.lit("part").alias("image"), F.col("p_brand").alias("category"), "cell")
    b = T.orders(spark, d).select(F.lit("orders").alias("image"), F.col("o_orderstatus").alias("category"), "cell")
    return a.unionByName(b).groupBy("image", "category").agg(F.count("*").alias("n"), F.min("cell").alias("first_cell"))


# --- aligned stacks ------------------------------------------------------------------------------
# The data event at a cell is what image 0 holds around it; every other image is matched at the same cell.

_STACK = f"""WITH {T.STACK}, {CROSS_SQL},
n AS (SELECT a.cell, t.rank, t.w, m.ti, m.v FROM (SELECT DISTINCT cell, x, y FROM g) a CROSS JOIN t JOIN g m ON m.x = a.x + t.dx AND m.y = a.y + t.dy),
e AS (SELECT cell, rank, v FROM n WHERE ti = 0)
"""


def _stack_targets(g):
    return g.where("ti = 0").select("cell", "x", "y", F.lit(0).cast("long").alias("ref"))


@query(_STACK + "SELECT n.cell, n.ti, round(-CAST(sum(n.w * abs(n.v - e.v)) AS DOUBLE), 6) AS score FROM n JOIN e USING (cell, rank) WHERE n.ti <> 0 GROUP BY ALL")
def as_score_complete(spark, d):
    g = T.stack(spark, d)
    return A.anchored(g, _stack_targets(g), CROSS, 8, 8)


def _with_holes(g):
    return g.withColumn("v", F.when((F.col("ti") == 0) | (F.pmod(F.col("ti") + F.col("cell"), F.lit(3)) != 0), F.col("v")))


@query(_STACK.replace(" AS v FROM (SELECT vec_id", " AS v0 FROM (SELECT vec_id").replace("m.ti, m.v FROM", "m.ti, CASE WHEN m.ti = 0 OR (m.ti + m.cell) % 3 <> 0 THEN m.v0 END AS v FROM") + "SELECT n.cell, n.ti, round(-abs(CAST(sum(n.w * abs(n.v - e.v)) AS DOUBLE) / pow(sum(n.w), 4.0)), 6) + 0.0 AS score FROM n JOIN e USING (cell, rank) WHERE n.ti <> 0 AND n.v IS NOT NULL AND e.v IS NOT NULL GROUP BY ALL")
def as_score_incomplete(spark, d):
    g = _with_holes(T.stack(spark, d))
    return A.anchored(g, _stack_targets(g), CROSS, 8, 8, compensate=True).withColumn("score", F.col("score") + 0.0)


_MASK = f"m AS (SELECT ti, CASE WHEN ti % 7 = 0 THEN 0.0 WHEN ti % 11 = 0 THEN NULL ELSE {T.unit('6', 'ti')} END AS weight FROM (SELECT DISTINCT ti FROM g))"
_AS_TOP = _STACK.rstrip() + f", {_MASK}, s AS (SELECT n.cell, n.ti, round(-CAST(sum(n.w * abs(n.v - e.v)) AS DOUBLE), 6) AS score FROM n JOIN e USING (cell, rank) WHERE n.ti <> 0 GROUP BY ALL), r AS (SELECT s.*, m.weight, CAST(row_number() OVER (PARTITION BY cell ORDER BY score DESC, s.ti) AS INTEGER) AS rank FROM s JOIN m USING (ti) WHERE weight > 0)\n"


def _masked(spark, d):
    g = T.stack(spark, d)
    ti = F.col("ti")
    mask = g.select("ti").distinct().withColumn("weight", F.when(F.pmod(ti, F.lit(7)) == 0, 0.0).when(F.pmod(ti, F.lit(11)) == 0, None).otherwise(C.uniform(6, ti)))
    s = A.admissible(A.anchored(g, _stack_targets(g), CROSS, 8, 8), mask)
    return P.top_k(s.select(F.col("cell").alias("target"), F.col("ti").alias("cell"), "score", "weight"), 5).select(F.col("target").alias("cell"), F.col("cell").alias("ti"), "score", "weight", "rank")


@query(_AS_TOP + "SELECT cell, ti, score, weight, rank FROM r WHERE rank <= 5")
def as_topk_masked(spark, d):
    """The five best images per cell among those of positive weight."""
    return _masked(spark, d)


@query(
    _AS_TOP
    + f""", k AS (SELECT *, sum(weight) OVER (PARTITION BY cell ORDER BY rank) AS c, sum(weight) OVER (PARTITION BY cell) AS t FROM r WHERE rank <= 5)
SELECT cell, ti, rank FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rank) AS f FROM k WHERE c >= {T.unit('7', 'cell')} * t) WHERE f = 1"""
)
def as_gap_fill(spark, d):
    """One image per cell, drawn among the five best by mask weight."""
    return P.by_weight(_masked(spark, d), C.uniform(7, F.col("cell")), "weight", "cell").select("cell", "ti", "rank")


# --- picking -------------------------------------------------------------------------------------
# Scores to pick from: how near each part is in size to the parts of the query set of the same brand.

_SCORED = f"WITH {T.PART}, s AS (SELECT a.cell AS target, b.cell, abs(a.p_size - b.p_size) AS score FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.cell <> b.cell WHERE a.cell % 50 = 0)\n"


def _grouped(spark, d):
    """Parts of the query set and all parts, grouped by brand, with their sizes."""
    g = T.part(spark, d).select("cell", F.col("p_brand").alias("group"), F.col("p_size").alias("value"))
    return g.where(in_query_set()).withColumnRenamed("cell", "target"), g


def _near(spark, d, k: int, largest: bool = False):
    """The k nearest in size of each target's brand by score, then cell, without the pairs in between.

    Of the parts of one brand and size only the first k + 1 can be among the k best of anyone, so each target meets
    them alone: as many rows as there are sizes, however many parts.
    """
    g = T.part(spark, d)
    first = g.withColumn("nth", F.row_number().over(W.partitionBy("p_brand", "p_size").orderBy("cell"))).where(F.col("nth") <= k + 1).select("cell", "p_size", "p_brand")
    a = g.where(in_query_set()).select(F.col("cell").alias("target"), F.col("p_size").alias("own"), "p_brand")
    s = a.join(first, "p_brand").where("target <> cell").select("target", "cell", F.abs(F.col("own") - F.col("p_size")).alias("score"))
    return P.top_k(s, k, largest=largest)


def _others(spark, d):
    """(target, n): how many other parts have the brand of each part of the query set; counted, not paired."""
    g = T.part(spark, d)
    n = g.groupBy("p_brand").agg((F.count("*") - 1).alias("n"))
    return g.where(in_query_set()).select(F.col("cell").alias("target"), "x", "y", "p_brand").join(n, "p_brand")


def _ranked(order: str, k: int = 4) -> str:
    return _SCORED + f"SELECT target, cell, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY {order}) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"


@query(_ranked("score DESC, cell"))
def topk_biggest(spark, d):
    return _near(spark, d, 4, largest=True)


@query(_ranked("score, cell"))
def topk_smallest(spark, d):
    return _near(spark, d, 4)


@query(_ranked(f"score, {T.unit('2', 'target', 'cell')}, cell"))
def topk_random_ties(spark, d):
    return P.top_k(P.nearest_levels(*_grouped(spark, d), 4), 4, largest=False, ties=C.uniform(2, F.col("target"), F.col("cell")))


@query(f"SELECT target, cell, rank FROM ({_ranked('score, cell', 2)}) WHERE rank = CAST(floor({T.unit('12', 'target')} * 1.2) AS INTEGER) + 1")
def pick_fractional_k(spark, d):
    """k = 1.2: rank 1 with probability 1 / 1.2, else rank 2."""
    return P.fractional_k(_near(spark, d, 2), 1.2, C.uniform(12, F.col("target"))).select("target", "cell", "rank")


_SCAN = _SCORED.rstrip() + f", c AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(concat_ws(':', '13', target, cell)), cell) - 1 AS scan, count(*) OVER (PARTITION BY target) AS n FROM s)\n"


@query(_SCAN + "SELECT target, cell, scan FROM c")
def ds_scan_permutation(spark, d):
    """The pseudo-random order in which each target's places are scanned."""
    return S.permutation(*_grouped(spark, d), 13)


@query(_SCAN + "SELECT target, least(n, greatest(1, CAST(ceil(n * 0.3) AS BIGINT))) AS scanned FROM c GROUP BY target, n")
def ds_exploration_bound(spark, d):
    return _others(spark, d).where("n > 0").select("target", P.scan_limit(F.col("n"), 0.3).alias("scanned"))


@query(
    _SCAN
    + """, k AS (SELECT * FROM c WHERE scan < least(n, greatest(1, CAST(ceil(n * 0.3) AS BIGINT))))
SELECT target, coalesce(arg_min(cell, scan) FILTER (score <= 1), arg_min(cell, score * 1000000 + scan)) AS cell,
coalesce(min(scan) FILTER (score <= 1), arg_min(scan, score * 1000000 + scan)) AS scan, bool_or(score <= 1) AS accepted FROM k GROUP BY target"""
)
def ds_first_accept(spark, d):
    """The first place within a difference of 1 among the first 30 % scanned, else the best of them."""
    return S.first_within(*_grouped(spark, d), 13, 1, 0.3)


@query(
    f"""WITH {T.EVENTS}, v AS (SELECT cell, n, row_number() OVER (ORDER BY cell) - 1 AS nth FROM g WHERE event_type = 'click'),
h AS (SELECT i AS cell FROM (SELECT unnest(range(720)) AS i) WHERE i NOT IN (SELECT cell FROM v)),
k AS (SELECT count(*) AS k FROM v)
SELECT h.cell, v.cell AS source, v.n FROM h, k JOIN v ON v.nth = CAST(floor({T.unit('14', 'h.cell')} * k.k) AS BIGINT)"""
)
def marginal_draw(spark, d):
    """Hours without clicks take the number of an hour drawn from all with clicks."""
    g = T.events(spark, d).where("event_type = 'click'")
    return P.marginal_draw(G.holes(g, T.HOURS, T.DAYS, "n"), g, "n", 14).select("cell", "source", "n")


@query(
    f"""WITH {T.PART}, c AS (SELECT p_brand AS target, p_type AS class, count(*) AS n FROM part GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY target ORDER BY class) AS c, sum(n) OVER (PARTITION BY target) AS t FROM c)
SELECT target, min(class) AS class FROM k WHERE c > {T.unit('15', 'target')} * t GROUP BY target"""
)
def class_draw(spark, d):
    """One type per brand, drawn by its number of parts."""
    c = T.part(spark, d).groupBy(F.col("p_brand").alias("target"), F.col("p_type").alias("class")).agg(F.count("*").alias("n"))
    return P.category_draw(c, C.uniform(15, F.col("target")), "class", ["target"])


@query(_ranked("score, cell", 6).replace("SELECT target, cell, score, rank FROM", "SELECT target, cell FROM") + f" AND rank = CAST(floor({T.unit('16', 'target')} * 6) AS INTEGER) + 1")
def candidate_draw(spark, d):
    """One of the six nearest parts, each as likely."""
    best = _near(spark, d, 6)
    return best.where(F.col("rank") == F.floor(C.uniform(16, F.col("target")) * 6) + 1).select("target", "cell")


@query(_SCORED + "SELECT target, count(*) AS n FROM s JOIN g a ON a.cell = s.target JOIN g b ON b.cell = s.cell WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 100 GROUP BY target")
def verbatim_ban_radius(spark, d):
    """Places within ten cells of the target don't count."""
    # all of the brand, less those in the tiles of 10 x 10 cells around the target that are too near
    tile = lambda c, s=0: F.floor(F.col(c) / 10) + s
    o = _others(spark, d)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = o.select("target", "p_brand", F.col("x").alias("ax"), F.col("y").alias("ay"), around.alias("t")).select("target", "p_brand", "ax", "ay", tile("ax", F.col("t.i")).alias("tx"), tile("ay", F.col("t.j")).alias("ty"))
    b = T.part(spark, d).select("cell", "x", "y", "p_brand", tile("x").alias("tx"), tile("y").alias("ty"))
    near = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y")) <= 100
    close = a.join(b, ["p_brand", "tx", "ty"]).where(near & (F.col("cell") != F.col("target"))).groupBy("target").agg(F.count("*").alias("m"))
    return o.join(close, "target", "left").select("target", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")


@query(_SCORED + "SELECT target, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM g a WHERE a.cell = s.target AND a.cell + 40 = s.cell) GROUP BY target")
def verbatim_ban(spark, d):
    """The place that would continue the target's own neighbour doesn't count."""
    next_ = T.part(spark, d).select((F.col("cell") - 40).alias("target"), "p_brand", F.lit(1).alias("m")).distinct()
    return _others(spark, d).join(next_, ["target", "p_brand"], "left").select("target", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")


@query(f"WITH {T.STACK}, p AS (SELECT DISTINCT cell, label FROM g), k AS (SELECT p.cell, p.label, g.ti, row_number() OVER (PARTITION BY p.cell, p.label ORDER BY md5(concat_ws(':', '17', p.cell, g.ti)), g.ti) AS r, count(*) OVER (PARTITION BY p.cell, p.label) AS n FROM p JOIN g ON g.cell = p.cell AND g.label = p.label) SELECT cell, label, ti FROM k WHERE r <= CAST(ceil(n / 4.0) AS BIGINT)")
def ti_subset_random(spark, d):
    """A quarter of the images of each label, drawn anew at every cell."""
    w = W.partitionBy("cell", "label")
    key = F.md5(F.concat_ws(":", F.lit("17"), F.col("cell").cast("string"), F.col("ti").cast("string")))
    g = T.stack(spark, d).select("cell", "label", "ti").withColumns({"r": F.row_number().over(w.orderBy(key, "ti")), "n": F.count("*").over(w)})
    return g.where(F.col("r") <= F.ceil(F.col("n") / 4)).select("cell", "label", "ti")


@query(f"WITH {T.STACK}, m AS (SELECT cell, CASE WHEN cell % 5 = 0 THEN NULL WHEN cell % 5 = 1 THEN 2.5 ELSE CAST(cell % 10 AS DOUBLE) END AS ii FROM (SELECT DISTINCT cell FROM g)) SELECT m.cell, count(*) AS n FROM m JOIN g ON g.cell = m.cell AND (m.ii IS NULL OR m.ii < 0 OR abs(m.ii - round(m.ii)) > 0.00001 OR g.ti = CAST(round(m.ii) AS BIGINT)) GROUP BY m.cell")
def ti_select_map(spark, d):
    """A map of image numbers restricts cells; null and what is no image number don't."""
    g = T.stack(spark, d).select("cell", "ti")
    five = F.pmod(F.col("cell"), F.lit(5))
    m = g.select("cell").distinct().withColumn("ii", F.when(five == 0, None).when(five == 1, 2.5).otherwise(F.pmod(F.col("cell"), F.lit(10)).cast("double")))
    free = F.col("ii").isNull() | (F.col("ii") < 0) | (F.abs(F.col("ii") - F.round("ii")) > 1e-5)
    return g.join(m, "cell").where(free | (F.col("ti") == F.round("ii").cast("long"))).groupBy("cell").agg(F.count("*").alias("n"))


# --- gap filling in one go ------------------------------------------------------------------------


def _filled(best, g, value):
    return best.join(g.select("cell", F.col(value).alias("value")).hint("merge"), "cell")  # a grid is too large to be broadcast


@query(f"SELECT q.target, q.cell AS source, p.p_size AS value FROM ({ORACLES['pattern_topk'].replace('rank <= 3', 'rank <= 2')}) q JOIN part p ON p.p_partkey = q.cell WHERE q.rank = CAST(floor({T.unit('18', 'q.target')} * 1.2) AS INTEGER) + 1")
def qs_gap_fill_one_shot(spark, d):
    """Match, pick with k = 1.2 and import the value."""
    g = T.part(spark, d)
    best = _search(g, CROSS, ["p_size"], ["num"], M.Similarity(M.Layout.of([o[2] for o in CROSS], ["num"])), 2)
    return _filled(P.fractional_k(best, 1.2, C.uniform(18, F.col("target"))), g, "p_size").select("target", F.col("cell").alias("source"), "value")


@query(f"SELECT q.target, q.cell AS source, p.p_size AS value FROM ({ORACLES['ds_first_accept']}) q JOIN part p ON p.p_partkey = q.cell")
def ds_gap_fill_one_shot(spark, d):
    """Scan, accept and import the value."""
    return _filled(ds_first_accept(spark, d), T.part(spark, d), "p_size").select("target", F.col("cell").alias("source"), "value")


@query(f"WITH {T.STACK} SELECT q.cell, q.ti, g.v FROM ({ORACLES['as_gap_fill']}) q JOIN g ON g.cell = q.cell AND g.ti = q.ti")
def value_import(spark, d):
    """The values that the drawn images hold at the cells."""
    return as_gap_fill(spark, d).select("cell", "ti").join(T.stack(spark, d).select("cell", "ti", "v"), ["cell", "ti"])
