"""Queries on trees, calibration, sets, job grids and job artifacts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import assess as A
from ..operators import distribute as D
from ..operators import tree as R
from ..operators.grid import frame
from . import artifacts
from . import tables as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- trees ----------------------------------------------------------------------------------------

ARMS = [(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1)]
ARMS_SQL = "t(rank, dx, dy) AS (VALUES (1, -1, 0), (2, 1, 0), (3, 0, -1), (4, 0, 1))"


def _tree_sql(value: str, grid: str = T.ORDERS, name: str = "tree") -> str:
    return f"""WITH {grid}, {ARMS_SQL},
n AS (SELECT g.cell, g.{value} AS class, t.rank, m.{value} AS v FROM g CROSS JOIN t JOIN g m ON m.x = g.x + t.dx AND m.y = g.y + t.dy),
c AS (SELECT cell, class, list(v ORDER BY rank) AS codes FROM n GROUP BY cell, class HAVING count(*) = 4),
{name} AS (SELECT CAST(d AS INTEGER) AS depth, array_to_string(codes[1:d], '.') AS prefix, class, count(*) AS n FROM c, (SELECT unnest(range(5)) AS d) GROUP BY ALL)
"""


def _templates(spark, d, value, grid=T.orders, width=T.ORDER_WIDTH):
    g = grid(spark, d)
    return R.templates(g, ARMS, value, width, T.height(g))


@query(f"WITH {T.ORDERS} SELECT cell, CAST(CASE WHEN x % 8 = 0 AND y % 8 = 0 THEN 3 WHEN x % 4 = 0 AND y % 4 = 0 THEN 2 WHEN x % 2 = 0 AND y % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS level FROM g")
def snesim_levels(spark, d):
    """The grid level at which each cell is simulated."""
    return T.orders(spark, d).select("cell", R.levels(F.col("x"), F.col("y"), 3).alias("level"))


@query(_tree_sql("o_orderstatus") + "SELECT depth, prefix, class, n FROM tree")
def snesim_tree(spark, d):
    """How often each beginning of the neighbours' categories occurs around each category."""
    return R.build(_templates(spark, d, "o_orderstatus"), len(ARMS))


_SECOND = T.ORDERS.replace("o_orderstatus, o_orderpriority, o_totalprice FROM", "CASE WHEN o_orderpriority < '3' THEN 'F' WHEN o_orderpriority < '4' THEN 'O' ELSE 'P' END AS s FROM")


@query(f"SELECT depth, prefix, class, CAST(sum(n) AS BIGINT) AS n FROM (({_tree_sql('o_orderstatus')} SELECT * FROM tree) UNION ALL ({_tree_sql('s', _SECOND)} SELECT * FROM tree)) GROUP BY ALL")
def snesim_tree_merge(spark, d):
    """The sum of the trees of two images."""
    second = lambda s, d: T.orders(s, d).withColumn("s", F.when(F.col("o_orderpriority") < "3", "F").when(F.col("o_orderpriority") < "4", "O").otherwise("P"))
    return R.merge([snesim_tree(spark, d), R.build(_templates(spark, d, "s", second), len(ARMS))])


@query(
    _tree_sql("o_orderstatus")
    + """, k AS (SELECT g.cell AS target, [max(m.o_orderstatus) FILTER (t.rank = 1 AND m.cell % 3 <> 0), max(m.o_orderstatus) FILTER (t.rank = 2 AND m.cell % 3 <> 0), max(m.o_orderstatus) FILTER (t.rank = 3 AND m.cell % 3 <> 0), max(m.o_orderstatus) FILTER (t.rank = 4 AND m.cell % 3 <> 0)] AS codes
FROM g CROSS JOIN t LEFT JOIN g m ON m.x = g.x + t.dx AND m.y = g.y + t.dy WHERE g.cell % 50 = 0 GROUP BY g.cell),
p AS (SELECT DISTINCT depth, prefix, string_split(prefix, '.') AS parts FROM tree),
r AS (SELECT k.target, p.depth, p.prefix FROM k JOIN p ON p.depth = 0 OR (
 (p.depth < 1 OR k.codes[1] IS NULL OR k.codes[1] = p.parts[1]) AND (p.depth < 2 OR k.codes[2] IS NULL OR k.codes[2] = p.parts[2])
 AND (p.depth < 3 OR k.codes[3] IS NULL OR k.codes[3] = p.parts[3]) AND (p.depth < 4 OR k.codes[4] IS NULL OR k.codes[4] = p.parts[4]))),
m AS (SELECT target, max(depth) AS depth FROM r GROUP BY target)
SELECT target, depth, class, CAST(sum(n) AS BIGINT) AS n FROM r JOIN m USING (target, depth) JOIN tree USING (depth, prefix) GROUP BY ALL"""
)
def snesim_deepest_match(spark, d):
    """Counts by class at the deepest place that the known neighbours reach; every third cell is unknown."""
    from ..operators.grid import neighbours

    g = T.orders(spark, d)
    targets = g.where(F.pmod(F.col("cell"), F.lit(50)) == 0).select("cell", "x", "y")
    known = g.where(F.pmod(F.col("cell"), F.lit(3)) != 0).select("cell", F.col("o_orderstatus").alias("v"))
    near = neighbours(targets, known, ARMS, T.ORDER_WIDTH, T.height(g))
    codes = near.groupBy("cell").agg(F.array(*[F.max(F.when(F.col("rank") == i + 1, F.col("v"))) for i in range(4)]).alias("codes"))
    none = F.array(*[F.lit(None).cast("string")] * 4)
    known = targets.join(codes, "cell", "left").select(F.col("cell").alias("target"), F.coalesce("codes", none).alias("codes"))
    return R.deepest(snesim_tree(spark, d), known)


@query("SELECT count(*) AS n, count(*) - count(value) AS n_null, count(*) FILTER (abs(value - round(value)) > 0.00001) AS n_not_whole, count(*) FILTER (value NOT IN (SELECT DISTINCT CAST(p_size AS DOUBLE) FROM part)) AS n_unknown FROM (SELECT CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN l_quantity + 0.5 ELSE l_quantity END AS value FROM lineitem)")
def snesim_category_check(spark, d):
    """Values that are null, not whole or in no image."""
    v = T.read(spark, d, "lineitem").select(F.when(F.col("l_tax") == 0, None).when(F.col("l_discount") == 0, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity")).alias("value"))
    return R.check_categories(v, T.part(spark, d).select(F.col("p_size").cast("double").alias("value")))


@query(
    f"""WITH {T.ORDERS}, r AS (SELECT cell, o_orderpriority AS c, row_number() OVER (PARTITION BY o_orderpriority ORDER BY cell) - 1 AS nth, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM g),
q AS (SELECT i AS target, (SELECT min(o_orderpriority) FROM g WHERE substr(o_orderpriority, 1, 1) = CAST(1 + i % 5 AS VARCHAR)) AS c FROM (SELECT unnest(range(500)) AS i))
SELECT q.target, q.c AS category, r.cell FROM q JOIN r ON r.c = q.c AND r.nth = CAST(floor({T.unit('21', 'q.target')} * r.n) AS BIGINT)"""
)
def snesim_category_place(spark, d):
    """A random place of a drawn category, for 500 draws."""
    g = T.orders(spark, d)
    w = W.partitionBy("category", "part")
    cut = g.select("cell", F.col("o_orderpriority").alias("category"), C.div(F.col("cell"), 4096).alias("part"))
    size = cut.groupBy("category", "part").agg(F.count("*").alias("k"))
    by = W.partitionBy("category")
    size = size.withColumns({"before": F.sum("k").over(by.orderBy("part")) - F.col("k"), "n": F.sum("k").over(by)}).drop("k")
    ranked = cut.withColumn("r", F.row_number().over(w.orderBy("cell")) - 1).join(size, ["category", "part"]).withColumn("nth", F.col("before") + F.col("r"))
    names = g.select(F.col("o_orderpriority").alias("category")).distinct().withColumn("digit", F.substring("category", 1, 1).cast("int"))
    draws = spark.range(500).select(F.col("id").alias("target"), (1 + F.pmod(F.col("id"), F.lit(5))).cast("int").alias("digit")).join(names, "digit")
    n = ranked.select("category", "n").distinct()
    draws = draws.join(n, "category").withColumn("nth", F.floor(C.uniform(21, F.col("target")) * F.col("n")).cast("long")).drop("n")
    return draws.join(ranked.select("category", "nth", "cell"), ["category", "nth"]).select("target", "category", "cell")


# --- calibration, narrowness, votes ----------------------------------------------------------------

_ERRORS = f"""WITH {T.PART}, c AS (SELECT k AS neighbours, s AS step FROM (VALUES (1), (2), (4)) a(k), (VALUES (1), (3)) b(s)),
e AS (SELECT c.neighbours, c.step, g.cell, g.p_size - avg(m.p_size) AS error FROM g CROSS JOIN c JOIN g m ON m.cell > g.cell AND m.cell <= g.cell + c.neighbours * c.step AND (m.cell - g.cell) % c.step = 0 GROUP BY ALL)
"""
_ERRORS = _ERRORS.replace("g.p_size - avg(m.p_size) AS error FROM", "g.p_size - avg(m.p_size) AS error, any_value(g.p_size) AS own FROM").replace(" GROUP BY ALL)", " GROUP BY c.neighbours, c.step, g.cell, g.p_size)")


def _errors(spark, d):
    """Errors of guessing a part's size from following parts, for 3 x 2 configurations."""
    g = T.part(spark, d).select("cell", "p_size")
    steps = [(k, s, i * s) for k in (1, 2, 4) for s in (1, 3) for i in range(1, k + 1)]
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("neighbours"), F.lit(s).alias("step"), F.lit(o).alias("o")) for k, s, o in steps]))
    near = g.select("cell", F.col("p_size").alias("own"), each).withColumn("to", F.col("cell") + F.col("o")).join(g.select(F.col("cell").alias("to"), "p_size"), "to")
    return near.groupBy("neighbours", "step", "cell", "own").agg(F.avg("p_size").alias("m")).select("neighbours", "step", "cell", (F.col("own") - F.col("m")).alias("error"))


_STATS = "SELECT neighbours, step, round(sqrt(avg(error * error)), 6) AS mean_error, round(pow(greatest(avg(pow(error, 4)) - pow(avg(error * error), 2), 0), 0.25), 6) AS deviation, count(*) AS n FROM e GROUP BY ALL"


@query("SELECT k AS neighbours, s AS kernel, d::DOUBLE AS density FROM (VALUES (10), (20), (40), (80)) a(k), (VALUES (1), (2)) b(s), (VALUES (0.0078125), (0.03125), (0.125), (0.5)) c(d)")
def calib_configs(spark, d):
    """The configurations to calibrate: neighbours x kernels x densities."""
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, (10, 20, 40, 80)))).alias("neighbours"))
    two = one.select("neighbours", F.explode(F.array(F.lit(1), F.lit(2))).alias("kernel"))
    return two.select("neighbours", "kernel", F.explode(F.array(*map(F.lit, (0.0078125, 0.03125, 0.125, 0.5)))).alias("density"))


@query(_ERRORS + _STATS)
def calib_error_stats(spark, d):
    return A.error_stats(_errors(spark, d), ["neighbours", "step"])


@query(_ERRORS + f", s AS ({_STATS}), b AS (SELECT *, min(mean_error + deviation / 2) OVER (PARTITION BY step) AS bound FROM s) SELECT neighbours, step, mean_error, deviation, n FROM b WHERE n <= 100 OR mean_error - deviation / 2 <= bound")
def calib_prune(spark, d):
    """Configurations that stay in the calibration."""
    return A.prune(calib_error_stats(spark, d), ["step"], 2.0, 100)


@query(_ERRORS + f", s AS ({_STATS}) SELECT step, neighbours, mean_error FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY mean_error, neighbours) AS r FROM s) WHERE r = 1")
def calib_best(spark, d):
    best = F.row_number().over(W.partitionBy("step").orderBy("mean_error", "neighbours"))
    return calib_error_stats(spark, d).withColumn("r", best).where("r = 1").select("step", "neighbours", "mean_error")


_NARROW = "WITH v AS (SELECT p_brand AS brand, list(p_size ORDER BY p_size) AS v, count(*) AS n FROM part GROUP BY 1), s AS (SELECT brand, n, v[least(n, CAST(floor(0.75 * n) AS BIGINT) + 1)] - v[least(n, CAST(ceil(0.25 * n) AS BIGINT) + 1)] AS spread FROM v) "


@query(_NARROW + "SELECT brand, CAST(n AS INTEGER) AS n, spread FROM s")
def nds_narrowness(spark, d):
    """The interquartile range of each brand's sizes."""
    return A.narrowness(T.part(spark, d).select(F.col("p_brand").alias("brand"), F.col("p_size").alias("value")), "brand")


@query(_NARROW + "SELECT brand, spread FROM (SELECT *, row_number() OVER (ORDER BY spread, brand) AS r FROM s) WHERE r <= 5")
def nds_chunk(spark, d):
    """The five narrowest distributions: those to simulate next."""
    return nds_narrowness(spark, d).orderBy("spread", "brand").limit(5).select("brand", "spread")


@query("SELECT p_brand AS target, p_type AS class, count(*) AS p, round(pow(count(*) / 3.0, 1.5) * 3 / sum(pow(count(*) / 3.0, 1.5) * 3) OVER (PARTITION BY p_brand), 6) AS share FROM part GROUP BY 1, 2")
def ad_vote(spark, d):
    """Tempered shares of the classes that the planes' candidates vote for."""
    return A.votes(T.part(spark, d).select(F.col("p_brand").alias("target"), F.col("p_type").alias("class")), "target", 3)


_CLEAN = f"""WITH {T.ORDERS}, {ARMS_SQL},
n AS (SELECT g.cell, g.o_orderpriority AS own, m.o_orderpriority AS v, count(*) AS n FROM g CROSS JOIN t JOIN g m ON m.x = g.x + t.dx AND m.y = g.y + t.dy GROUP BY ALL),
a AS (SELECT cell, bool_or(own = v) AS equal, max(n) AS n FROM n GROUP BY cell),
c AS (SELECT a.cell, min(n.v) AS new FROM a JOIN n ON n.cell = a.cell AND n.n = a.n WHERE NOT equal AND a.n >= 2 AND a.cell % 10 <> 0 GROUP BY a.cell)
SELECT g.cell, coalesce(c.new, g.o_orderpriority) AS o_orderpriority, c.new IS NOT NULL AS changed FROM g LEFT JOIN c USING (cell)"""


@query(_CLEAN)
def ds_singleton_clean(spark, d):
    """Lone categories give way to their neighbours'; every tenth cell is protected."""
    g = T.orders(spark, d)
    protected = g.where(F.pmod(F.col("cell"), F.lit(10)) == 0)
    return A.clean_singletons(g, "o_orderpriority", T.ORDER_WIDTH, T.height(g), protected)


@query(f"WITH {T.PART} SELECT CAST(ceil(max(1 + {T.unit('22', 'cell')} * 4)) AS BIGINT) AS k, bool_or(p_size % 50 = 0) AS incomplete FROM g")
def measurement_flags(spark, d):
    """The largest k of a map, and whether any variable has holes."""
    g = T.part(spark, d).withColumn("s", F.when(F.pmod(F.col("p_size"), F.lit(50)) != 0, F.col("p_size")))
    return g.agg(F.ceil(F.max(1 + C.uniform(22, F.col("cell")) * 4)).alias("k"), A.any_null(g, ["s", "p_retailprice"]).alias("incomplete"))


# --- sets -----------------------------------------------------------------------------------------


@query("WITH n AS (SELECT ti, count(*) AS n FROM (SELECT vec_id AS ti, unnest(embedding) FROM embeddings) GROUP BY ti) SELECT ti, CAST(sum(n) OVER (ORDER BY ti) - n AS BIGINT) AS base, n FROM n")
def ti_concat(spark, d):
    """Where each image begins when all are laid end to end."""
    n = T.stack(spark, d).groupBy("ti").agg(F.count("*").alias("n")).withColumn("part", C.div(F.col("ti"), 1024))
    part = n.groupBy("part").agg(F.sum("n").alias("k"))
    part = part.select("part", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("before"))
    run = F.sum("n").over(W.partitionBy("part").orderBy("ti")) - F.col("n")
    return n.withColumn("run", run).join(part, "part").select("ti", (F.col("before") + F.col("run")).alias("base"), "n")


@query(f"WITH {T.PART}, {ARMS_SQL} SELECT DISTINCT m.cell FROM g CROSS JOIN t JOIN g m ON m.x = g.x + t.dx AND m.y = g.y + t.dy WHERE g.cell % 50 = 0")
def nds_places(spark, d):
    """The distinct cells around those just simulated: what to assess again."""
    from ..operators.grid import neighbours

    g = T.part(spark, d)
    return neighbours(g.where(F.pmod(F.col("cell"), F.lit(50)) == 0).select("cell", "x", "y"), g.select("cell"), ARMS, T.PART_WIDTH, T.height(g)).select(F.col("to").alias("cell")).distinct()


@query("SELECT count(*) = 0 AS equal FROM ((SELECT DISTINCT o_orderstatus AS v FROM orders EXCEPT SELECT DISTINCT l_linestatus FROM lineitem) UNION ALL (SELECT DISTINCT l_linestatus FROM lineitem EXCEPT SELECT DISTINCT o_orderstatus FROM orders))")
def category_sets_equal(spark, d):
    a = T.read(spark, d, "orders").select(F.col("o_orderstatus").alias("v")).distinct()
    b = T.read(spark, d, "lineitem").select(F.col("l_linestatus").alias("v")).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal"))


@query("SELECT DISTINCT CAST(l_quantity AS BIGINT) AS v FROM lineitem EXCEPT SELECT CAST(p_size AS BIGINT) FROM part WHERE p_size <= 40")
def unknown_categories(spark, d):
    a = T.read(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("v"))
    return a.subtract(T.part(spark, d).where("p_size <= 40").select(F.col("p_size").cast("long").alias("v")))


# --- job grids ------------------------------------------------------------------------------------

_JOBS = "j AS (SELECT i % 6 AS bx, i // 6 AS by, 100 + i AS job FROM (SELECT unnest(range(24)) AS i))"


@query("WITH g(id, grid) AS (VALUES ('a', [[101, 102], [103, 104]]), ('b', [[7, 8, 9]])), r AS (SELECT id, grid, unnest(range(len(grid))) AS r FROM g), c AS (SELECT id, grid, r, unnest(range(len(grid[r + 1]))) AS c FROM r) SELECT id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(r * len(grid[r + 1]) + c AS INTEGER) AS position, CAST(grid[r + 1][c + 1] AS BIGINT) AS job FROM c")
def jobgrid_flatten(spark, d):
    return D.flatten_jobs(spark.createDataFrame([("a", "[[101,102],[103,104]]"), ("b", "[[7,8,9]]")], "id string, grid string"))


@query(f"WITH {_JOBS} SELECT 'x' AS id, a.job, b.job AS neighbour FROM j a JOIN j b ON abs(a.bx - b.bx) <= 1 AND abs(a.by - b.by) <= 1 AND a.job <> b.job")
def jobgrid_neighbours(spark, d):
    jobs = frame(spark, 6, 4).select(F.lit("x").alias("id"), F.col("x").alias("c"), F.col("y").alias("r"), (100 + F.col("cell")).alias("job"))
    return D.job_neighbours(jobs)


@query(f"WITH {T.PART}, {ARMS_SQL} SELECT cell, (cell // 4) * 4 + cell % 4 AS \"order\", cell % 4 AS owner FROM g")
def halo_owner(spark, d):
    """Global order and owner when four jobs take turns."""
    g = T.part(spark, d)
    o = D.global_order(C.div(F.col("cell"), 4), 4, F.pmod(F.col("cell"), F.lit(4)))
    return g.select("cell", o.alias("order")).withColumn("owner", D.owner(F.col("order"), 4))


@query(
    f"""WITH {T.PART}, b AS (SELECT x // 10 AS bx, y // 10 AS q, x % 10 AS x, y % 10 AS y, p_size AS value FROM g),
s(sx, sy) AS (SELECT a, c FROM (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) q(c) WHERE a <> 0 OR c <> 0)
SELECT t.bx, t.q AS "by", b.x - 10 * s.sx AS x, b.y - 10 * s.sy AS y, b.value FROM b CROSS JOIN s JOIN (SELECT DISTINCT bx, q FROM b) t ON t.bx = b.bx + s.sx AND t.q = b.q + s.sy
WHERE b.x - 10 * s.sx BETWEEN -2 AND 11 AND b.y - 10 * s.sy BETWEEN -2 AND 11"""
)
def halo_strips(spark, d):
    """What blocks of 10 x 10 cells see of their neighbours within two cells."""
    g = T.part(spark, d)
    b = g.select(C.div(F.col("x"), 10).alias("bx"), C.div(F.col("y"), 10).alias("by"), F.pmod(F.col("x"), F.lit(10)).alias("x"), F.pmod(F.col("y"), F.lit(10)).alias("y"), F.col("p_size").alias("value"))
    return D.halo(b, 10, 10, 2)


@query(
    f"""WITH {T.PART}, b AS (SELECT x // 10 AS bx, y // 10 AS q, x % 10 AS x, y % 10 AS y, cell AS ord FROM g),
s(sx, sy) AS (SELECT a, c FROM (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) q(c) WHERE a <> 0 OR c <> 0),
padded AS (SELECT t.bx, t.q, b.x - 10 * s.sx AS x, b.y - 10 * s.sy AS y, b.ord FROM b CROSS JOIN s JOIN (SELECT DISTINCT bx, q FROM b) t ON t.bx = b.bx + s.sx AND t.q = b.q + s.sy
WHERE b.x - 10 * s.sx BETWEEN -2 AND 11 AND b.y - 10 * s.sy BETWEEN -2 AND 11),
u AS (SELECT l_partkey - 1 AS ord, arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT u.ord % 4 AS owner, u.ord AS "order", p.bx, p.q AS "by", p.x, p.y, u.value FROM padded p JOIN u ON p.ord % 4 = u.ord % 4 AND p.ord = u.ord"""
)
def halo_update_join(spark, d):
    """Updates of parts (the first returned line of each) at the cells of the neighbours' margins that wait for them, by owner and order."""
    g = T.part(spark, d)
    b = g.select(C.div(F.col("x"), 10).alias("bx"), C.div(F.col("y"), 10).alias("by"), F.pmod(F.col("x"), F.lit(10)).alias("x"), F.pmod(F.col("y"), F.lit(10)).alias("y"), F.col("cell").alias("value"))
    padded = D.halo(b, 10, 10, 2).withColumnRenamed("value", "order")
    lines = T.read(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_partkey") - 1).alias("order"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("at"), F.col("l_quantity").alias("value"))
    return D.receive(padded, D.first_writer(lines, "order", "at"), 4)


@query("SELECT user_id AS cell, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def halo_first_writer(spark, d):
    """Updates keyed by cell (user) in order of event: the first write counts."""
    return D.first_writer(T.read(spark, d, "events").select(F.col("user_id").alias("cell"), "event_id", "value"), "cell", "event_id")


# --- jobs and artifacts -----------------------------------------------------------------------------
# Events stand for the progress messages of jobs (users).


@query("SELECT user_id AS job, event_type AS key, arg_max(value, struct_pack(ts := ts, id := event_id)) AS value FROM events GROUP BY 1, 2")
def progress_latest(spark, d):
    e = T.read(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("key"), "value", F.struct("ts", "event_id").alias("at"))
    return artifacts.latest(e, ["job", "key"], "at", "value")


@query("SELECT user_id AS job, count(*) FILTER (event_type = 'error') AS errors, count(*) AS lines FROM events GROUP BY 1")
def artifact_warning_counts(spark, d):
    e = T.read(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("job")).agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.count("*").alias("lines"))


@query("WITH m(algorithm, flag) AS (VALUES ('qs', 'ti'), ('qs', 'di'), ('qs', 'k'), ('qs', 'n'), ('ds', 'ti'), ('ds', 'di'), ('ds', 'th'), ('ds', 'f'), ('ds', 'n'), ('as', 'ti'), ('as', 'di'), ('as', 'k'), ('as', 'n')), s(algorithm, flag) AS (VALUES ('qs', 'ti'), ('qs', 'k'), ('ds', 'ti'), ('ds', 'di'), ('ds', 'th'), ('ds', 'f'), ('ds', 'n')) SELECT algorithm, flag FROM m EXCEPT SELECT * FROM s")
def mandatory_missing(spark, d):
    """Flags that jobs lack."""
    from .jobs import MANDATORY

    need = spark.createDataFrame([(a, f) for a in ("qs", "ds", "as") for f in MANDATORY[a]], "algorithm string, flag string")
    given = spark.createDataFrame([("qs", "ti"), ("qs", "k"), *[("ds", f) for f in MANDATORY["ds"]]], "algorithm string, flag string")
    return need.join(given, ["algorithm", "flag"], "left_anti")


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def upload_dedup(spark, d):
    """Each distinct payload once, under its digest."""
    return artifacts.distinct_payloads(T.read(spark, d, "documents"), "text", "doc_id")


@query("SELECT DISTINCT sha256(d.text) AS digest FROM documents d WHERE sha256(d.text) IN (SELECT sha256(text) FROM benchmark) OR d.doc_id IN (SELECT doc_id FROM labels)")
def upload_present(spark, d):
    """Payloads the store has already (here: those of labelled documents)."""
    docs = T.read(spark, d, "documents")
    have = docs.join(T.read(spark, d, "labels"), "doc_id", "left_semi").select(F.sha2("text", 256).alias("digest")).unionByName(T.read(spark, d, "benchmark").select(F.sha2("text", 256).alias("digest")))
    return docs.select(F.sha2("text", 256).alias("digest")).join(have.distinct(), "digest", "left_semi").distinct()


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM pages")
def name_sanitise(spark, d):
    """Names safe as file names."""
    return T.read(spark, d, "pages").select("page_id", artifacts.safe_name(F.col("url")).alias("name"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 % 3600000 AS into_hour, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS stamp FROM events")
def unix_milliseconds(spark, d):
    """Millisecond stamps as progress messages carry them: to a number, within the hour, and back to text."""
    ms = C.unix_ms(F.col("ts"))
    e = T.read(spark, d, "events").select("event_id", ms.alias("ms"))
    return e.select("event_id", "ms", F.pmod("ms", F.lit(3_600_000)).alias("into_hour"), F.date_format(C.from_unix_ms(F.col("ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("stamp"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_parse(spark, d):
    """Key-value metadata of progress messages."""
    e = T.read(spark, d, "events")
    return e.select("event_id", F.from_json("props", "struct<k:long>")["k"].alias("k"))
