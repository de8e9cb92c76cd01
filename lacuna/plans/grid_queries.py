"""Queries on grids, kernels and templates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import grid as G
from ..operators import kernel as K
from . import tables as T

QUERIES: dict = {}
ORACLES: dict = {}

STEPS = [(1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1), (3, -2, 1)]
STEPS_SQL = "t(rank, dx, dy) AS (VALUES (1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1), (5, 3, -2))"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {T.PART} SELECT cell, x, y, x + 40 * y AS again FROM g")
def grid_coords(spark, d):
    g = T.part(spark, d)
    x, y = C.coordinates(F.col("cell"), [T.PART_WIDTH, 1 << 40])
    return g.select("cell", x.alias("x"), y.alias("y")).withColumn("again", C.index([F.col("x"), F.col("y")], [T.PART_WIDTH, 1]))


@query(f"WITH {T.PART} SELECT cell, y + h * x AS flipped, p_size FROM g, dim")
def grid_flip(spark, d):
    g = T.part(spark, d)
    return g.select("cell", C.index([F.col("y"), F.col("x")], [T.height(g), T.PART_WIDTH]).alias("flipped"), "p_size")


_WRAP = f"WITH {T.PART}, {STEPS_SQL} SELECT cell, rank, (((x + {{0}}) % 40) + 40) % 40 + 40 * ((((y + {{1}}) % h) + h) % h) AS \"to\", x + {{0}} BETWEEN 0 AND 39 AND y + {{1}} BETWEEN 0 AND h - 1 AS inside FROM g, dim, t"


@query(_WRAP.format("dx", "dy"))
def grid_wrap_delta(spark, d):
    g = T.part(spark, d)
    return G.wrap_delta(g.select("cell", "x", "y"), STEPS, T.PART_WIDTH, T.height(g)).select("cell", "rank", "to", "inside")


@query(_WRAP.format("dx", "0"))
def grid_wrap_axis(spark, d):
    g = T.part(spark, d)
    return G.wrap_delta(g.select("cell", "x", "y"), STEPS, T.PART_WIDTH, T.height(g), axes=[0]).select("cell", "rank", "to", "inside")


_PIVOT = "CAST(max(n) FILTER (event_type = '{0}') AS DOUBLE) AS {0}"


@query(f"WITH {T.EVENTS} SELECT x + 24 * y AS cell, " + ", ".join(_PIVOT.format(t) for t in T.EVENT_TYPES) + " FROM g GROUP BY x, y")
def grid_pivot_last(spark, d):
    """The last dimension (event type) as variables of one grid."""
    return T.events(spark, d).groupBy("cell").pivot("event_type", list(T.EVENT_TYPES)).agg(F.max(F.col("n").cast("double")))


@query(f"WITH {T.PART} SELECT cell * 2 + k AS cell, CASE k WHEN 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS value FROM g, (VALUES (0), (1)) v(k)")
def grid_unpivot_first(spark, d):
    """Variables as a new, fastest dimension."""
    return T.part(spark, d).select((F.col("cell") * 2).alias("c"), F.expr("stack(2, 0, cast(p_size as double), 1, p_retailprice) as (k, value)")).select((F.col("c") + F.col("k")).alias("cell"), "value")


@query(f"WITH {T.PART}, f AS (SELECT i AS cell, i % 44 AS x, i // 44 AS y FROM (SELECT unnest(range(44 * (h + 4))) AS i FROM dim)) SELECT f.cell, coalesce(p_size, -1) AS p_size FROM f LEFT JOIN g ON g.x + 2 = f.x AND g.y + 2 = f.y")
def grid_pad(spark, d):
    g = T.part(spark, d)
    return G.pad(g, T.PART_WIDTH, T.height(g), 2, ["p_size"], -1).select("cell", "p_size")


@query(f"WITH {T.PART} SELECT x - 2 + 36 * (y - 2) AS cell, p_size FROM g, dim WHERE x BETWEEN 2 AND 37 AND y BETWEEN 2 AND h - 3")
def grid_crop(spark, d):
    g = T.part(spark, d)
    return G.crop(g, T.PART_WIDTH, T.height(g), 2, ["p_size"]).select("cell", "p_size")


@query(f"WITH {T.PART} SELECT cell, x + 3 + 46 * (y + 3) AS padded FROM g")
def grid_pad_path(spark, d):
    """Where each cell of a path lies in the grid padded by 3."""
    return T.part(spark, d).select("cell", C.index([F.col("x") + 3, F.col("y") + 3], [T.PART_WIDTH + 6, 1]).alias("padded"))


@query(f"WITH {T.PART} SELECT cell, (x - 19) * (x - 19) + (y - (h - 1) // 2) * (y - (h - 1) // 2) AS d2 FROM g, dim")
def grid_center_distance(spark, d):
    g = T.part(spark, d)
    return G.center_distance(g, T.PART_WIDTH, T.height(g)).select("cell", "d2")


_FRAME = "f AS (SELECT i AS cell, i % 24 AS x, i // 24 AS y FROM (SELECT unnest(range(720)) AS i))"


@query(f"WITH {T.EVENTS}, {_FRAME} SELECT cell, x, y, event_type FROM f, (SELECT DISTINCT event_type FROM events) e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.cell = f.cell AND g.event_type = e.event_type)")
def cells_to_simulate(spark, d):
    """The holes of every variable: hours without events of a type."""
    g = T.events(spark, d)
    out = None
    for t in T.EVENT_TYPES:
        own = G.holes(g.where(F.col("event_type") == t), T.HOURS, T.DAYS, "n").withColumn("event_type", F.lit(t))
        out = own if out is None else out.unionByName(own)
    return out


_WIDE = "w AS (SELECT x + 24 * y AS cell, " + ", ".join(_PIVOT.format(t) for t in T.EVENT_TYPES) + " FROM g GROUP BY x, y)"
_ANY = " OR ".join(f"{t} IS NULL" for t in T.EVENT_TYPES)


@query(f"WITH {T.EVENTS}, {_WIDE} SELECT cell, " + ", ".join(f"CASE WHEN NOT ({_ANY}) THEN {t} END AS {t}" for t in T.EVENT_TYPES) + " FROM w")
def vector_null_rows(spark, d):
    return G.all_or_nothing(grid_pivot_last(spark, d), list(T.EVENT_TYPES))


@query(f"WITH {T.PART}, p AS (SELECT cell, {T.unit('5', 'cell')} AS u FROM g) SELECT cell, row_number() OVER (ORDER BY u, cell) - 1 AS ord FROM p WHERE u >= 0.25")
def path_exclude_inf(spark, d):
    """An explicit path: cells in order of a map, those at minus infinity left out."""
    from ..operators.pick import nth_of

    u = C.uniform(5, F.col("cell"))
    p = T.part(spark, d).select("cell", F.when(u < 0.25, float("-inf")).otherwise(u).alias("sp")).where(F.col("sp") > float("-inf"))
    # order by (map value, cell): as one long, so that ranks are counted in ranges
    key = (F.col("sp") * 4294967296).cast("long") * (1 << 30) + F.col("cell")
    return nth_of(p.withColumn("key", key), "key").select("cell", F.col("nth").alias("ord"))


@query(f"WITH {T.EVENTS}, c AS (SELECT DISTINCT cell, x, y FROM g), {_FRAME} SELECT count(*) AS n_cells, count(DISTINCT cell) AS n_distinct, CAST(0 AS BIGINT) AS n_outside, 720 - count(DISTINCT cell) AS n_missing FROM c")
def grid_validate(spark, d):
    return G.validate(T.events(spark, d).select("cell", "x", "y").distinct(), T.HOURS, T.DAYS)


_BOX = "b AS (SELECT i % 11 - 5 AS dx, i // 11 - 5 AS dy FROM (SELECT unnest(range(121)) AS i))"


@query(f"WITH {_BOX} SELECT dx, dy, 1.0::DOUBLE AS uniform, round(exp(-0.5 * sqrt(dx * dx + dy * dy)), 9) AS exponential, round(exp(-0.25 * (dx * dx + dy * dy) / 2) / sqrt(2 * pi()), 9) AS gaussian FROM b")
def kernel_generate(spark, d):
    kinds = {"uniform": K.weight("uniform"), "exponential": F.round(K.weight("exponential", 0.5), 9), "gaussian": F.round(K.weight("gaussian", 0.5), 9)}
    return K.box(spark, 11, 11).select("dx", "dy", *[w.alias(k) for k, w in kinds.items()])


@query("SELECT least(40 // 2 + 1, 120 // 2 + 1) AS size_x, least((SELECT max(p_partkey // 40) + 1 FROM part) // 2 + 1, (SELECT max(o_orderkey // 120) + 1 FROM orders) // 2 + 1) AS size_y")
def kernel_default_size(spark, d):
    """Half of the smallest image and one, by dimension."""
    dims = [g.agg(F.lit(w).alias("w"), (F.max("y") + 1).alias("h")) for g, w in ((T.part(spark, d), T.PART_WIDTH), (T.orders(spark, d), T.ORDER_WIDTH))]
    return dims[0].unionByName(dims[1]).agg(F.min(C.div(F.col("w"), 2) + 1).cast("int").alias("size_x"), F.min(C.div(F.col("h"), 2) + 1).alias("size_y"))


@query(f"WITH {_BOX}, k AS (SELECT max(dx) - min(dx) + 1 AS w, max(dy) - min(dy) + 1 AS h FROM b UNION ALL SELECT 7, 15) SELECT max(w // 2) AS pad_x, max(h // 2) AS pad_y FROM k")
def kernel_padding(spark, d):
    """The margin that the largest of several kernels needs."""
    a = K.box(spark, 11, 11).withColumn("kernel", F.lit(1)).unionByName(K.box(spark, 7, 15).withColumn("kernel", F.lit(2)))
    size = a.groupBy("kernel").agg((F.max("dx") - F.min("dx") + 1).alias("w"), (F.max("dy") - F.min("dy") + 1).alias("h"))
    return size.agg(F.max(C.div(F.col("w"), 2)).alias("pad_x"), F.max(C.div(F.col("h"), 2)).alias("pad_y"))


@query(f"WITH {_BOX}, c AS (SELECT row_number() OVER (ORDER BY s) AS slot, s AS category FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)), s AS (SELECT * FROM c UNION ALL SELECT (SELECT max(slot) FROM c) + 1, 'support') SELECT dx, dy, CAST(slot AS INTEGER) AS slot, category, 1.0::DOUBLE AS w FROM b, s")
def kernel_per_category(spark, d):
    categories = T.orders(spark, d).select(F.col("o_orderstatus").alias("category")).distinct()
    return K.per_category(K.box(spark, 11, 11).withColumn("w", K.weight("uniform")), categories, support=True).select("dx", "dy", "slot", "category", "w")


@query(f"WITH {_BOX} SELECT dx, dy FROM b WHERE (dx + dy) % 2 = 0")
def kernel_drop_missing(spark, d):
    """Offsets without a weight are no part of the template."""
    k = K.box(spark, 11, 11).withColumn("w", F.when(F.pmod(F.col("dx") + F.col("dy"), F.lit(2)) == 0, 1.0))
    return k.where("w is not null").select("dx", "dy")


def _order(key: str) -> str:
    return f"WITH {_BOX} SELECT dx, dy, CAST(row_number() OVER (ORDER BY {key}, dy, dx) AS INTEGER) AS rank FROM b WHERE dx <> 0 OR dy <> 0"


@query(_order("dx * dx + dy * dy"))
def template_order_l2(spark, d):
    return K.ordered(K.box(spark, 11, 11), "l2").select("dx", "dy", "rank")


@query(_order("abs(dx) + abs(dy)"))
def template_order_l1(spark, d):
    return K.ordered(K.box(spark, 11, 11), "l1").select("dx", "dy", "rank")


@query(_order("-abs(round(exp(-0.5 * sqrt(dx * dx + dy * dy)) * CASE WHEN dx > 0 THEN 2 ELSE 1 END, 9))"))
def template_order_weight(spark, d):
    w = F.round(K.weight("exponential", 0.5) * F.when(F.col("dx") > 0, 2).otherwise(1), 9)
    return K.ordered(K.box(spark, 11, 11).withColumn("w", w), "weight").select("dx", "dy", "rank")


@query(f"WITH {_BOX}, a AS (SELECT unnest([0.0, 0.5, 1.2, 3.141592653589793]) AS angle) SELECT dx, dy, angle::DOUBLE AS angle, CAST(round(round(cos(angle) * dx - sin(angle) * dy, 9)) AS BIGINT) AS rx, CAST(round(round(sin(angle) * dx + cos(angle) * dy, 9)) AS BIGINT) AS ry FROM b, a")
def offsets_rotate2d(spark, d):
    k = K.box(spark, 11, 11).select("dx", "dy", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.2, C.PI)))).alias("angle"))
    rx, ry = C.rotated_2d(F.col("dx"), F.col("dy"), F.col("angle"))
    return k.select("dx", "dy", "angle", rx.alias("rx"), ry.alias("ry"))


@query(f"WITH {_BOX}, a AS (SELECT unnest([0.5, 2.0, -1.0, NULL]) AS s) SELECT dx, dy, s::DOUBLE AS s, CAST(round(round(CASE WHEN s > 0 THEN s ELSE 1 END * dx, 9)) AS BIGINT) AS rx, CAST(round(round(CASE WHEN s > 0 THEN s ELSE 1 END * dy, 9)) AS BIGINT) AS ry FROM b, a")
def offsets_scale(spark, d):
    """Scales that aren't positive leave offsets as they are."""
    k = K.box(spark, 11, 11).select("dx", "dy", F.explode(F.array(F.lit(0.5), F.lit(2.0), F.lit(-1.0), F.lit(None).cast("double"))).alias("s"))
    rx, ry = C.rotated_2d(F.col("dx"), F.col("dy"), F.lit(0.0), F.col("s"))
    return k.select("dx", "dy", "s", rx.alias("rx"), ry.alias("ry"))



@query(
    """WITH v AS (SELECT i % 5 - 2 AS x, (i // 5) % 5 - 2 AS y, i // 25 - 2 AS z FROM (SELECT unnest(range(125)) AS i)),
q AS (SELECT 0.8 AS w, 0.0 AS a, 0.6 AS b, 0.0 AS c)
SELECT x, y, z, CAST(round(round((1 - 2 * (b * b + c * c)) * x + 2 * (a * b - w * c) * y + 2 * (a * c + w * b) * z, 9)) AS BIGINT) AS rx,
CAST(round(round(2 * (a * b + w * c) * x + (1 - 2 * (a * a + c * c)) * y + 2 * (b * c - w * a) * z, 9)) AS BIGINT) AS ry,
CAST(round(round(2 * (a * c - w * b) * x + 2 * (b * c + w * a) * y + (1 - 2 * (a * a + b * b)) * z, 9)) AS BIGINT) AS rz FROM v, q"""
)
def offsets_rotate3d(spark, d):
    x, y, z = (c - 2 for c in C.coordinates(F.col("id"), [5, 5, 5]))
    v = spark.range(125).select(x.alias("x"), y.alias("y"), z.alias("z"))
    r = C.rotated_3d([F.col("x"), F.col("y"), F.col("z")], [F.lit(q) for q in (1.6, 0.0, 1.2, 0.0)])
    return v.select("x", "y", "z", *[c.alias(n) for c, n in zip(r, ("rx", "ry", "rz"), strict=True)])


@query(f"WITH {T.PART}, u AS (SELECT cell, {T.unit('9', 'cell')} AS u FROM g) SELECT cell, round(round(round((30 + (2 * u - 1) * 10) / 1.0, 9)) * 1.0, 6) + 0.0 AS angle, round(round(round((0 + (2 * u - 1) * 0.3) / 0.05, 9)) * 0.05, 6) + 0.0 AS log_scale FROM u")
def transform_tolerance(spark, d):
    """Per-cell angle and log-scale drawn within a tolerance, in whole quanta."""
    u = C.uniform(9, F.col("cell"))
    return T.part(spark, d).select("cell", F.round(C.tolerance_draw(F.lit(30.0), F.lit(10.0), u, 1.0), 6).alias("angle"), (F.round(C.tolerance_draw(F.lit(0.0), F.lit(0.3), u, 0.05), 6) + 0.0).alias("log_scale"))


@query(f"WITH {T.PART} SELECT cell, {T.unit('1', 'cell')} AS u, CAST(floor({T.unit('1', 'cell')} * 4294967295.0) AS BIGINT) AS seed FROM g")
def hash_uniform(spark, d):
    u = C.uniform(1, F.col("cell"))
    return T.part(spark, d).select("cell", u.alias("u"), C.seed_from_unit(u).alias("seed"))


@query(f"WITH {T.STACK}, n AS (SELECT count(DISTINCT ti) AS n FROM g) SELECT ti, cell, cell * n + ti AS packed, (cell * n + ti) // n AS cell_again, (cell * n + ti) % n AS ti_again FROM g, n")
def provenance_pack(spark, d):
    g = T.stack(spark, d)
    n = g.agg(F.count_distinct("ti")).first()[0] or 1
    cell, ti = C.unpack(F.col("packed"), n)
    return g.select("ti", "cell", C.pack(F.col("cell"), F.col("ti"), n).alias("packed")).withColumns({"cell_again": cell, "ti_again": ti})


@query(
    """WITH RECURSIVE s(n) AS (SELECT CAST(x AS BIGINT) FROM (VALUES (1), (11), (13)) v(x) UNION SELECT n * p FROM s, (VALUES (2), (3), (5), (7)) q(p) WHERE n * p <= 600)
SELECT i AS n, (SELECT min(n) FROM s WHERE n >= i) AS size FROM (SELECT unnest(range(1, 501)) AS i)"""
)
def fft_sizes(spark, d):
    """For sizes 1 to 500 the next one whose factors suit a fast transform."""
    good = spark.range(1, 601).where(C.smooth(F.col("id"))).agg(F.sort_array(F.collect_list("id")).alias("good"))
    return spark.range(1, 501).join(F.broadcast(good)).select(F.col("id").alias("n"), F.element_at(F.filter("good", lambda g: g >= F.col("id")), 1).alias("size"))
