"""Grids made of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_WIDTH, ORDER_WIDTH, HOURS, DAYS = 40, 120, 24, 30
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(key: str, width: int) -> list:
    return [F.col(key).alias("cell"), F.pmod(F.col(key), F.lit(width)).alias("x"), F.floor(F.col(key) / width).cast("long").alias("y")]


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a grid 40 wide: size and price continuous, brand and type categorical."""
    return read(spark, sf_dir, "part").select(*_at("p_partkey", PART_WIDTH), "p_size", "p_retailprice", "p_brand", "p_type")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a grid 120 wide: status and priority categorical, price continuous."""
    return read(spark, sf_dir, "orders").select(*_at("o_orderkey", ORDER_WIDTH), "o_orderstatus", "o_orderpriority", "o_totalprice")


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a stack of images of 8 x 8 cells, values in thousandths."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ti"), "label", F.posexplode("embedding").alias("pos", "v"))
    cell = F.col("pos").cast("long")
    return e.select("ti", "label", cell.alias("cell"), F.pmod(cell, F.lit(8)).alias("x"), F.floor(cell / 8).cast("long").alias("y"), F.floor(F.col("v").cast("double") * 1000).cast("long").alias("v"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and day of January 2024, one variable per type: their number. Hours without events are holes."""
    e = read(spark, sf_dir, "events").select(F.hour("ts").cast("long").alias("x"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("y"), "event_type")
    e = e.groupBy("x", "y", "event_type").agg(F.count("*").alias("n"))
    return e.select((F.col("x") + HOURS * F.col("y")).alias("cell"), "x", "y", "event_type", "n")


def height(grid: DataFrame) -> int:
    return int((grid.agg(F.max("y")).first()[0] or 0) + 1)


PART = f"g AS (SELECT p_partkey AS cell, p_partkey % {PART_WIDTH} AS x, p_partkey // {PART_WIDTH} AS y, p_size, p_retailprice, p_brand, p_type FROM part), dim AS (SELECT max(y) + 1 AS h FROM g)"
ORDERS = f"g AS (SELECT o_orderkey AS cell, o_orderkey % {ORDER_WIDTH} AS x, o_orderkey // {ORDER_WIDTH} AS y, o_orderstatus, o_orderpriority, o_totalprice FROM orders), dim AS (SELECT max(y) + 1 AS h FROM g)"
STACK = "g AS (SELECT ti, label, CAST(i - 1 AS BIGINT) AS cell, CAST((i - 1) % 8 AS BIGINT) AS x, CAST((i - 1) // 8 AS BIGINT) AS y, CAST(floor(CAST(e[i] AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id AS ti, label, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
EVENTS = f"g AS (SELECT x + {HOURS} * y AS cell, x, y, event_type, n FROM (SELECT hour(ts) AS x, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS y, event_type, count(*) AS n FROM events GROUP BY ALL))"


def unit(*parts: str) -> str:
    """SQL of :func:`lacuna.functions.cells.uniform`."""
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296.0)"
