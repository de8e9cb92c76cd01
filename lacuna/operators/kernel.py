"""Weighting kernels and the order of their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells as C


def box(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All offsets of an odd box around its centre."""
    x, y = C.coordinates(F.col("id"), [width, height])
    return spark.range(width * height).select((x - width // 2).alias("dx"), (y - height // 2).alias("dy"))


def weight(kind: str, alpha: float = 1.0, level: float = 1.0) -> Column:
    """A kernel's weight at (dx, dy): uniform, exponential or gaussian in the distance from the centre."""
    d2 = (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")
    if kind == "uniform":
        return F.lit(float(level))
    if kind == "exponential":
        return F.exp(-alpha * F.sqrt(d2))
    if kind == "gaussian":
        return F.exp(-(alpha**2) * d2 / 2) / F.sqrt(F.lit(2 * C.PI))
    raise ValueError(f"no kernel of kind {kind!r}")


def ordered(offsets: DataFrame, by: str = "l2") -> DataFrame:
    """Rank of every offset but the centre: nearest first (l2, l1), or by weight; the rest of ties by dy, dx.

    The window spans a kernel, a table of fixed size.
    """
    key = {"l2": F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), "l1": F.abs("dx") + F.abs("dy"), "weight": -F.abs("w")}[by]
    rank = F.row_number().over(W.orderBy(key, "dy", "dx"))
    return offsets.where("dx <> 0 or dy <> 0").withColumn("rank", rank.cast("int"))


def per_category(offsets: DataFrame, categories: DataFrame, support: bool) -> DataFrame:
    """The kernel once for each category (slot), and one slot more for the support of incomplete images."""
    from ..sources.store import small

    slots = categories.select(F.row_number().over(W.orderBy("category")).cast("int").alias("slot"), F.col("category"))
    if support:
        slots = slots.unionByName(slots.agg((F.coalesce(F.max("slot"), F.lit(0)) + 1).cast("int").alias("slot")).withColumn("category", F.lit("support")))
    return slots.join(small(offsets)).select("dx", "dy", "w", "slot", "category")
