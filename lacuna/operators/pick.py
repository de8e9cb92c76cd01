"""Picking among ranked candidates, deterministic given a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells as C


def top_k(scored: DataFrame, k: int, largest: bool = True, ties: Column | None = None, by: str = "target") -> DataFrame:
    """The k best rows of each group with their rank; ties by hash if given, then by cell; null scores last."""
    order = [F.desc("score") if largest else F.asc_nulls_last("score"), *([ties] if ties is not None else []), F.asc("cell")]
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("int")).where(F.col("rank") <= k)


def nearest_levels(targets: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(target, cell, score): of all places (cell, group, value) of each target's group (target, group, value) but itself those whose
    difference in value is among the least that k places take up; ties are all there, to be ranked by whatever order.

    Targets are places themselves. Places are counted by value first, so a target meets its group's values and then only the places of those it needs.
    """
    level = places.groupBy("group", "value").agg(F.count("*").alias("_n"))
    t = targets.select("target", "group", F.col("value").alias("_own"))
    met = t.join(level, "group").withColumn("score", F.abs(F.col("_own") - F.col("value")))
    met = met.withColumn("_n", F.col("_n") - F.col("_own").eqNullSafe(F.col("value")).cast("int"))
    order = W.partitionBy("target").orderBy(F.asc_nulls_last("score"))
    before = met.withColumn("_upto", F.sum("_n").over(order.rangeBetween(W.unboundedPreceding, W.currentRow)))
    before = before.withColumn("_level", F.sum("_n").over(W.partitionBy("target", "score")))
    wanted = before.where((F.col("_n") > 0) & (F.col("_upto") - F.col("_level") < k)).select("target", F.col("group").alias("_group"), F.col("value").alias("_value"), "score")
    own = (F.col("group") == F.col("_group")) & F.col("value").eqNullSafe(F.col("_value"))
    return wanted.join(places.hint("merge"), own).where(F.col("target") != F.col("cell")).select("target", "cell", "score")


def fractional_k(ranked: DataFrame, k: float, u: Column) -> DataFrame:
    """One of the first ceil(k) ranks: each of the whole ones with probability 1 / k, the last with the rest."""
    return ranked.where(F.col("rank") == F.floor(u * k) + 1)


def by_weight(ranked: DataFrame, u: Column, weight: str, by: str = "target") -> DataFrame:
    """The first row, by rank, at which the cumulated weight reaches u times the total."""
    w = W.partitionBy(by)
    cum = F.sum(weight).over(w.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    hit = ranked.withColumns({"_c": cum, "_t": F.sum(weight).over(w)}).where(F.col("_c") >= u * F.col("_t"))
    return hit.withColumn("_first", F.row_number().over(w.orderBy("rank"))).where("_first = 1").drop("_c", "_t", "_first")


def first_accepted(scored: DataFrame, threshold: float, most: Column | int, by: str = "target") -> DataFrame:
    """The first place of the scan (column ``scan``, from 0) within the threshold; else the best of those scanned.

    Only the first ``most`` places count. One aggregate per target with two minima; no sort.
    """
    seen = scored.where(F.col("scan") < most)
    place = F.struct("scan", "cell", "score")
    best = F.min(F.struct("score", "scan", "cell"))
    out = seen.groupBy(by).agg(F.min(F.when(F.col("score") <= threshold, place)).alias("a"), best.alias("b"))
    pick = lambda f: F.when(F.col("a").isNotNull(), F.col(f"a.{f}")).otherwise(F.col(f"b.{f}")).alias(f)
    return out.select(by, pick("cell"), pick("score"), pick("scan"), F.col("a").isNotNull().alias("accepted"))


def scan_limit(count: Column, share: float) -> Column:
    """How many places are scanned: the share of all, rounded up, at least one, at most all."""
    return F.least(count, F.greatest(F.lit(1), F.ceil(count * share))).cast("long")


def category_draw(counts: DataFrame, u: Column, category: str, by: list[str]) -> DataFrame:
    """One category per group by inverse cumulative counts in order of category."""
    w = W.partitionBy(*by)
    cum = F.sum("n").over(w.orderBy(category).rowsBetween(W.unboundedPreceding, W.currentRow))
    hit = counts.withColumns({"_c": cum, "_t": F.sum("n").over(w)}).where(F.col("_c") > u * F.col("_t"))
    return hit.groupBy(*by).agg(F.min(category).alias(category))


def nth_of(values: DataFrame, order: str, segments: int = 64) -> DataFrame:
    """``values`` with ``nth``, their rank by a long column from 0, counted in ranges of it."""
    lo, hi = values.agg(F.min(order), F.max(order)).first()
    step = max(1, ((hi or 0) - (lo or 0)) // segments + 1)
    cut = values.withColumn("_part", C.div(F.col(order) - (lo or 0), step))
    size = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = size.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return cut.withColumn("_w", within).join(before, "_part").withColumn("nth", (F.col("_before") + F.col("_w")).cast("long")).drop("_part", "_w", "_before")


def marginal_draw(targets: DataFrame, values: DataFrame, value: str, seed: int) -> DataFrame:
    """For every target (cell) a value drawn from the informed cells of ``values`` (cell, value), uniformly."""
    informed = nth_of(values.where(F.col(value).isNotNull()).select("cell", value), "cell")
    n = informed.count()
    drawn = targets.withColumn("nth", F.floor(C.uniform(seed, F.col("cell")) * n).cast("long"))
    return drawn.join(informed.withColumnRenamed("cell", "source"), "nth").drop("nth")
