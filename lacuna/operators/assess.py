"""Assessing distributions: calibration errors, narrowness, votes and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Template, neighbours


def error_stats(errors: DataFrame, by: list[str], power: float = 2.0) -> DataFrame:
    """mean**(1/p), spread and number of the errors**p of each configuration."""
    e = F.pow(F.abs(F.col("error")), F.lit(float(power)))
    out = errors.groupBy(*by).agg(F.avg(e).alias("m"), F.avg(e * e).alias("m2"), F.count("*").alias("n"))
    spread = F.pow(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)), F.lit(0.5 / power))
    return out.select(*by, F.round(F.pow(F.col("m"), F.lit(1.0 / power)), 6).alias("mean_error"), F.round(spread, 6).alias("deviation"), "n")


def prune(stats: DataFrame, by: list[str], power: float, least: int) -> DataFrame:
    """Configurations still worth more rounds: not yet ``least`` measured, or not clearly worse than the best."""
    bound = F.min(F.col("mean_error") + F.col("deviation") / power).over(W.partitionBy(*by))
    return stats.withColumn("_b", bound).where((F.col("n") <= least) | (F.col("mean_error") - F.col("deviation") / power <= F.col("_b"))).drop("_b")


def narrowness(values: DataFrame, by: str, share: float = 0.5) -> DataFrame:
    """The spread of the middle ``share`` of each group's values: one sorted value minus another; nulls don't count.

    Values are counted before the shuffle and ranked by their cumulated counts, so no task holds a group's rows.
    """
    counted = values.where(F.col("value").isNotNull()).groupBy(by, "value").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.partitionBy(by).orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = counted.groupBy(by).agg(F.sum("m").alias("n"))
    hi = F.least(F.col("n"), F.floor((0.5 + share / 2) * F.col("n")) + 1)
    lo = F.least(F.col("n"), F.ceil((0.5 - share / 2) * F.col("n")) + 1)
    at = counted.withColumn("upto", upto).join(total, by)
    spread = F.min(F.when(F.col("upto") >= hi, F.col("value"))) - F.min(F.when(F.col("upto") >= lo, F.col("value")))
    return at.groupBy(by).agg(F.max("n").cast("int").alias("n"), spread.alias("spread"))


def votes(classes: DataFrame, by: str, planes: int, exponent: float = 1.5) -> DataFrame:
    """Class weights from the best candidates of several planes, (p / m)**exponent * m normalised to one."""
    per = classes.groupBy(by, "class").agg(F.count("*").alias("p"))
    m = F.lit(float(planes))
    raw = F.pow(F.col("p") / m, F.lit(exponent)) * m
    return per.withColumn("raw", raw).select(by, "class", "p", F.round(F.col("raw") / F.sum("raw").over(W.partitionBy(by)), 6).alias("share"))


def clean_singletons(grid: DataFrame, value: str, width: int, height: int, protected: DataFrame | None = None, least: int = 2) -> DataFrame:
    """cell, value: cells without an equal face neighbour take the commonest neighbour value, if frequent enough.

    The smallest of equally common values counts; the image before the pass is what is read; cells of
    ``protected`` stay.
    """
    faces: Template = [(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1)]
    near = neighbours(grid.where(F.col(value).isNotNull()).select("cell", "x", "y", F.col(value).alias("own")), grid.where(F.col(value).isNotNull()).select("cell", F.col(value).alias("v")), faces, width, height)
    common = near.groupBy("cell", "own", "v").agg(F.count("*").alias("n"))
    alone = common.groupBy("cell").agg(F.max(F.when(F.col("own") == F.col("v"), 1).otherwise(0)).alias("equal"), F.min(F.struct((-F.col("n")).alias("m"), F.col("v").alias("v"))).alias("top"))
    change = alone.where((F.col("equal") == 0) & (-F.col("top.m") >= least)).select("cell", F.col("top.v").alias("new"))
    if protected is not None:
        change = change.join(protected.select("cell"), "cell", "left_anti")
    return grid.join(change, "cell", "left").select("cell", F.coalesce("new", value).alias(value), F.col("new").isNotNull().alias("changed"))


def anchored(stack: DataFrame, targets: DataFrame, template: Template, width: int, height: int, power: float = 1.0, compensate: bool = False) -> DataFrame:
    """Scores of the images of an aligned stack at the targets' own place: (cell, ti, score).

    ``targets`` has cell, x, y, and the data event is what image ``ref`` holds around it. An image is matched
    at the same cells, by an equi-join on the cell. Complete: -(sum w |d|**p)**(1/p). Compensated: missing
    cells don't count, -|sum / support**4|, and images without support drop out.
    """
    around = neighbours(targets, stack.select("cell", "ti", F.col("v").alias("v")), template, width, height)
    mine = around.where(F.col("ti") == F.col("ref")).select("cell", "rank", F.col("v").alias("event"))
    pairs = around.where(F.col("ti") != F.col("ref")).select("cell", "rank", "w", "ti", "v").join(mine, ["cell", "rank"])
    gap = F.col("w") * F.pow(F.abs(F.col("v") - F.col("event")).cast("double"), F.lit(power))
    if compensate:
        got = pairs.where("v is not null and event is not null").groupBy("cell", "ti").agg(F.sum(gap).alias("s"), F.sum("w").alias("support"))
        return got.where("support > 0").select("cell", "ti", F.round(-F.abs(F.col("s") / F.pow("support", F.lit(4.0))), 6).alias("score"))
    got = pairs.where("event is not null").groupBy("cell", "ti").agg(F.sum(gap).alias("s"), F.count("*").alias("n"), F.count("v").alias("m"))
    return got.where("n = m").select("cell", "ti", F.round(-F.pow("s", F.lit(1 / power)), 6).alias("score"))


def admissible(scored: DataFrame, masks: DataFrame) -> DataFrame:
    """Only candidates (ti) with a finite, positive weight, which is kept."""
    ok = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    return scored.join(masks.where(ok), "ti")


def any_null(grid: DataFrame, values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | F.col(v).isNull()
    return F.coalesce(F.max(out), F.lit(False))
