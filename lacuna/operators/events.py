"""Data events: the informed neighbours of cells along a simulation path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells as C
from .grid import Template, neighbours

HARD = -1


def random_path(cells: DataFrame, seed: int, segment_bits: int = 12) -> DataFrame:
    """cells with ``ord``, a permutation that depends on cell numbers and the seed only.

    Numbers are drawn by hash and ranked in two steps, within ranges of the hash and over the ranges, so
    no task holds the whole path.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell").cast("string")))
    drawn = cells.withColumns({"_h": h, "_part": F.substring(h, 1, segment_bits // 4)})
    size = drawn.groupBy("_part").agg(F.count("*").alias("_n"))
    before = size.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy("_h", "cell")) - 1
    return drawn.withColumn("_within", within).join(before, "_part").withColumn("ord", (F.col("_before") + F.col("_within")).cast("long")).drop("_h", "_part", "_n", "_before", "_within")


def gather(targets: DataFrame, grid: DataFrame, template: Template, width: int, height: int, circular: bool = False, strict: bool = True) -> DataFrame:
    """Neighbours of targets (cell, x, y, ord) that are informed before them: hard data or earlier on the path.

    ``grid`` has cell, ord (``HARD`` for hard data, null for cells never visited) and values. Strict asks for
    an earlier order, otherwise the same will do.
    """
    found = neighbours(targets.withColumnRenamed("ord", "own"), grid, template, width, height, circular)
    return found.where(F.col("ord") < F.col("own") if strict else F.col("ord") <= F.col("own"))


def nearest(found: DataFrame, n: Column | int, value: str | None = None) -> DataFrame:
    """The first n informed neighbours by rank of each cell (and of each variable, if ``value`` is a long key)."""
    keys = ["cell", *([value] if value else [])]
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("rank"))
    return found.withColumn("nth", nth.cast("int")).where(F.col("nth") <= n)


def dependency_levels(found: DataFrame, cells: DataFrame, most: int = 10_000) -> DataFrame:
    """cell, level: 0 where no neighbour on the path comes before, else one more than the highest of those.

    Levels are what can be simulated at once. Each round settles the cells all of whose neighbours are
    settled and is written to the shared folder; rounds end when no level changes.
    """
    from ..sources.store import materialise

    edges = materialise(found.where(F.col("ord") >= 0).select("cell", F.col("to")).distinct())
    level = materialise(cells.select("cell").withColumn("level", F.lit(0)))
    for _ in range(most):
        up = edges.join(level.withColumnRenamed("cell", "to"), "to").groupBy("cell").agg((F.max("level") + 1).alias("up"))
        new = materialise(level.join(up, "cell", "left").select("cell", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        if new.agg(F.sum("level")).first() == level.agg(F.sum("level")).first():
            return new
        level = new
    raise RuntimeError("dependencies have a cycle")


def choose_kernel(found: DataFrame, kernels: DataFrame, n: int, seed: int) -> DataFrame:
    """For every cell the kernel (kernel, rank, dx, dy) that finds n informed neighbours soonest.

    ``found`` has cell, dx, dy of informed neighbours. Ties: the one that finds more, then by hash.
    """
    from ..sources.store import small

    hits = found.join(small(kernels.select("kernel", "dx", "dy", F.col("rank").alias("at"))), ["dx", "dy"])
    nth = F.row_number().over(W.partitionBy("cell", "kernel").orderBy("at"))
    per = hits.withColumn("nth", nth).groupBy("cell", "kernel").agg(F.count("*").alias("n_found"), F.min(F.when(F.col("nth") == n, F.col("at"))).alias("reach"))
    best = F.row_number().over(W.partitionBy("cell").orderBy(F.col("reach").asc_nulls_last(), F.desc("n_found"), C.uniform(seed, F.col("cell"), F.col("kernel")), "kernel"))
    return per.withColumn("best", best).where("best = 1").select("cell", "kernel", "reach", "n_found")
