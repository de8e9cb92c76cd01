"""Splitting a simulation over a grid of jobs: owners, neighbours, halos and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def global_order(local: Column, jobs: int, position: Column) -> Column:
    """Orders of all jobs interleave: local order * number of jobs + position of the job."""
    return (local * jobs + position).cast("long")


def owner(order: Column, jobs: int) -> Column:
    return F.pmod(order, F.lit(jobs)).cast("long")


def flatten_jobs(grids: DataFrame, text: str = "grid") -> DataFrame:
    """(id, r, c, position, job) of a job grid given as JSON rows; position counts row by row."""
    rows = grids.select("id", F.posexplode(F.from_json(text, "array<array<long>>")).alias("r", "row"))
    width = rows.select("id", "r", F.size("row").alias("w"), F.posexplode("row").alias("c", "job"))
    return width.select("id", "r", "c", (F.col("r") * F.col("w") + F.col("c")).alias("position"), "job")


def job_grid_faults(jobs: DataFrame) -> DataFrame:
    """id, ragged, repeated for grids that can't be run: rows of unequal length, or a job at two places."""
    rows = jobs.groupBy("id", "r").agg(F.count("*").alias("w"))
    ragged = rows.groupBy("id").agg((F.min("w") != F.max("w")).alias("ragged"))
    twice = jobs.groupBy("id", "job").agg(F.count("*").alias("n")).groupBy("id").agg((F.max("n") > 1).alias("repeated"))
    return ragged.join(twice, "id").where("ragged or repeated")


def job_neighbours(jobs: DataFrame) -> DataFrame:
    """Pairs of jobs whose places differ by one at most along each axis, by eight shifts and an equi-join."""
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    out = jobs.select("id", "job", "r", "c", F.explode(steps).alias("s")).select("id", "job", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    return out.join(jobs.select("id", "r", "c", F.col("job").alias("neighbour")), ["id", "r", "c"]).select("id", "job", "neighbour")


def halo(blocks: DataFrame, width: int, height: int, margin: int) -> DataFrame:
    """What each block (bx, by, x, y within the block, value) sees of its neighbours: their cells within ``margin``.

    Every cell is sent to the neighbours whose padded extent holds it; coordinates count from the receiver.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("sx"), F.lit(b).alias("sy")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    sent = blocks.select("*", F.inline(steps)).withColumns({"rx": F.col("x") - F.col("sx") * width, "ry": F.col("y") - F.col("sy") * height, "tx": F.col("bx") + F.col("sx"), "ty": F.col("by") + F.col("sy")})
    seen = F.col("rx").between(-margin, width + margin - 1) & F.col("ry").between(-margin, height + margin - 1)
    there = blocks.select(F.col("bx").alias("tx"), F.col("by").alias("ty")).distinct()
    return sent.where(seen).join(there, ["tx", "ty"]).select(F.col("tx").alias("bx"), F.col("ty").alias("by"), F.col("rx").alias("x"), F.col("ry").alias("y"), "value")


def receive(padded: DataFrame, updates: DataFrame, jobs: int) -> DataFrame:
    """The cells of ``padded`` (order, further columns) that an update (order, value) reaches, with its value.

    A cell's owner follows from its order. Both sides are dealt by owner and order, so what one job sends is spread
    over all tasks, too. Several updates of one order give as many rows; :func:`first_writer` leaves one.
    """
    mine = padded.withColumn("owner", owner(F.col("order"), jobs))
    return mine.join(updates.select(owner(F.col("order"), jobs).alias("owner"), "order", "value"), ["owner", "order"])


def first_writer(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Of several updates of one cell the earliest counts; later ones are ignored."""
    rest = [c for c in updates.columns if c not in (key, order)]
    first = updates.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("f"))
    return first.select(key, *[F.col(f"f.{c}").alias(c) for c in (order, *rest)])
