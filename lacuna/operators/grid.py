"""Grids: one row per cell with coordinates x, y and any number of variables; null is a hole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C

#: A template: (dx, dy, weight) by rank. It is a fixed list, expanded in every row.
Template = Sequence[tuple[int, int, float]]


def expand(template: Template) -> Column:
    """One row per offset: rank, dx, dy, w."""
    rows = [F.struct(F.lit(i + 1).alias("rank"), F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"), F.lit(float(w)).alias("w")) for i, (dx, dy, w) in enumerate(template)]
    return F.inline(F.array(*rows))


def wrap_delta(cells: DataFrame, template: Template, width: int, height: int, axes: Sequence[int] | None = None) -> DataFrame:
    """Every cell at every offset: the cell reached with wrapping, and whether it lay inside. No shuffle."""
    to, inside = C.shifted([F.col("x"), F.col("y")], [F.col("dx"), F.col("dy")], [width, height], axes)
    return cells.select("*", expand(template)).withColumns({"to": to, "inside": inside})


def frame(spark, width: int, height: int) -> DataFrame:
    """All cells of a rectangle."""
    x, y = C.coordinates(F.col("id"), [width, height])
    return spark.range(width * height).select(F.col("id").alias("cell"), x.alias("x"), y.alias("y"))


def pad(grid: DataFrame, width: int, height: int, margin: int, values: Sequence[str], fill) -> DataFrame:
    """The grid within a margin of ``fill``; cells are numbered anew. Holes of the grid are filled, too."""
    whole = frame(grid.sparkSession, width + 2 * margin, height + 2 * margin)
    moved = grid.select((F.col("x") + margin).alias("x"), (F.col("y") + margin).alias("y"), *values)
    return whole.join(moved, ["x", "y"], "left").select("cell", "x", "y", *[F.coalesce(v, F.lit(fill)).alias(v) for v in values])


def crop(grid: DataFrame, width: int, height: int, margin: int, values: Sequence[str]) -> DataFrame:
    """What lies at least ``margin`` from every edge, numbered anew."""
    inner = grid.where(F.col("x").between(margin, width - margin - 1) & F.col("y").between(margin, height - margin - 1))
    x, y = F.col("x") - margin, F.col("y") - margin
    return inner.select(C.index([x, y], [width - 2 * margin, height - 2 * margin]).alias("cell"), x.alias("x"), y.alias("y"), *values)


def holes(grid: DataFrame, width: int, height: int, value: str) -> DataFrame:
    """Cells of the rectangle with no row or a null value."""
    return frame(grid.sparkSession, width, height).join(grid.where(F.col(value).isNotNull()).select("x", "y"), ["x", "y"], "left_anti").select("cell", "x", "y")


def all_or_nothing(grid: DataFrame, values: Sequence[str]) -> DataFrame:
    """A row with a null in any variable gets nulls in all."""
    whole = F.lit(True)
    for v in values:
        whole = whole & F.col(v).isNotNull()
    return grid.withColumns({v: F.when(whole, F.col(v)) for v in values})


def validate(grid: DataFrame, width: int, height: int) -> DataFrame:
    """Counts that tell whether a grid is whole: cells, distinct cells, cells outside, cells missing."""
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    out = grid.agg(F.count("*").alias("n_cells"), F.count_distinct("x", "y").alias("n_distinct"), F.count(F.when(~inside, 1)).alias("n_outside"))
    return out.withColumn("n_missing", F.lit(width * height).cast("long") - F.col("n_distinct") + F.col("n_outside"))


def one_hot(grid: DataFrame, column: str, categories: Sequence, prefix: str) -> DataFrame:
    return grid.withColumns({f"{prefix}{i}": F.when(F.col(column) == c, 1).otherwise(0) for i, c in enumerate(categories)})


def moments(grid: DataFrame, column: str) -> DataFrame:
    """Layers for the sums of a squared difference: valid, value and square, holes as zero."""
    v = F.coalesce(F.col(column), F.lit(0))
    return grid.select("cell", F.when(F.col(column).isNotNull(), 1).otherwise(0).alias("valid"), v.alias("value"), (v * v).alias("square"))


def center_distance(grid: DataFrame, width: int, height: int) -> DataFrame:
    dx, dy = F.col("x") - (width - 1) // 2, F.col("y") - (height - 1) // 2
    return grid.withColumn("d2", dx * dx + dy * dy)


def neighbours(targets: DataFrame, grid: DataFrame, template: Template, width: int, height: int, circular: bool = False) -> DataFrame:
    """Values found at the template's offsets around targets (cell, x, y), joined by the cell reached.

    ``targets`` may be all cells; the join is one shuffle on the cell number whatever the template's size. The grid is never
    broadcast, however small its file: a million cells of a few megabytes take hundreds of them as a hash table.
    """
    around = wrap_delta(targets, template, width, height)
    if not circular:
        around = around.where("inside")
    return around.drop("inside").join(grid.withColumnRenamed("cell", "to").hint("merge"), "to")


def patterns(grid: DataFrame, template: Template, values: Sequence[str], width: int, height: int, circular: bool = False) -> DataFrame:
    """(cell, p): for every cell the array of all variables at all offsets, offset by offset; null where none.

    Gathered by conditional aggregates, so only what an offset finds is shuffled.
    """
    found = neighbours(grid.select("cell", "x", "y"), grid.select("cell", *values), template, width, height, circular)
    at = [F.max(F.when(F.col("rank") == i + 1, F.col(v))).cast("double") for i in range(len(template)) for v in values]
    got = found.groupBy("cell").agg(F.array(*at).alias("p"))
    none = F.array(*[F.lit(None).cast("double")] * (len(template) * len(values)))
    return grid.select("cell").join(got, "cell", "left").select("cell", F.coalesce("p", none).alias("p"))
