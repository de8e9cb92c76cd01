"""Text grids: a line with sizes, cell sizes and origin, the number of variables, their names, then a line per cell."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import small

#: What a variable's name begins with, by kind.
KINDS = ("Continuous", "Categorical")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, ...], tuple[int, ...]]:
    """(cell, v: array) of one file, its sizes and the kinds of its variables. NaN is null.

    The three header lines are the first of the first file. Lines are numbered by their order in each split and the
    number of lines in the splits before, without gathering them; the file may not change meanwhile.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("id"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("split"))
    top = [r.line for r in lines.orderBy("split", "id").limit(3).collect()]
    sizes = tuple(int(v) for v in top[0].split()[:3])
    kinds = tuple(KINDS.index(re.sub(r"_\d+$", "", n)) for n in top[2].split())
    if len(kinds) != int(top[1]):
        raise ValueError("the number of variables differs from their names")
    splits = lines.groupBy("split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("split")) - F.col("n")  # one row per split, some hundred MB of the file
    splits = splits.select("split", (before - F.col("first") - 3).alias("shift"))
    df = lines.join(small(splits), "split").select((F.col("id") + F.col("shift")).alias("cell"), "line").where("cell >= 0 and line <> ''")
    numbers = F.transform(F.split("line", r"\s+"), lambda x: F.when(F.lower(x).isin("nan", "-nan"), None).otherwise(x.cast("double")))
    return df.select("cell", numbers.alias("v")), sizes, kinds


def write(grid: DataFrame, path: str, sizes: Sequence[int], kinds: Sequence[int]) -> None:
    """Write (cell, v: array) as one text file per partition in order of cell, with the header in the first.

    The lines are sorted by range, so a reader that takes the files in order gets the cells in order.
    """
    spark = grid.sparkSession
    x, y, z = (*sizes, 1, 1)[:3]
    head = [f"{x} {y} {z} 1.0 1.0 1.0 0.0 0.0 0.0", str(len(kinds)), " ".join(f"{KINDS[k]}_{i}" for i, k in enumerate(kinds))]
    top = spark.createDataFrame([(i - 3, line) for i, line in enumerate(head)], "cell long, value string")
    number = lambda v: F.when(v.isNull(), "nan").otherwise(F.format_string("%.6f", v))
    lines = grid.select("cell", F.array_join(F.transform("v", number), " ").alias("value"))
    top.unionByName(lines).repartitionByRange("cell").sortWithinPartitions("cell").select("value").write.text(path)
