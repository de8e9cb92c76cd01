"""Prefix-count trees of categorical patterns: building, merging and looking up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Template, neighbours


def levels(x: Column, y: Column, top: int) -> Column:
    """The coarsest grid level that has the cell: the largest l <= top with both coordinates multiples of 2**l."""
    out = F.lit(0)
    for level in range(1, top + 1):
        out = F.when((F.pmod(x, F.lit(1 << level)) == 0) & (F.pmod(y, F.lit(1 << level)) == 0), level).otherwise(out)
    return out.cast("int")


def templates(grid: DataFrame, template: Template, value: str, width: int, height: int) -> DataFrame:
    """(cell, center, codes): the categories around every cell, by rank, joined by dots; only complete ones."""
    found = neighbours(grid.where(F.col(value).isNotNull()).select("cell", "x", "y", F.col(value).alias("center")), grid.where(F.col(value).isNotNull()).select("cell", F.col(value).alias("v")), template, width, height)
    codes = [F.max(F.when(F.col("rank") == i + 1, F.col("v"))) for i in range(len(template))]
    full = found.groupBy("cell").agg(F.max("center").alias("center"), F.count("*").alias("n"), F.array(*codes).alias("codes"))
    return full.where(F.col("n") == len(template)).select("cell", "center", "codes")


def build(complete: DataFrame, depth: int) -> DataFrame:
    """(depth, prefix, class, n): how often each beginning of a pattern occurs around each class.

    Patterns are counted whole first, so the expansion into beginnings starts from distinct patterns.
    """
    whole = complete.groupBy("codes", "center").agg(F.count("*").alias("n"))
    cut = whole.select("codes", "center", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    prefix = F.array_join(F.slice("codes", F.lit(1), F.col("depth")), ".")
    return cut.groupBy("depth", prefix.alias("prefix"), F.col("center").alias("class")).agg(F.sum("n").alias("n"))


def merge(trees: Sequence[DataFrame], most: int = (1 << 32) - 1) -> DataFrame:
    """The sum of trees, counts held at ``most``."""
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out.groupBy("depth", "prefix", "class").agg(F.least(F.sum("n"), F.lit(most)).alias("n"))


def deepest(tree: DataFrame, known: DataFrame) -> DataFrame:
    """Counts by class at the greatest depth that the known neighbours of each target reach.

    ``known`` has target and codes (by rank; null where a neighbour isn't known). Known codes follow one
    child, unknown ones all. Level by level the prefixes reached so far are joined with the tree's nodes, so
    a branch that leaves the tree ends, and its counts at lesser depth don't count where another goes on.
    The tree and what each level reaches are written once, so that no level is planned again by those after it.
    """
    from ..sources.store import materialise

    tree = materialise(tree)
    nodes = tree.groupBy("depth", "prefix").agg(F.sum("n").alias("total"))
    depth = int(tree.agg(F.max("depth")).first()[0] or 0)
    parts = nodes.where("depth > 0").select("depth", "prefix", F.regexp_replace("prefix", r"\.?[^.]*$", "").alias("parent"), F.regexp_extract("prefix", r"([^.]*)$", 1).alias("last"))
    reached = known.select("target", "codes", F.lit(0).alias("depth"), F.lit("").alias("prefix"))
    every = reached
    for d in range(1, depth + 1):
        step = parts.where(F.col("depth") == d).select("parent", "last", F.col("prefix").alias("next"))
        code = F.element_at("codes", d)
        reached = materialise(reached.join(step, reached["prefix"] == step["parent"]).where(code.isNull() | (code == F.col("last"))).select("target", "codes", F.lit(d).alias("depth"), F.col("next").alias("prefix")))
        every = every.unionByName(reached)
    top = every.groupBy("target").agg(F.max("depth").alias("depth"))
    return every.join(top, ["target", "depth"]).join(tree, ["depth", "prefix"]).groupBy("target", "depth", "class").agg(F.sum("n").alias("n"))


def check_categories(values: DataFrame, allowed: DataFrame) -> DataFrame:
    """How many values are null, not whole, and unknown to ``allowed`` (value)."""
    known = allowed.select("value").distinct().withColumn("known", F.lit(True))
    v = values.join(known, "value", "left")
    whole = F.abs(F.col("value") - F.round("value")) <= 1e-5
    return v.agg(F.count("*").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"), F.count(F.when(~whole, 1)).alias("n_not_whole"), F.count(F.when(F.col("value").isNotNull() & F.col("known").isNull(), 1)).alias("n_unknown"))
