"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, materialise


def _star(edges: DataFrame, both: bool, rows: int) -> DataFrame:
    """One star step over (u, v) with u > v.

    Large-star (``both``) links every larger neighbour of a node to the smallest of node and
    neighbours; small-star links the node and its smaller neighbours to the smallest of them. Only a
    minimum per node is gathered (combined before the shuffle), never a list of neighbours.
    """
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    # written first: a join of two plain exchanges lets Spark split the arcs of a node with very many
    least = materialise(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows)
    out = arcs.join(least, "u")
    if both:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame, rows: int | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long), component being its smallest node.

    Links to itself, repeated links and nulls are allowed; a node that has only links to itself or to
    null does not occur in the result. Each round is written to the shared folder. Rounds grow with the
    logarithm of the longest path; ``rows`` may give a bound on the links;
    ``most_rounds`` guards against a fault and raises when reached.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct(), rows)
    before, most = None, 2 * edges.count()
    for _ in range(most_rounds):
        large = materialise(_star(edges, True, most), most)
        small = materialise(_star(large, False, most), most)
        drop(edges)
        drop(large)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"connected_components did not settle in {most_rounds} rounds")
