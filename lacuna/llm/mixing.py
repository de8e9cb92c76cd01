"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import materialise

#: Points are multiples of the golden ratio's fraction, in units of 2**-31.
POINTS, GOLDEN = 1 << 31, 1327217885
CELLS, SEGMENT, MARGIN = 4096, 8192, 8
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    """Number of runs of bytes other than 0x20 and 0x09-0x0D; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """src (rank by code point, null last), source, source_size, target from (source, source_size).

    Targets are proportional to the weights unless that exceeds ``cap`` times a source's size. In
    order of size by weight, the sources before the first that stays below its cap are the capped ones.
    The windows here run over one row per source, not over documents.
    """
    by = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1)
    s = sizes.select("source", "source_size", F.row_number().over(by).cast("int").alias("src")).withColumn("w", weight.cast("double"))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    order = W.orderBy(F.col("most") / F.col("w"), "src")
    before = F.sum("most").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("most")
    after = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - before) / after)
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "src", "level"))).over(W.partitionBy())["level"]
    return s.withColumn("target", F.coalesce(F.least("most", F.col("w") * level), "most")).select("src", "source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 256) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of ``docs`` (doc_id, text, source).

    A source's documents, in the order of a digest, form a stream of words that may be read ``cap``
    times (a whole number of passes) and is cut into blocks of ``block`` words. Slot i of the schedule falls at the point i * golden
    ratio modulo 1, which the cumulated targets map to a source; the k-th slot of a source takes its k-th
    block. A source's last block is cut at its target, so ``taken`` sums to the rounded target. Every
    source's share has a margin of ``MARGIN`` blocks, more than the points' discrepancy.

    Ranks and running sums go through segments and digest buckets, never through one window per source.
    Null and empty texts: size 0, taken 0. Null sources form one source, the last. Null and repeated
    doc_ids and repeated rows: each row is a document; rows that tie in their digest are equal and take what equal
    places take. Very long texts are counted whole. Empty table: no rows. Other columns are ignored.
    """
    k = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    sized = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), k.alias("k"), words(F.col("text").cast("string")).alias("size")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    part = F.when(F.col("target") > 0, F.ceil("target") + MARGIN * block).otherwise(0)
    cum = F.sum("part").over(W.orderBy("src").rowsBetween(W.unboundedPreceding, W.currentRow))
    s = targets.withColumn("part", part.cast("long")).withColumn("top", cum).withColumn("all", F.sum("part").over(W.partitionBy()))
    at = lambda c: F.floor(F.try_divide(c.cast("double"), F.col("all").cast("double")) * F.lit(float(POINTS))).cast("long")
    words_ = F.floor(F.col("target") + 0.5).cast("long")
    s = materialise(s.select("src", "source", "source_size", "target", words_.alias("quota"), at(F.col("top") - F.col("part")).alias("low"), at(F.col("top")).alias("high"), "all"), 0)
    n, total = s.agg(F.count("*"), F.max("all")).first()
    small = F.broadcast if n <= BROADCAST_SOURCES else (lambda d: d)

    cell = POINTS // CELLS
    cells = s.where("high > low").select("src", "quota", "low", "high", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))).alias("cell"))
    point = F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * F.lit(GOLDEN), F.lit(POINTS))
    slots = docs.sparkSession.range(-(-(total or 0) // block)).withColumn("point", point).withColumn("cell", F.expr(f"point div {cell}"))
    slots = slots.join(small(cells), "cell").where("point >= low and point < high").select("src", "quota", "id", F.expr(f"id div {SEGMENT}").alias("segment"))
    ahead = slots.groupBy("src", "segment").agg(F.count("*").alias("n"))
    ahead = ahead.select("src", "segment", (F.sum("n").over(W.partitionBy("src").orderBy("segment")) - F.col("n")).alias("ahead"))
    within = F.row_number().over(W.partitionBy("src", "segment").orderBy("id")) - 1
    slots = slots.withColumn("within", within).join(ahead, ["src", "segment"]).select("src", "quota", (F.col("ahead") + F.col("within")).alias("r"))
    slots = slots.where(F.col("r") * block < F.col("quota"))

    d = sized.join(small(s.select("src", "source", "source_size", "target", "quota")), sized["source"].eqNullSafe(s["source"])).select("doc_id", "k", "size", sized["source"], "src", "source_size", "target", "quota", F.substring("k", 1, 3).alias("bucket"))
    bucket = d.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    bucket = bucket.select("src", "bucket", (F.sum("n").over(W.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = W.partitionBy("src", "bucket").orderBy("k")
    run = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    d = d.withColumns({"run": run, "row": F.row_number().over(inside)}).join(bucket, ["src", "bucket"]).withColumn("start", F.col("before") + F.col("run"))

    passes = F.array(*[F.lit(p) for p in range(-int(-cap // 1))])
    p = d.where("size > 0").withColumn("pass", F.explode(passes)).withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
    p = p.withColumn("to", F.least(F.col("from") + F.col("size"), "quota")).where("from < to")
    p = p.select("src", "bucket", "row", "from", "to", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(to - 1) div {block}"))).alias("r"))
    words_taken = F.least("to", (F.col("r") + 1) * block) - F.greatest("from", F.col("r") * block)
    took = p.join(slots.select("src", "r"), ["src", "r"]).groupBy("src", "bucket", "row").agg(F.sum(words_taken).alias("taken"))
    out = d.join(took, ["src", "bucket", "row"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
