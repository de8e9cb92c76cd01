"""MinHash near-duplicate detection: universal minima, banding, verification, star components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import drop, has_rows, materialise
from .components import connected_components

BANDS, ROWS = 48, 5


def minima(sets: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` minima of one set under the universal hashes a * x + b modulo 2**32, a odd."""
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 31, (count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, (count, 1), dtype=np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(x), 512):
        value = a * x[None, lo : lo + 512]
        value += b
        np.minimum(out, value.min(axis=1), out=out)
    return out


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 5-word shingle hashes of every text."""
    data, offsets = _text.utf8(column)
    for a, b in _text.pieces(offsets):
        off = offsets[a : b + 1]
        hashes, count = _text.shingles(*_text.words(data[off[0] : off[-1]], off - off[0]))
        ends = np.cumsum(count)
        for e, n in zip(ends, count, strict=True):
            yield np.unique(hashes[e - n : e]) if n else hashes[:0]


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _text.powers(0xA24BAED4963EE407, rows + 1)[1:]
        salt = _text.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            size, k1, k2, keys, codes = [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                size.append(len(s))
                k1.append(s.sum(dtype=np.uint64) if len(s) else 0)
                k2.append(_text.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0)
                if len(s):
                    low = minima(s, bands * rows)
                    codes.append((low & np.uint32(255)).astype(np.uint8).tobytes())
                    low = _text.mix(low.astype(np.uint64)).reshape(bands, rows)
                    keys.append(_text.mix((low * weights).sum(axis=1, dtype=np.uint64) ^ salt).view(np.int64))
                else:
                    codes.append(b"")
                    keys.append(np.zeros(0, np.int64))
            off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(codes, pa.binary()),
            ], ["doc_id", "n_shingles", "k1", "k2", "bands", "code"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["rep", "members"])


def _agree(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, code, code), the pairs whose signatures agree in ``least`` minima."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
        near = pa.array((x == y).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])


def _similar(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return denominator * common >= numerator * (len(both) - common)


def _verify(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), numerator, denominator) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _units(rows: DataFrame, payload: list[str], bound: int, block: int = 1024) -> DataFrame:
    """Deal rows (key, rep, label, ...) so that all of a key meet, but for two of its most frequent label.

    Rows of other labels (side 0) are cut into blocks, and so are all rows of the key (side 1); every two
    blocks meet in a unit of at most about 2 * ``block`` rows. Where nearly all rows of a large key bear
    one label, as after linking them to one of them, each is sent on to few units. Keys with a single
    label go. ``bound`` is a bound on the number of keys.
    """
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    keys = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("top.n < n")
    keys = keys.select("key", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / block).alias("xs"), F.ceil(F.col("n") / block).alias("ys"))
    at = rows.join(materialise(keys, bound), "key")
    x, y = F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("xs")), F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("ys"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    some = at.where("label <> top").select("key", x.alias("x"), every("ys").alias("y"), F.lit(0).alias("side"), "rep", "label", *payload)
    most = at.select("key", every("xs").alias("x"), y.alias("y"), F.lit(1).alias("side"), "rep", "label", *payload)
    return some.unionByName(most).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def _across(least: int, numerator: int, denominator: int):
    """Links between different labels of a unit, as many as join them: by signature, and by sets where given."""

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, label, size, side = (t.column(c).to_numpy() for c in ("rep", "label", "n_shingles", "side"))
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(rep), -1)
        sets = [np.frombuffer(m, np.uint64) for m in t.column("members").to_pylist()] if "members" in t.column_names else None
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = v = root.get(up, up)
            return v

        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[tuple[int, int]] = []
        for i in range(0, len(left), 32):
            l = left[i : i + 32]
            ok = label[l, None] != label[None, right]
            ok &= denominator * np.minimum(size[l, None], size[None, right]) >= numerator * np.maximum(size[l, None], size[None, right])
            x, y = np.nonzero(ok)
            for at in range(0, len(x), 1 << 14):
                u, v = l[x[at : at + (1 << 14)]], right[y[at : at + (1 << 14)]]
                common = (code[u] == code[v]).sum(axis=1)
                for k in np.argsort(-common, kind="stable"):
                    if common[k] < least:
                        break
                    a, b = find(int(label[u[k]])), find(int(label[v[k]]))
                    if a != b and (sets is None or _similar(sets[u[k]], sets[v[k]], numerator, denominator)):
                        root[max(a, b)] = min(a, b)
                        out.append((int(rep[u[k]]), int(rep[v[k]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            key, x, y = (t.column(c).to_numpy() for c in ("key", "x", "y"))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield from links(t.slice(a, b - a))
            rest = t.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from links(rest)

    return run


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id long, text string).

    Documents with equal shingle sets form a class, whose smallest doc_id stands for it. ``bands`` x
    ``rows`` minima are banded. Signatures of a bucket's classes are compared with that of its smallest
    one, and what differs from that with all of the bucket. Pairs that nearly agree are confirmed on the
    full sets: denominator * intersection >= numerator * union. Where that leaves a cluster of such pairs
    in several components, those outside its largest component are compared with all of the cluster,
    again on full sets. A pair at the threshold of 0.75 shares no bucket with probability
    (1 - 0.75**5)**48 = 2e-6, and falls short of the signature test, 5.5 standard deviations below, with 2e-8.

    Null, empty and blank texts: set size 0, own component, kept. Null doc_id: never linked, component
    null, kept. Repeated doc_ids: one node; all their texts share its component. Empty table: no rows.
    Very long texts are hashed whole, in runs of bounded size; ties of sets go to the smallest doc_id.
    Other columns of ``docs`` are ignored.
    """
    count, share = bands * rows, numerator / denominator
    least = int(count * share - 5.5 * (count * share * (1 - share)) ** 0.5)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(docs.mapInArrow(_signatures(bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, code binary"))
    n = signed.count()
    keyed = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("code").alias("code")), n, 8_000)
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("same")).where("n > 1")
    once = shared.groupBy("n", "same").agg(F.min("band").alias("band"), F.min("pivot").alias("pivot")).select("band", "pivot")
    members = materialise(buckets.join(once, "band").select("band", "rep", "pivot"), n, 8_000)
    met = members.count()

    codes = classes.select("rep", "code")
    star = members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    star = star.join(codes.select(F.col("rep").alias("a"), F.col("code").alias("x")), "a").join(codes.select(F.col("rep").alias("b"), F.col("code").alias("y")), "b")
    near = materialise(star.select("a", "b", "x", "y").mapInArrow(lambda it: _agree(it, least), "a long, b long"), met, 20_000)
    label = F.when(F.col("agrees"), F.col("pivot")).otherwise(F.col("rep"))
    labelled = members.join(near.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), F.lit(True).alias("agrees")), ["rep", "pivot"], "left").select(F.col("band").alias("key"), "rep", label.alias("label"))
    payload = ["n_shingles", "code"]
    rest = _units(labelled.join(classes.select("rep", *payload), "rep"), payload, met).mapInArrow(_across(least, numerator, denominator), "a long, b long")
    pairs = materialise(near.unionByName(rest).distinct(), met)
    linked = pairs.count()

    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = materialise(docs.join(ids, docs["doc_id"] == ids["rep"], "left_semi").select("doc_id", "text").mapInArrow(_sets, "rep long, members binary"), 2 * linked, 5000)
    left, right = sets.select(F.col("rep").alias("a"), F.col("members").alias("x")), sets.select(F.col("rep").alias("b"), F.col("members").alias("y"))
    links = materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(numerator, denominator), "a long, b long"), linked, 1000)
    named = keyed.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    split = named.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id").join(named, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    cc = materialise(connected_components(links.unionByName(split), 2 * linked), 2 * linked)
    cluster = materialise(connected_components(pairs, linked).select(F.col("node").alias("rep"), F.col("component").alias("key")), 2 * linked)
    apart = cluster.join(cc.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    full = apart.join(classes.select("rep", *payload), "rep").join(sets, "rep")
    more = materialise(_units(full, [*payload, "members"], linked).mapInArrow(_across(least, numerator, denominator), "a long, b long"), linked, 1000)
    if has_rows(more):
        cc = materialise(connected_components(more.unionByName(cc.select(F.col("node").alias("a"), F.col("component").alias("b"))), 3 * linked), 2 * linked)
    place = materialise(classes.select("k1", "k2", "rep").join(cc.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component")), n)
    linkable = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.lit(True))
    small = materialise(signed.select("doc_id", "n_shingles", "k1", "k2", linkable.alias("linkable")), n)
    for done in (signed, classes, members, near, pairs, sets, links, cluster, more, cc):
        drop(done)
    out = small.join(place.withColumn("linkable", F.lit(True)), ["k1", "k2", "linkable"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, one for each doc_id; null doc_ids stay.

    Of rows that repeat a kept doc_id any one stays; null, empty and blank texts stay, texts of any length are judged
    whole, further columns of any name come through, and an empty table stays empty. Only the ids that go are joined, and
    those of which several rows stay.
    """
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.when(F.col("kept"), 1)).alias("n"), F.count("*").alias("rows"))
    ids = materialise(ids.where("n <> 1 or rows <> 1"), docs.count())
    out = docs.join(ids, "doc_id", "left_anti")
    if has_rows(again := ids.where("n >= 1")):
        out = out.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
