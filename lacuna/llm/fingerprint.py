"""Homomorphic multiset hash of a text's paragraphs.

A paragraph (a line that is not empty) hashes to a wide vector of numbers; a text's fingerprint
is the sum of its paragraphs' vectors modulo 2**32. So it doesn't depend on their order, and paragraphs
are added and taken away by sums and differences. The first ``DENSE`` numbers are a BLAKE2b digest of the
paragraph and tell different texts apart. The other ``SKETCH`` numbers are the paragraph's word triples,
each counted with a sign in one place: from them follows how much two texts have in common.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import small_batches

DENSE, SKETCH = 32, 128
MOST_BUCKETS, BUCKET_ROWS = 16384, 1000


def vectors(texts: Sequence[bytes]) -> np.ndarray:
    """The fingerprints of UTF-8 texts, one row of DENSE + SKETCH uint32 each."""
    out = np.zeros((len(texts), DENSE + SKETCH), np.uint32)
    lines = [[x for x in t.split(b"\n") if x] for t in texts]
    per = np.array([len(x) for x in lines], np.int64)
    flat = [x for own in lines for x in own]
    if not flat:
        return out
    some = np.flatnonzero(per)
    dense = np.frombuffer(b"".join([hashlib.blake2b(x).digest() for x in flat]), np.uint16).reshape(-1, DENSE)
    out[some, :DENSE] = np.add.reduceat(dense, (np.cumsum(per) - per)[some], axis=0, dtype=np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
    data = np.frombuffer(b"".join(flat), np.uint8)
    owner = np.repeat(np.arange(len(texts)), per)
    for a, b in _text.pieces(offsets):
        off = offsets[a : b + 1]
        h, count = _text.shingles(*_text.words(data[off[0] : off[-1]], off - off[0], _text.RAW), 3)
        if len(h):
            first = int(owner[a])
            doc = np.repeat(owner[a:b], count) - first
            place = doc * SKETCH + (h & np.uint64(SKETCH - 1)).astype(np.int64)
            sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
            sums = np.bincount(place, sign, (int(doc[-1]) + 1) * SKETCH).reshape(-1, SKETCH).astype(np.int64)
            out[first : first + len(sums), DENSE:] += sums.astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of common word triples of rows of two fingerprints, 0 to 1: 1 - |a - b|² / (|a|² + |b|²)."""
    x, y = (v[:, DENSE:].astype(np.int32).astype(np.float64) for v in (a, b))
    gap = (a[:, DENSE:] - b[:, DENSE:]).astype(np.int32).astype(np.float64)
    total = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = 1 - (gap * gap).sum(axis=1) / np.maximum(total, 1)
    return np.where((a == b).all(axis=1), 1.0, np.where(total > 0, np.clip(near, 0, 1), 0.0))


def encode(rows: np.ndarray) -> list[str]:
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint32)


def change(fingerprint: str, added: Sequence[str] = (), removed: Sequence[str] = ()) -> str:
    """The fingerprint after paragraphs are added and removed, without the text."""
    v = decode(fingerprint) + vectors(["\n".join(added).encode()])[0] - vectors(["\n".join(removed).encode()])[0]
    return encode(v[None])[0]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (bucket, halo, doc_id, text); each with the one after it in its bucket."""
    held = None
    for batch in batches:
        rows = list(zip(batch.column("bucket").to_pylist(), batch.column("halo").to_pylist(), batch.column("doc_id").to_pylist(), (t or "" for t in batch.column("text").to_pylist()), strict=True))
        rows = ([held[0]] if held else []) + rows
        fresh = vectors([r[3].encode() for r in rows[1 if held else 0 :]])
        prints = np.concatenate([held[1], fresh]) if held else fresh
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if pairs:
            texts = [rows[i][3] for i in pairs]
            edited = [(t[: len(t) - len(t) // 4] + rows[i + 1][3][: len(t) // 4]).encode() for i, t in zip(pairs, texts, strict=True)]
            own, changed, after = prints[pairs], vectors(edited), prints[[i + 1 for i in pairs]]
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[i][2] for i in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(encode(own)), pa.array(encode(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        if rows:
            held = (rows[-1], prints[-1:])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    The edited text has its last floor(n_chars / 4) code points replaced by as many (or all) from the
    start of the next document by doc_id, after the last the first. The texts are dealt once, into at
    most ``MOST_BUCKETS`` ranges of doc_id; each range also gets a copy of the first document of the next. A very long text is hashed in
    runs of paragraphs of bounded size.

    Null text: empty, its fingerprint all zero. Repeated doc_ids follow each other in order of text; null
    doc_ids come first. A single row is its own next. Empty table: no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    least = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("at"))
    n = docs.count()
    count = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    cuts = []
    if count > 1:
        cuts = sorted(set(docs.agg(F.percentile_approx("at", [k / count for k in range(1, count)], 10 * count)).first()[0]))
    if cuts:
        steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        # binary search: the number of cuts at or below doc_id
        bounds = f"array({', '.join(f'{c}L' if c != least else '-9223372036854775808L' for c in cuts)})"
        bucket = F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (b, s) -> if(b + s <= {len(cuts)} and element_at({bounds}, least(b + s, {len(cuts)})) <= at, b + s, b))")
    else:
        bucket = F.lit(0)
    docs = docs.withColumn("bucket", bucket)
    heads = sorted(tuple(r) for r in docs.groupBy("bucket").agg(F.min("at")).collect())
    if not heads:
        heads = [(0, least)]
    halo = [(heads[(i + 1) % len(heads)][1], b) for i, (b, _) in enumerate(heads)]
    halo = docs.sparkSession.createDataFrame(halo, "at long, target int")
    # the first by text of the rows with that doc_id, found before the shuffle
    copies = docs.drop("bucket").join(F.broadcast(halo), "at").groupBy("at", "target").agg(F.min("text").alias("text"))
    copies = copies.select(F.lit(None).cast("long").alias("doc_id"), "text", "at", F.col("target").alias("bucket"), F.lit(True).alias("halo"))
    whole = docs.select("doc_id", "text", "at", F.col("bucket").cast("int").alias("bucket"), F.lit(False).alias("halo")).unionByName(copies)
    ordered = whole.repartition("bucket").sortWithinPartitions("bucket", "halo", "at", "text").select("bucket", "halo", "doc_id", "text")
    return ordered.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
