"""Repeated byte strings by column-wise construction of a collection's Burrows-Wheeler order.

Every string of ``size`` bytes holds exactly one anchor, the leftmost of its ``gram``-byte substrings
whose hash is smallest; equal strings hold it at the same place. So two equal strings are found among
the contexts (bytes around an anchor) that share an anchor, aligned at it. The contexts that share an
anchor form a collection of short documents. Its Burrows-Wheeler order is built column by column, one
symbol per document in each round, together with the array of common prefixes (read towards the past, as
the columns run forward). A string repeats where that array reaches ``size``. The columns, order and
prefix arrays of one unit are read and written strictly in sequence; the units stream through a task in
sorted order from Spark's shuffle files, the external files of this construction, so memory is bounded
by one unit.

An anchor of more contexts than a unit holds is parted by what stands beside it: a string has half of its other
bytes or more before its anchor or after it, so equal strings meet among the contexts that share the half before
or the half after. Only where more contexts than a unit holds share a half, too, they are dealt to several units.

What decides. The construction decides every string of an anchor that has two or more different contexts, one
representative for each. Places whose whole context equals a representative's share its result, and where all
places of an anchor have one context, all of it repeats; such equality is proposed by digests and then compared
byte by byte, as are strings that units of one anchor and half tell each other. Digests only propose: where
bytes differ, everything is done again with keyed digests, so a collision costs time and never a byte.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import drop, has_rows, materialise, release

SIZE, GRAM = 400, 128
BLOCK = 4096
#: Up to so many strings that units tell each other are broadcast (some 60 bytes each), beyond that they are shuffled.
FEW = 50_000
U = np.uint64
PLACE = U(0xFFFFFF)


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_text.RAW[data] * _text.powers(_text.BASE, len(data)), out=total[1:])
    return total


def _window_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values, by running minima in blocks of ``w``."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM, key: int = 0, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Place, first string, anchor hash and context hash of every anchor of short documents (below 2**24 bytes).

    The context hash is a polynomial, of which ``bits`` are kept; with a ``key`` it is a keyed BLAKE2 digest.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none
    total, back = _prefix(data), _text.powers(_text.INVERSE, n)
    h = _text.mix((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    low = _window_minimum((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), size - gram + 1)
    length = np.diff(offsets)
    step = np.zeros(n + 1, np.int8)
    whole = length >= size
    step[offsets[:-1][whole]] += 1
    step[offsets[1:][whole] - size + 1] -= 1
    starts = np.flatnonzero(np.cumsum(step[: len(low)], dtype=np.int8))
    if not len(starts):
        return none, none, none, none
    p = (low[starts] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    p, starts = p[first], starts[first]
    doc = np.searchsorted(offsets, p, "right") - 1
    lo, hi = np.maximum(offsets[doc], p - (size - gram)), np.minimum(offsets[doc + 1], p + size)
    shape = (p - lo) * 4096 + (hi - p)
    if key:
        raw, salt = data.tobytes(), key.to_bytes(8, "little")
        context = np.array([int.from_bytes(hashlib.blake2b(raw[x:y], digest_size=8, key=salt).digest(), "little") for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
    else:
        context = (total[hi] - total[lo]) * back[lo]
    context = _text.mix(context ^ _text.mix(shape.astype(np.uint64))) >> U(64 - bits)
    return p, starts, h[p].view(np.int64), context.view(np.int64)


def _anchors(size: int, gram: int, key: int = 0, bits: int = 64, most: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(2))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in _text.pieces(offsets, most):
                off = offsets[a : b + 1]
                n = off[-1] - off[0]
                if b - a > 1 or n <= 4 * most:
                    p, _, h, c = anchors(data[off[0] : off[-1]], off - off[0], size, gram, key, bits)
                    doc = np.searchsorted(off - off[0], p, "right") - 1 + a
                    found = [(p + off[0] - offsets[doc], h, c, doc)]
                else:
                    found = []
                    for s in range(0, max(0, n - size) + 1, most):
                        lo, hi = max(0, s - 2 * size), min(n, s + most + 3 * size)
                        p, first, h, c = anchors(data[off[0] + lo : off[0] + hi], np.array([0, hi - lo]), size, gram, key, bits)
                        own = (first + lo >= s) & (first + lo < s + most)
                        found.append((p[own] + lo, h[own], c[own], np.full(own.sum(), a)))
                for p, h, c, doc in found:
                    # equal contexts of one document, as in text that repeats itself, are one row with all places
                    order = np.lexsort((p, c, h, doc))
                    p, h, c, doc = p[order], h[order], c[order], doc[order]
                    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (doc[1:] != doc[:-1])])) if len(p) else np.zeros(0, np.int64)
                    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(p)), pa.int32()), pa.array(p, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(c[first]), pa.array(ids[doc[first]]), pa.array(keys[doc[first]]), places], ["h", "c", "id", "dk", "pos"])

    return run


#: Places of one text: an anchor's digests, where it stands, the representative of its context, how many places
#: have that context, and the units of the anchor (null where it has no other context).
PLACES = "array<struct<h:long,c:long,pos:array<long>,r:struct<id:long,dk:long,pos:long>,n:long,chunks:long>>"


def _contexts(size: int, gram: int, bare: bool = False):
    """A row for every representative; where its anchor has several units, one for each half beside the anchor.

    ``half`` is the half's digest, even before the anchor and odd after it. ``bare``: only rows with a half, no bytes.
    """
    near = _half(size, gram)
    digest = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) & ~1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = _text.utf8(batch.column(2))
            out: tuple[list, ...] = ([], [], [], [], [])
            for d, places in enumerate(batch.column(3)):
                a, e = offsets[d], offsets[d + 1]
                for x in places:
                    if x["chunks"].is_valid and x["r"]["id"].as_py() == ids[d] and x["r"]["dk"].as_py() == keys[d]:
                        h, c, pos, n, chunks = x["h"].as_py(), x["c"].as_py(), x["r"]["pos"].as_py(), x["n"].as_py(), x["chunks"].as_py()
                        left = min(pos, size - gram)
                        context = data[a + pos - left : min(e, a + pos + size)].tobytes()
                        halves: list = [] if bare else [None]
                        if chunks > 1:
                            halves = [digest(context[left - near : left])] if left >= near else []
                            if len(context) >= left + gram + near:
                                halves.append(digest(context[left + gram : left + gram + near]) | 1)
                        for half in halves:
                            for y, v in zip(out, (h, c, half, left * 2 + (n > 1), b"" if bare else context), strict=True):
                                y.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["h", "c", "half", "left", "bytes"])

    return run


def _half(size: int, gram: int) -> int:
    """So many bytes before its anchor or after it has every string."""
    return -(-(size - gram) // 2)


def _asks(before: int, after: int):
    """What each text holds where a representative is said to hold the same, in pieces of the latter's blocks.

    From id, dk, text and a list of (r, pos): the bytes from ``before`` below to ``after`` above the first place;
    overlapping ranges with one representative and shift are one. Further places in the same text are compared
    with the first here; where they differ, a row asks for a block that no text has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(2))
            listed = batch.column(3)
            r, pos = listed.flatten().flatten()
            row = np.repeat(np.arange(len(batch)), listed.value_lengths().to_numpy())
            each = np.repeat(np.arange(len(r)), pos.value_lengths().to_numpy())
            p = pos.flatten().to_numpy().astype(np.int64)
            lead = np.ones(len(p), bool)
            lead[1:] = each[1:] != each[:-1]
            at = np.flatnonzero(lead)[each] if len(p) else each
            lo, hi = np.maximum(0, p - before) + offsets[row[each]], np.minimum(np.diff(offsets)[row[each]], p + after) + offsets[row[each]]
            same = all(p[k] - lo[k] == p[j] - lo[j] and np.array_equal(data[lo[k] : hi[k]], data[lo[j] : hi[j]]) for k, j in zip(np.flatnonzero(~lead).tolist(), at[~lead].tolist(), strict=True))
            p, doc = p[lead], row
            rid, rdk, rpos = (x.to_numpy() for x in r.flatten())
            other = (rid != batch.column(0).to_numpy()[doc]) | (rdk != batch.column(1).to_numpy()[doc]) | (rpos != p)
            p, doc, rid, rdk, shift = p[other], doc[other], rid[other], rdk[other], (rpos - p)[other]
            order = np.lexsort((p, shift, rdk, rid, doc))
            p, doc, rid, rdk, shift = p[order], doc[order], rid[order], rdk[order], shift[order]
            lo, hi = np.maximum(0, p - before), np.minimum(np.diff(offsets)[doc], p + after)
            new = np.ones(len(p), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]) | (rdk[1:] != rdk[:-1]) | (shift[1:] != shift[:-1]) | (lo[1:] > hi[:-1])
            first = np.flatnonzero(new)
            last = np.append(first, len(p))[1:] - 1
            out: tuple[list, ...] = ([], [], [], [], []) if same else ([0], [0], [-1], [0], [b"x"])
            for k, e in zip(first.tolist(), (hi[last] + shift[last]).tolist(), strict=True):
                a, base = int(lo[k] + shift[k]), int(offsets[doc[k]] - shift[k])
                for s in range(a - a % BLOCK, e, BLOCK):
                    x, y = max(a, s), min(e, s + BLOCK)
                    for o, v in zip(out, (rid[k], rdk[k], s // BLOCK, x - s, data[base + x : base + y].tobytes()), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["id", "dk", "block", "at", "here"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.utf8(batch.column(2))
        n = -(-np.diff(offsets) // BLOCK)
        doc = np.repeat(np.arange(len(n)), n)
        block = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        a = offsets[doc] + block * BLOCK
        e = np.minimum(a + BLOCK, offsets[doc + 1])
        there = pa.array([data[x:y].tobytes() for x, y in zip(a, e, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(block, pa.int32()), there], ["id", "dk", "block", "there"])


def _differ(asked: DataFrame, witnesses: DataFrame, before: int, after: int) -> bool:
    """Do the bytes of any place differ from its representative's? (id, dk, text, list of (r, pos); id, dk, text)"""
    here = asked.mapInArrow(_asks(before, after), "id long, dk long, block int, at int, here binary")
    there = witnesses.mapInArrow(_blocks, "id long, dk long, block int, there binary")
    both = here.join(there, ["id", "dk", "block"], "left")
    differ = has_rows(both.where("not coalesce(substring(there, at + 1, octet_length(here)) = here, false)"))
    release(asked.sparkSession)
    return differ


def repeated(strings: list[bytes], left: np.ndarray, group: np.ndarray, size: int = SIZE, gram: int = GRAM) -> np.ndarray:
    """For every context and every string start (relative to ``gram - size``): does the string repeat in its group?

    ``group`` must be sorted. Round t inserts symbol t of every context: a stable sort by symbol within
    each group moves the order from prefixes of t to prefixes of t + 1 symbols; ``since`` holds, for each
    context and the one before it, the column from which on they agree.
    """
    m, width = len(strings), 2 * size - gram
    column = np.full((width, m), 256, np.int32)
    for j, s in enumerate(strings):
        at = size - gram - left[j]
        column[at : at + len(s), j] = np.frombuffer(s, np.uint8)
    order = np.arange(m)
    since = np.zeros(m + 1, np.int64)
    group = group.astype(np.int32) * 257
    found = np.zeros((m, width - size + 1), bool)
    for t in range(width):
        symbol = column[t][order] + group
        move = np.argsort(symbol, kind="stable")
        symbol = symbol[move]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] - group[1:] != 256)) + 1
        fresh = np.full(m + 1, t + 1, np.int64)
        if len(same):
            ends = np.empty(2 * len(same), np.int64)
            ends[::2], ends[1::2] = move[same - 1] + 1, move[same] + 1
            fresh[same] = np.maximum.reduceat(since, ends)[::2]
        since, order = fresh, order[move]
        if t >= size - 1:
            hit = np.flatnonzero(since[1:m] <= t - size + 1) + 1
            found[order[hit], t - size + 1] = True
            found[order[hit - 1], t - size + 1] = True
    return found


def _repeats(size: int, gram: int, most: int):
    wide, near = size - gram, _half(size, gram)

    def told(h: list, half: list, part: list, left: np.ndarray, strings: list[bytes], found: np.ndarray) -> tuple[np.ndarray, ...]:
        """What is told to other units of the same anchor and half: context, place, digest of every different string, and 1, or 2 if it repeats here."""
        rows: tuple[list, ...] = ([], [], [], [])
        for j in np.flatnonzero(np.array(part) >= 0).tolist():
            s = strings[j]
            at = np.arange(len(s) - size + 1)
            at = at[(at - left[j] > -near) if half[j] & 1 else (at - left[j] <= -near)]  # each string with one of its halves
            total = _prefix(np.frombuffer(s, np.uint8))
            w = _text.mix((total[at + size] - total[at]) * _text.powers(_text.INVERSE, len(s) + 1)[at]).view(np.int64)
            for y, v in zip(rows, (np.full(len(at), j, np.int32), (at - left[j]).astype(np.int32), w, found[j, wide - left[j] + at]), strict=True):
                y.append(v)
        if not rows[0]:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        j, a, w, seen = map(np.concatenate, rows)
        anchor = np.unique(h, return_inverse=True)[1].astype(np.int32)[j]
        order = np.flatnonzero(seen)
        order = order[np.lexsort((order, w[order], a[order], anchor[order]))]
        again = (anchor[order][1:] == anchor[order][:-1]) & (a[order][1:] == a[order][:-1]) & (w[order][1:] == w[order][:-1])
        once = np.ones(len(j), bool)
        once[order[1:][again]] = False
        return j[once], a[once], w[once], seen[once].astype(np.int32) + 1

    def listed(m: int, row: np.ndarray, **columns: np.ndarray) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=m))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in columns.values()], list(columns)))

    def unit(h: list, c: list, half: list, part: list, left: list, strings: list) -> Iterator[pa.RecordBatch]:
        m = len(h)
        group = np.concatenate([[0], np.cumsum([x != y for x, y in itertools.pairwise(zip(h, half, part, strict=True))])]).astype(np.int64)
        left = np.array(left)
        many, left = left % 2 == 1, left // 2
        found = np.zeros((m, wide + 1), bool)
        met = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(met):
            found[met] = repeated([strings[j] for j in met], left[met], group[met], size, gram)
        for j in np.flatnonzero(many):
            found[j, wide - left[j] : wide - left[j] + len(strings[j]) - size + 1] = True
        edge = np.zeros((m, wide + 3), np.int8)
        edge[:, 1:-1] = found
        edge = np.diff(edge, axis=1)
        row, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1]
        spans = listed(m, row, a=(a - wide).astype(np.int32), b=(b - 1 - wide).astype(np.int32))
        j, a, w, n = told(h, half, part, left, strings, found)
        gaps = listed(m, j, a=a, w=w, n=n)
        out = pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), spans, gaps], ["h", "c", "spans", "gaps"])
        out = out.filter(pa.array(np.bincount(row, minlength=m) + np.bincount(j, minlength=m) > 0))
        for k in range(0, len(out), 500):
            yield out.slice(k, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], [], []]
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                last = tuple(x[-1] for x in held[:4]) if held[0] else None
                if row[:4] == last:
                    continue
                if len(held[0]) >= most and (row[0], *row[2:4]) != (last[0], *last[2:]):
                    yield from unit(*held)
                    held = [[], [], [], [], [], []]
                for x, v in zip(held, row, strict=True):
                    x.append(v)
        if held[0]:
            yield from unit(*held)

    return run


def _few_words(text: np.ndarray, gone: np.ndarray, words: int, whole: int) -> np.ndarray:
    """``gone`` without runs that have both below ``words`` words and below ``whole`` bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    solid = ~_text.SPACE[text]
    begins = solid & ~np.concatenate([[False], solid[:-1]])
    total = np.concatenate([[0], np.cumsum(begins)])
    number = total[b] - total[a] + (solid[a] & ~begins[a])
    gone = gone.copy()
    for x, y in zip(a[(number < words) & (b - a < whole)], b[(number < words) & (b - a < whole)], strict=True):
        gone[x:y] = False
    return gone


def _cut(size: int, gram: int, words: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(2))
            removed, runs, digests, kept = [], [], [], []
            for d, (copied, found) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                text = data[offsets[d] : offsets[d + 1]]
                step = np.zeros(len(text) + 1, np.int32)
                for pos in itertools.chain.from_iterable(copied):
                    step[max(0, pos + gram - size)] += 1
                    step[min(len(text), pos + size)] -= 1
                for x in found or ():
                    for pos, s in itertools.product(x["pos"], x["spans"]):
                        step[pos + s["a"]] += 1
                        step[pos + s["b"] + size] -= 1
                gone = np.cumsum(step[:-1]) > 0
                if words:
                    gone = _few_words(text, gone, words, whole)
                rest = text[~gone].tobytes()
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            arrays = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "dk", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(id_.alias("id"), F.xxhash64(id_, text).alias("dk"), text.alias("text"))


def cut_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, unit: int = 4096, with_text: bool = True, words: int = 0, whole: int = SIZE, bits: int = 64) -> DataFrame:
    """id, dk, n_removed, n_spans, kept_sha256 and, ``with_text``, kept (bytes) of every document that loses a byte.

    ``id`` is the doc_id (null: -2**63) and ``dk`` a digest of id and text. With ``words``, runs of fewer words and
    fewer than ``whole`` bytes stay. Contexts that share an anchor but exceed ``unit`` are dealt by the halves beside it,
    and those that share a half, too, but exceed ``unit``, to several units; every such unit then tells its different
    strings by digest, and one that any other has, too, repeats; so nothing is lost. ``bits`` of the first context digests are used (tests take few, so that they collide).
    """
    docs = _keyed(docs)
    for key in range(4):
        cut = _cut_once(docs, size, gram, unit, with_text, words, whole, key, 64 if key else bits)
        if cut is not None:
            return cut
    raise RuntimeError("contexts collided under four independent digests")


def _cut_once(docs: DataFrame, size: int, gram: int, unit: int, with_text: bool, words: int, whole: int, key: int, bits: int) -> DataFrame | None:
    """As :func:`cut_repeats`; None where digests were equal and bytes were not."""
    placed = materialise(docs.select("id", "dk", "text").mapInArrow(_anchors(size, gram, key, bits), "h long, c long, id long, dk long, pos array<long>"))
    found = placed.count()
    shared = placed.groupBy("h").agg(F.sum(F.size("pos")).alias("n"), F.min("c").alias("x"), F.max("c").alias("y")).where("n > 1").select("h", (F.col("x") != F.col("y")).alias("multi"))
    # written first: a join of two plain exchanges lets Spark split the tasks of a very common anchor
    copies = materialise(placed.join(materialise(shared, found), "h"), found, 200_000)
    drop(placed)
    reps = copies.groupBy("h", "c").agg(F.min(F.struct("id", "dk", F.element_at("pos", 1).alias("pos"))).alias("r"), F.sum(F.size("pos")).alias("n"), F.max("multi").alias("multi"))
    chunks = reps.where("multi").groupBy("h").agg(F.ceil(F.count("*") / unit).alias("chunks"))
    reps = materialise(reps.join(materialise(chunks, found), "h", "left").drop("multi"), found, 200_000)
    place = F.struct("h", "c", "pos", "r", "n", "chunks")
    own = (F.col("r.id") == F.col("id")) & (F.col("r.dk") == F.col("dk")) & (F.col("n") > 1)
    touched = copies.join(reps, ["h", "c"]).groupBy("id", "dk").agg(F.collect_list(place).cast(PLACES).alias("places"), F.max(own).alias("witness"))
    many = docs.count()
    texts = materialise(docs.join(touched, ["id", "dk"]), many, 5000)
    asked = texts.select("id", "dk", "text", F.transform("places", lambda x: F.struct(x["r"].alias("r"), x["pos"].alias("pos"))).alias("asks"))
    made = [copies, reps, texts]
    if _differ(asked, texts.where("witness").select("id", "dk", "text"), size - gram, size):
        return _undo(made)
    beside = "h long, c long, half long, left long, bytes binary"
    contexts = texts.where(F.exists("places", lambda x: x["chunks"].isNotNull())).select("id", "dk", "text", "places").mapInArrow(_contexts(size, gram), beside)
    part = F.lit(-1).cast("long")
    if has_rows(reps.where("chunks > 1")):
        halves = texts.where(F.exists("places", lambda x: x["chunks"] > 1)).select("id", "dk", "text", "places").mapInArrow(_contexts(size, gram, True), beside)
        # a row for more than ``unit`` contexts
        parts = materialise(halves.groupBy("h", "half").agg(F.ceil(F.count("*") / unit).alias("parts")).where("parts > 1"), 2 * found // unit)
        made.append(parts)
        if has_rows(parts):
            contexts = contexts.join(F.broadcast(parts), ["h", "half"], "left")
            part = F.coalesce(F.pmod("c", "parts"), part)
    contexts = contexts.select("h", "c", "half", part.alias("part"), "left", "bytes")
    contexts = contexts.repartition("h", "half", "part").sortWithinPartitions("h", "half", "part", "c")
    spans = "array<struct<a:int,b:int>>"
    hits = materialise(contexts.mapInArrow(_repeats(size, gram, unit), f"h long, c long, spans {spans}, gaps array<struct<a:int,w:long,n:int>>"), found, 50_000)
    made.append(hits)
    ranges = hits.select("h", "c", "spans")
    gaps = hits.where(F.size("gaps") > 0).select("h", "c", F.inline("gaps"))
    if has_rows(gaps):
        twice = gaps.groupBy("h", "a", "w").agg(F.sum("n").alias("times"), F.min("c").alias("least"), F.max("c").alias("most")).where("times > 1")
        late = materialise(gaps.where("n = 1").join(twice, ["h", "a", "w"]).select("h", "c", "a", F.when(F.col("c") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("other")))
        made.append(late)
        if _late_differ(late, reps, texts, size):
            return _undo(made)
        late = late.groupBy("h", "c").agg(F.collect_list(F.struct(F.col("a"), F.col("a").alias("b"))).alias("late"))
        ranges = ranges.join(late, ["h", "c"], "left").select("h", "c", F.concat("spans", F.coalesce("late", F.array().cast(spans))).alias("spans"))
    places = copies.where("multi").join(ranges.where(F.size("spans") > 0), ["h", "c"]).groupBy("id", "dk").agg(F.collect_list(F.struct("pos", "spans")).alias("found"))
    copied = F.transform(F.filter("places", lambda x: x["chunks"].isNull()), lambda x: x["pos"])
    cut = texts.select("id", "dk", "text", copied.alias("copied")).join(places, ["id", "dk"], "left").where("found is not null or size(copied) > 0")
    cut = cut.select("id", "dk", "text", "copied", "found").mapInArrow(_cut(size, gram, words, whole), "id long, dk long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = materialise((cut if with_text else cut.drop("kept")).where("n_removed > 0").dropDuplicates(["id", "dk"]), many, 5000)
    _undo(made)
    return cut


def _undo(made: list[DataFrame]) -> None:
    for done in made:
        drop(done)


def _late_differ(late: DataFrame, reps: DataFrame, texts: DataFrame, size: int) -> bool:
    """Do strings that units of one anchor told each other by digest (h, c, a, other) differ in their bytes?"""
    small = F.broadcast if late.count() <= FEW else (lambda d: d)
    mine = reps.join(small(late), ["h", "c"]).select("h", "other", "a", F.col("r").alias("m"))
    both = materialise(reps.select("h", F.col("c").alias("other"), F.col("r").alias("t")).join(small(mine), ["h", "other"]))
    at = F.struct(F.col("t.id").alias("id"), F.col("t.dk").alias("dk"), (F.col("t.pos") + F.col("a")).alias("pos"))
    asks = both.select("m.id", "m.dk", F.struct(at.alias("r"), F.array(F.col("m.pos") + F.col("a")).alias("pos")).alias("ask"), F.struct("t.id", "t.dk").alias("t"))
    texts = texts.select("id", "dk", "text")
    asked = texts.join(small(asks.groupBy("id", "dk").agg(F.collect_list("ask").alias("asks"))), ["id", "dk"])
    differ = _differ(asked, texts.join(small(asks.select("t.id", "t.dk").distinct()), ["id", "dk"], "left_semi"), 0, size)
    drop(both)
    return differ


def _report(docs: DataFrame) -> tuple:
    """doc_id null as a number, and the digest that :func:`cut_repeats` calls dk."""
    id_ = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    return id_, F.xxhash64(id_, F.coalesce(docs["text"].cast("string"), F.lit("")))


def repeat_report(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Removed is each byte covered by a string of ``size`` bytes that also starts anywhere else, in the
    same or another row; strings are judged on the input and do not cross rows. Null text counts as
    empty, a text below ``size`` bytes loses nothing, repeated rows are copies of each other and get equal
    results, an empty table gives no rows, and other columns are ignored. Very long texts are read in runs
    of 256 kB that overlap, with the same result as at once. Where several places tie, all of them go.
    """
    docs = docs.select("doc_id", "text")
    cut = cut_repeats(docs, size, gram, with_text=False)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_, dk = _report(docs)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_.alias("id"), dk.alias("dk"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    out = every.join(cut, ["id", "dk"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, words: int = 0) -> DataFrame:
    """``docs`` with repeated strings cut from ``text`` (bytes of cut characters go too) and n_chars counted anew.

    With ``words``, a run of repeated strings of ``size`` bytes goes only if it has so many words (cut words count)
    or :data:`SIZE` bytes. Rows stay as they are where nothing repeats, as do null and empty texts; a row of which
    nothing is left keeps an empty text. Rows may repeat or have no doc_id: equal ones are copies of each other and
    lose the same. Very long texts are read in runs, further columns of any name come through, and an empty table
    stays empty.
    """
    cut = cut_repeats(docs, size, gram, words=words)
    id_, dk = _report(docs)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_.alias("id"), dk.alias("dk"))
    out = packed.join(cut.select("id", "dk", F.make_valid_utf8(F.col("kept").cast("string")).alias("rest")), ["id", "dk"], "left")
    changed = {"text": F.col("rest"), "n_chars": F.char_length("rest")}
    columns = [F.when(F.col("rest").isNull(), F.col("row")[c]).otherwise(changed[c].cast(docs.schema[c].dataType)) if c in changed else F.col("row")[c] for c in docs.columns]
    return out.select(*(x.alias(c) for x, c in zip(columns, docs.columns, strict=True)))
