"""Benchmark decontamination by the q-gram lemma: banded counts, edit budget, banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import filter_rows, small_batches

Q = 8
SLICE_CHARS = 8 << 20
STEP = 1 << 20
BITS = 22
#: Pairs of equal q-grams that are listed at once; a q-gram with more in one buffer is counted by its places.
PAIRS = 1 << 20
U = np.uint64


def normalise(text: str | None) -> str:
    """Lower case with every run of white space as one space."""
    return " ".join((text or "").lower().split())


def _byte_per_char(text: str) -> bytes:
    """One byte per character; equal characters get equal bytes, so that filtering on them loses nothing."""
    return text.encode("latin-1", "replace")


def _grams(buffer: bytes) -> np.ndarray:
    if len(buffer) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(buffer) - Q + 1,), "<u8", buffer, 0, (1,)).copy()


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)


def budget(length: int, rate: float) -> int:
    """Edits allowed for a passage: ``rate`` of its characters, as far as a shared q-gram is then certain."""
    return max(0, min(int(rate * length), (length - Q) // Q))


class Index:
    """The q-grams of all passages with their places (CSR), and a bit table that rules most others out."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids = [i for i, _ in items]
        self.text = [t for _, t in items]
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([budget(len(t), rate) for t in self.text], np.int64)
        self.least = self.length - Q + 1 - Q * self.edits
        self.short = [i for i, t in enumerate(self.text) if 0 < len(t) < Q]
        grams = [_grams(_byte_per_char(t)) for t in self.text]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.gram, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.item, self.place = item[order], place[order]
        self.table = np.zeros(1 << BITS, bool)
        self.table[_slot(self.gram)] = True
        self.longest = int(self.length.max(initial=0))

    def counts(self, at: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal q-grams by item and diagonal band: item << 40 | band in order, and their number.

        ``at`` are places in a buffer and ``u`` the q-grams there. Memory is bounded by ``PAIRS`` and the number of
        bands, however often text and passages repeat themselves.
        """
        n = self.first[u + 1] - self.first[u]
        times = np.bincount(u, minlength=len(self.gram))[u]
        heavy = n * times > PAIRS
        keys, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for gram in np.unique(u[heavy]).tolist():
            places = at[u == gram]
            span = slice(int(self.first[gram]), int(self.first[gram + 1]))
            item, start = np.unique(self.item[span], return_index=True)
            for k, p in zip(item.tolist(), np.split(self.place[span], start[1:]), strict=True):
                low, found = self._bands(places, p, int(self.edits[k]) + 1)
                some = np.flatnonzero(found)
                keys.append(k << 40 | (some + low + self.longest // (int(self.edits[k]) + 1) + 1))
                numbers.append(found[some])
        at, u, n = at[~heavy], u[~heavy], n[~heavy]
        total = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            m = n[a:b]
            hit = np.repeat(self.first[u[a:b]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            item = self.item[hit]
            width = self.edits[item] + 1
            band = (np.repeat(at[a:b], m) - self.place[hit]) // width + self.longest // width + 1
            key, count = np.unique(item << 40 | band, return_counts=True)
            keys.append(key)
            numbers.append(count)
            a = b
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(back, np.concatenate(numbers), len(key)).astype(np.int64)

    @staticmethod
    def _bands(at: np.ndarray, places: np.ndarray, width: int) -> tuple[int, np.ndarray]:
        """The lowest band, and for it and those above how many pairs of ``at`` (in order) and ``places`` it holds."""
        low, high = int(at[0] - places.max()) // width, int(at[-1] - places.min()) // width
        edges = np.arange(low, high + 2) * width
        out = np.zeros(len(edges) - 1, np.int64)
        if len(edges) < len(at):
            step = max(1, PAIRS // len(edges))
            for i in range(0, len(places), step):
                out += np.diff(np.searchsorted(at, edges[None, :] + places[i : i + step, None]), axis=1).sum(axis=0)
        else:
            for p in places.tolist():
                out += np.bincount((at - p) // width - low, minlength=len(out))
        return low, out

    def regions(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(item, lowest diagonal) of the double bands that hold enough shared q-grams."""
        g = _grams(buffer)
        at = np.flatnonzero(self.table[_slot(g)])
        if not len(at) or not len(self.gram):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        u = np.searchsorted(self.gram, g[at])
        u[u == len(self.gram)] = 0
        real = self.gram[u] == g[at]
        at, u = at[real], u[real]
        key, count = self.counts(at, u)
        # a match may lie astride two bands: count each band with the one after it, and the first also with the one before
        follows = np.zeros(len(key), bool)
        follows[:-1] = key[1:] == key[:-1] + 1
        both = count.copy()
        both[:-1] += np.where(follows[:-1], count[1:], 0)
        keep = both >= self.least[key >> 40]
        item, band = key[keep] >> 40, key[keep] & ((1 << 40) - 1)
        width = self.edits[item] + 1
        return item, (band - self.longest // width - 1) * width


def distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int:
    """Least edits to turn ``pattern`` into a substring of ``text`` starting on diagonals low..high; most + 1 if above.

    Only diagonals within ``most`` of the band are filled; ``pattern`` and ``text`` are code points.
    """
    m, n = len(pattern), len(text)
    first, width = low - most, high - low + 1 + 2 * most
    j = np.arange(width) + first
    far = most + 1
    row = np.where((j >= 0) & (j <= n), 0, far)
    ramp = np.arange(width)
    padded = np.full(n + 2 * (m + width + abs(first)) + 2, -1, np.int64)
    shift = m + width + abs(first)
    padded[shift : shift + n] = text
    for i in range(1, m + 1):
        j = ramp + first + i
        same = padded[j - 1 + shift] == pattern[i - 1]
        new = row + ~same
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(j < 0) | (j > n)] = far
        new = np.minimum.accumulate(new - ramp) + ramp
        new[(j < 0) | (j > n)] = far
        row = np.minimum(new, far)
        if row.min() > most:
            return far
    return int(row.min())


def leaks(text: str, buffer: bytes, index: Index, offset: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(position of item, edits, start, end) of every confirmed region of a normalised text."""
    codes = None
    for item, diagonal in zip(*(x.tolist() for x in index.regions(buffer)), strict=True):
        most, m = int(index.edits[item]), int(index.length[item])
        a, b = max(0, diagonal - most), min(len(text), diagonal + 2 * (most + 1) + m + most)
        at = text.find(index.text[item], a, b)
        if at >= 0:
            yield item, 0, at + offset, at + m + offset
            continue
        if codes is None:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        pattern = np.frombuffer(index.text[item].encode("utf-32-le"), np.uint32).astype(np.int64)
        edits = distance(pattern, codes[a:b], diagonal - a, diagonal + 2 * (most + 1) - a, most)
        if edits <= most:
            yield item, edits, a + offset, b + offset


def document_leaks(text: str | None, index: Index) -> dict[int, tuple[int, int, int]]:
    """The best region of every leaked item in a document of any length."""
    whole = normalise(text)
    found: dict[int, tuple[int, int, int]] = {}
    for a in range(0, max(1, len(whole)), STEP):
        part = whole[a : a + STEP + 4 * index.longest] if len(whole) > STEP else whole
        for item, *best in leaks(part, _byte_per_char(part), index, a):
            found[item] = min(found.get(item, (1 << 60, 0, 0)), tuple(best))
    for item in index.short:
        if (at := whole.find(index.text[item])) >= 0:
            found[item] = (0, at, at + len(index.text[item]))
    return found


def all_leaks(column: pa.Array, index: Index) -> Iterator[tuple[int, dict[int, tuple[int, int, int]]]]:
    """Number and leaks of every text that may hold a passage."""
    texts = [normalise(t) for t in column.to_pylist()]
    held: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size + len(texts[i]) > STEP:
            # short documents go through the filter as one buffer; only those with a region are looked at
            buffer = b"\n".join(_byte_per_char(texts[x]) for x in held)
            ends = np.cumsum([len(texts[x]) + 1 for x in held])
            item, diagonal = index.regions(buffer)
            middle = np.clip(diagonal + index.length[item] // 2 + index.edits[item], 0, max(len(buffer) - 1, 0)) if len(item) else item
            touched = {held[x] for x in np.searchsorted(ends, middle, "right").tolist() if x < len(held)}
            if index.short:
                touched |= set(held)
            for x in sorted(touched):
                yield x, document_leaks(texts[x], index)
            held, size = [], 0
        if i < len(texts):
            if len(texts[i]) > STEP:
                yield i, document_leaks(texts[i], index)
            else:
                held.append(i)
                size += len(texts[i]) + 1


def _search(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, rate)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[x], index.ids[k], *v) for x, found in all_leaks(batch.column(1), index) for k, v in found.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "start", "stop"])

    return run


def _clean(shared, rate: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, rate)
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            stays[[x for x, found in all_leaks(batch.column(text).cast(pa.string()), index) if found]] = False
            yield batch.filter(pa.array(stays))

    return run


def _passages(benchmark: DataFrame, slice_chars: int) -> Iterator:
    """The normalised passages as broadcasts of about ``slice_chars`` characters each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("trim(text) <> ''")
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    slices = -(-size // (slice_chars // 2)) if size > slice_chars else 1
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k) if slices > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, t) for r in part.collect() if (t := normalise(r.text))])


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, stop) for every benchmark passage that a document holds.

    Texts are compared after :func:`normalise`. A document holds a passage of m characters if a
    substring of it is within ``budget(m, rate)`` edits. By the q-gram lemma such a substring shares
    m - Q + 1 - Q * budget q-grams on diagonals that lie within two adjacent bands; those regions
    are kept and aligned. start and stop bound the region, in characters of the normalised text.

    The passages are broadcast in slices of at most ``slice_chars`` characters, each a pass over the
    documents. A very long text is searched in overlapping runs of ``STEP`` characters. Of regions of one
    passage the one with fewest edits counts, of ties the first. Null and empty texts hold nothing; null and empty passages are held by nothing; passages
    below Q characters must occur unchanged. Repeated rows each give their rows; a null doc_id or
    item_id is carried; passages of equal text each give a row. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in _passages(benchmark, slice_chars):
        found = docs.mapInArrow(_search(shared, rate), "doc_id long, item_id long, edits long, start long, stop long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage, see :func:`find_leaks`.

    Each row is judged by its own text, whatever its doc_id, which may be null or repeated; null and empty
    texts stay, very long ones are searched in runs, repeated rows share their fate, further columns of any
    name come through, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    out = docs
    for shared in _passages(benchmark, slice_chars):
        out = filter_rows(out, _clean(shared, rate, docs.columns.index("text")))
    return out
