"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own and its two neighbours' character and word
statistics; the chain couples neighbouring labels. Forward-backward gives each line's probability to be
good, and their mean weighted by line length, mapped to a probability, is the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import drop, filter_rows, materialise, small_batches

#: Bounds of the training sample: labelled documents, and their bytes together; each is taken whole.
TRAIN_DOCS, TRAIN_BYTES = 2000, 16 << 20


def _class(*codes: int) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(codes)] = 1
    return out


LETTER = _class(*range(65, 91), *range(97, 123), *range(128, 256))
UPPER = _class(*range(65, 91))
DIGIT = _class(*range(48, 58))
STOP = _class(*b".,;:?'\"()-")
MARK = _class(*(c for c in range(33, 127) if not (LETTER[c] or DIGIT[c] or STOP[c])))
FEATURES = 13


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line that is not empty (offsets start at 0)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[1:], breaks]))
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


NEWLINE = _class(10).astype(bool)
REPEATED = 11


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every non-empty line, its length in bytes and its document.

    A long document, which comes alone, is read in runs of lines; only whether a line occurs again in its
    document needs all of them, by their hashes.
    """
    if len(offsets) == 2 and len(data) > _text.LONG:
        parts = [_own_features(data[a:b], np.array([0, b - a])) for a, b in _text.cuts(NEWLINE, data)]
    else:
        parts = [_own_features(data, offsets)]
    x, length, doc, whole = (np.concatenate(p) for p in zip(*parts, strict=True))
    _, back, times = np.unique(whole, return_inverse=True, return_counts=True)
    x[:, REPEATED] = times[back] > 1
    return x, length, doc


def _own_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`line_features` but for repeated lines, and the hash of every line and its document."""
    starts, ends, doc = _lines(data, offsets)
    n = len(starts)
    if not n:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), doc, np.zeros(0, np.uint64)
    length = ends - starts

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flag, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float32)

    space = _text.SPACE[data]
    letter, mark = LETTER[data], MARK[data]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    cuts = np.concatenate([starts, ends[-1:]])
    words, per = _text.words(data[cuts[0] : cuts[-1]], cuts - cuts[0])
    line = np.repeat(np.arange(n), per)
    bare = words ^ _text.mix(line.astype(np.uint64))
    # distinct words: the hash of a word and its line, sorted; the line is found again by the first place
    _, first = np.unique(bare, return_index=True)
    distinct = np.bincount(line[first], minlength=n)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_text.RAW[data] * _text.powers(_text.BASE, len(data)), out=total[1:])
    whole = _text.mix((total[ends] - total[starts]) * _text.powers(_text.INVERSE, len(data))[starts]) ^ _text.mix(doc.astype(np.uint64))
    size = np.maximum(length, 1).astype(np.float32)
    tokens = np.maximum(per, 1).astype(np.float32)
    letters = count(letter)
    x = np.stack([
        np.log1p(per), np.log1p(length), letters / size, count(UPPER[data]) / np.maximum(letters, 1), count(DIGIT[data]) / size, count(STOP[data]) / size, count(mark) / size,
        count(mark.astype(bool) & after) / tokens, count(data == 124) / tokens, letters / tokens / 10, distinct / tokens, np.zeros(n), count(data >= 128) / size,
    ], axis=1)
    return x.astype(np.float32), length, doc, whole


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zero at the ends) and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = doc[1:] == doc[:-1]
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    link: np.ndarray  # 2 x 2: label before, label
    slope: float
    shift: float
    prior: float

    def emissions(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return with_neighbours(np.clip((x - self.mean) / self.scale, -8, 8), doc) @ self.weight

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        docs = len(offsets) - 1
        x, length, doc = line_features(data, offsets)
        good = 1 / (1 + np.exp(-messages(self.emissions(x, doc), doc, self.link)[2]))
        share = np.bincount(doc, good * length, docs) / np.maximum(np.bincount(doc, length, docs), 1)
        out = 1 / (1 + np.exp(-(self.slope * _logit(share) + self.shift)))
        return np.where(np.bincount(doc, minlength=docs) > 0, out, self.prior)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _pass(e: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Log-odds that a neighbour with log-odds ``e`` sends across the link."""
    return np.logaddexp(link[0, 1], link[1, 1] + e) - np.logaddexp(link[0, 0], link[1, 0] + e)


def messages(e: np.ndarray, doc: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds from the lines before, from those after, and of every line given all, for chains by document."""
    n = len(e)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    ahead, behind = np.zeros(n), np.zeros(n)
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) if len(size) else 0), "left")  # chains longer than t
    for t in range(1, int(size[0]) if n else 0):
        k = live[t - 1]
        at = first[:k] + t
        ahead[at] = _pass(e[at - 1] + ahead[at - 1], link)
        back = first[:k] + size[:k] - 1 - t
        behind[back] = _pass(e[back + 1] + behind[back + 1], link.T)
    return ahead, behind, e + ahead + behind


def fit(x: np.ndarray, length: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 120) -> Model:
    """Maximum likelihood with every line bearing its document's label, by Adam with a small penalty.

    ``doc`` numbers the documents 0.. in order and ``label`` is by document. Without lines or with one
    label only, the score is the constant share of label 1.
    """
    prior = float((label.sum() + 1) / (len(label) + 2)) if len(label) else 0.5
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 0.05) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    model = Model(mean, scale, np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), 0.0, float(_logit(np.array(prior))), prior)
    if not len(x) or len(set(label.tolist())) < 2:
        return model
    z = with_neighbours(np.clip((x - mean) / scale, -8, 8), doc).astype(np.float64)
    y = label[doc].astype(np.float64)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    # both labels weigh the same, and so do long and short documents
    weight = 1 / np.bincount(doc)[doc] ** 0.5
    weight = weight / np.where(y == 1, weight[y == 1].sum(), weight[y == 0].sum())
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, link = theta[:-4], theta[-4:].reshape(2, 2)
        e = z @ w
        ahead, behind, odds = messages(e, doc, link)
        p = 1 / (1 + np.exp(-odds))
        gradient = np.empty_like(theta)
        gradient[:-4] = z.T @ (weight * (y - p))
        a, b = e[pair - 1] + ahead[pair - 1], e[pair] + behind[pair]
        joint = np.stack([np.zeros_like(a) + link[0, 0], b + link[0, 1], a + link[1, 0], a + b + link[1, 1]])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        real = np.stack([(1 - y[pair - 1]) * (1 - y[pair]), (1 - y[pair - 1]) * y[pair], y[pair - 1] * (1 - y[pair]), y[pair - 1] * y[pair]])
        gradient[-4:] = ((real - joint) * weight[pair]).sum(axis=1)
        gradient -= 1e-3 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weight, model.link = theta[:-4], theta[-4:].reshape(2, 2)
    good = 1 / (1 + np.exp(-messages(z @ model.weight, doc, model.link)[2]))
    docs = len(label)
    share = np.bincount(doc, good * length, docs) / np.maximum(np.bincount(doc, length, docs), 1)
    some = np.bincount(doc, minlength=docs) > 0
    model.slope, model.shift = _platt(_logit(share[some]), label[some])
    return model


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value by Newton's method, with a small penalty."""
    design, theta = np.stack([s, np.ones_like(s)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        theta += np.clip(np.linalg.solve(h, design.T @ (y - p) - 1e-2 * theta), -2, 2)
    return float(theta[0]), float(theta[1])


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, name: str, folds: int, held: int, most: int) -> DataFrame:
    """(doc_id, text, label): at most ``most`` labelled rows outside the held-out fold, the first by hash of doc_id.

    Their ids alone are sorted (keeping the first ``most`` of each task), then broadcast.
    """
    seen = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held))
    seen = seen.groupBy(F.col("doc_id").alias("_id")).agg(F.min(name).cast("int").alias("label"))
    chosen = seen.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).select("doc_id", "text", "label")


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.utf8(batch.column(1))
        rows = []
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            x, length, _ = line_features(own, np.array([0, len(own)]))
            rows.append((x.tobytes(), length.astype(np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "label", "x", "length"])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """The model fitted on the first labelled documents by hash: ``most``, or as many as have ``most_bytes``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = materialise(labelled_sample(docs, labels, "quality", folds, held, most), most, 500)
    sizes = sample.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen = [r["doc_id"] for r, n in zip(sizes, np.cumsum([r["n"] for r in sizes]), strict=True) if n <= most_bytes]
    rows = sample.where(F.col("doc_id").isin(chosen)).mapInArrow(_train_rows, "doc_id long, label int, x binary, length binary").collect()
    drop(sample)
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(v) for v in x])
    length = np.concatenate([np.frombuffer(r["length"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    return fit(np.concatenate(x) if rows else np.zeros((0, FEATURES), np.float32), length, doc, np.array([r["label"] for r in rows], np.int64))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            data, offsets = _text.utf8(batch.column(1))
            parts = [model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _text.pieces(offsets)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(score, pa.float64())], [batch.schema.names[0], *batch.schema.names[2:], "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, learned from ``labels`` (doc_id, quality).

    Only the text decides the score. Learning reads at most ``TRAIN_DOCS`` labelled rows and ``TRAIN_BYTES``;
    every text is scored whole, however long. Null, empty and newline-only texts score the share of label 1 in
    training; without labels that is 0.5. Repeated rows score alike, a null doc_id counts as not held
    out and is never trained on, an empty table gives no rows; other columns are ignored. Of
    contradicting labels of one doc_id the smallest counts, null labels don't.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(model), f"doc_id {kind}, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _filter(shared, threshold: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            data, offsets = _text.utf8(batch.column(text))
            parts = [model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _text.pieces(offsets)]
            yield batch.filter(pa.array(np.concatenate(parts) >= threshold if parts else np.zeros(0, bool)))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all columns, whatever their names.

    Each row is scored as by :func:`score_quality`, so null and empty texts stay if the share of label 1 is
    high enough, repeated rows share their fate, a null doc_id changes nothing, very long texts are
    scored whole, and an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return filter_rows(docs, _filter(model, threshold, docs.columns.index("text")))
