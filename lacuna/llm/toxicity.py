"""Toxicity from a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches
from .quality import labelled_sample, remainder

#: Fixed values. Look-alike letters of other scripts, and what digits and signs stand for within words.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: Phrases in which a term is no insult.
EXCEPTIONS = ("clown fish", "clown car", "sore loser", "trash bag", "trash bin", "trash can", "trash collection")

_wide = {chr(c): chr(c - 0xFEE0).lower() for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]}
_hidden = dict.fromkeys("​‌‍⁠﻿­", "")
TABLE = str.maketrans({**{k: DIGITS.get(v, v) for k, v in _wide.items()}, **_hidden, **HOMOGLYPHS, **DIGITS})
_sign = re.compile(r"(?<=[^\W_])[@$!]+(?=[^\W_])")
_word = re.compile(r"[^\W_]+")

#: Bounds of the model: labelled documents that it learns from, terms of its lexicon, and letters of a term.
TRAIN_DOCS, MOST_TERMS = 12_000, 2000
SHORTEST, LONGEST = 3, 14
#: A term's ratio must be above 1 but for this chance.
DOUBT = 1e-4


def fold(text: str | None) -> str:
    """Lower case, look-alikes and digits as letters, signs within words as letters, marks without width gone."""
    text = (text or "").lower().translate(TABLE)
    if "@" in text or "$" in text or "!" in text:
        text = _sign.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    return text


class Lexicon:
    """Terms with weights; a term matches a word that begins with it, unless within an exception phrase."""

    def __init__(self, terms: dict[str, float], exceptions: Sequence[str] = ()):
        self.terms, self.exceptions = terms, tuple(fold(e) for e in exceptions)
        self.automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            self.automaton.add_word(t, (len(t), w))
        for e in self.exceptions:
            self.automaton.add_word(e, (len(e), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """Logarithms of the summed weights and of the sum for 100 words."""
        if not len(self.automaton) or not text:
            return 0.0, 0.0
        text = fold(text)
        hits, spared = [], []
        for end, (n, w) in self.automaton.iter(text):
            a = end - n + 1
            if a and text[a - 1].isalnum():
                continue
            if w:
                hits.append((a, end, w))
            elif end + 1 == len(text) or not text[end + 1].isalnum():
                spared.append((a, end))
        if spared:
            hits = _outside(hits, spared)
        if not hits:
            return 0.0, 0.0
        best: dict[int, float] = {}
        for a, _, w in hits:  # nested terms of one word count once
            best[a] = max(best.get(a, 0.0), w)
        total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(text.split()))))


def _outside(hits: list[tuple[int, int, float]], spans: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """The hits (start, end, weight) that lie within no span, by one pass over both in order of start."""
    spans, out, reach, k = sorted(spans), [], -1, 0
    for h in sorted(hits):
        while k < len(spans) and spans[k][0] <= h[0]:
            reach, k = max(reach, spans[k][1]), k + 1
        if h[1] > reach:
            out.append(h)
    return out


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For word beginnings: in how many documents of either label they occur."""
    for batch in batches:
        counts: dict[tuple[str, int], int] = defaultdict(int)
        for t, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for p in {w[:k] for w in set(_word.findall(fold(t))) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}:
                counts[p, label] += 1
        rows = [(p, label, n) for (p, label), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["term", "label", "n"])


def term_counts(sample: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, p, n): in how many toxic and other documents a word beginning occurs; and how many there are of either.

    Equal texts of one label count as one document, in the counts and in the totals.
    """
    distinct = sample.dropDuplicates(["label", "text"]).repartition(4, "label", F.xxhash64("text"))
    size = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    found = distinct.mapInArrow(_prefix_counts, "term string, label int, n long").groupBy("term")
    counts = found.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n"))
    return counts, size.get(1, 0), size.get(0, 0)


def _tail(p: int, n: int, share: float) -> float:
    """Chance of at least p toxic ones among p + n documents, each toxic with chance ``share``."""
    k = np.arange(p, p + n + 1)
    ways = math.lgamma(p + n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(p + n - i + 1) for i in k])
    return float(np.exp(ways + k * math.log(share) + (p + n - k) * math.log1p(-share)).sum())


def choose_terms(counts: list[tuple[str, int, int]], positives: int, negatives: int, doubt: float = DOUBT, least_weight: float = 3.0) -> dict[str, float]:
    """Terms and weights from (beginning, toxic documents, others): the logarithm of the ratio of shares.

    The exact lower bound of the ratio, at the level ``doubt``, must be above 1, however few toxic documents
    (of a rare language, say) have the term. Of beginnings contained in each other the best one stays: by
    documents times weight, then the longest.
    """
    if not positives or not negatives:
        return {}
    scored = []
    for t, p, n in counts:
        w = float(np.log((p + 0.5) / (positives + 1)) - np.log((n + 0.5) / (negatives + 1)))
        if p and w >= least_weight and _tail(p, n, positives / (positives + negatives)) <= doubt:
            scored.append((p * w, len(t), t, w))
    out: dict[str, float] = {}
    within: set[str] = set()  # beginnings of chosen terms
    for _, _, t, w in sorted(scored, reverse=True):
        if t not in within and not any(t[:k] in out for k in range(1, len(t))):
            out[t] = w
            within |= {t[:k] for k in range(1, len(t) + 1)}
    return out


def learn_terms(counts: DataFrame, positives: int, negatives: int, most: int = MOST_TERMS) -> dict[str, float]:
    """The best ``most`` terms of (term, p, n), after nested beginnings (they share the first letters) are merged."""
    if not positives or not negatives:
        return {}
    least = math.log(DOUBT) / math.log(positives / (positives + negatives))  # fewer can't be sure, even with no other document
    good = counts.where((F.col("p") >= least - 1e-9) & ((F.col("p") + 0.5) / (positives + 1) > 20 * (F.col("n") + 0.5) / (negatives + 1)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        chosen, p = choose_terms(rows, positives, negatives), {r[0]: r[1] for r in rows}
        yield pa.RecordBatch.from_arrays([pa.array(list(chosen), pa.string()), pa.array(list(chosen.values()), pa.float64()), pa.array([p[t] * w for t, w in chosen.items()], pa.float64())], ["term", "weight", "gain"])

    merged = good.select("term", "p", "n").repartition(4, F.substring("term", 1, SHORTEST)).mapInArrow(merge, "term string, weight double, gain double")
    rows = merged.orderBy(F.desc("gain"), F.desc(F.length("term")), "term").limit(most).collect()
    return {r["term"]: r["weight"] for r in rows}


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, most: int = TRAIN_DOCS, exceptions: Sequence[str] = EXCEPTIONS) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the coefficients of the score, from at most ``most`` labelled documents."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = labelled_sample(docs, labels, "toxic", folds, held, most).repartition(4, "label", F.xxhash64("doc_id"))
    counts, positives, negatives = term_counts(sample)
    lexicon = Lexicon(learn_terms(counts, positives, negatives), exceptions)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, tuple(exceptions)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in batches:
            x = [own.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), batch.column(2)], ["a", "b", "label"])

    seen = sorted(tuple(r) for r in sample.mapInArrow(features, "a double, b double, label int").collect())
    return lexicon, _logistic(np.array([s[:2] for s in seen]).reshape(-1, 2), np.array([s[2] for s in seen], float))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    design, theta = np.concatenate([x, np.ones((len(x), 1))], axis=1), np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(3)
        theta += np.clip(np.linalg.solve(h, design.T @ (y - p) - 1e-2 * theta), -1, 1)
    return theta


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, exceptions, theta = shared.value
        lexicon = Lexicon(terms, exceptions)
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(x @ theta[:2] + theta[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1, exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, learned from ``labels`` (doc_id, toxic).

    The score is a logistic function of the weights of a text's matches, summed and per word. Learning reads
    ``TRAIN_DOCS`` labelled rows and keeps ``MOST_TERMS`` terms of ``SHORTEST`` to ``LONGEST`` letters, documented
    bounds of the model alone: every text is scored whole, however long. Null and empty texts have no match. Terms
    that tie rank by length, then by letters. Without toxic labels there are no terms and all score alike. Repeated
    rows score alike, a null doc_id counts as not held out and is never trained on, an empty table gives
    no rows; other columns are ignored. Of contradicting labels the smallest counts.
    """
    lexicon, theta = train(docs, labels, folds, held, exceptions=exceptions)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, tuple(exceptions), theta))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), f"doc_id {kind}, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
