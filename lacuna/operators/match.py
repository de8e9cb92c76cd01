"""Matching data events to all places of the training images: scores, distances and the best of them.

The events of a query set are sent to all tasks in blocks of bounded size; each task scores its places
against a block with array arithmetic and keeps the best few per event, and a window over those picks the
final ones. No pair of event and place is ever a row of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import materialise

BLOCK = 4096


@dataclass(frozen=True)
class Layout:
    """Weights by place in a pattern, and which places hold categories."""

    weights: tuple[float, ...]
    categorical: tuple[bool, ...]

    @staticmethod
    def of(offset_weights: Sequence[float], kinds: Sequence[str]) -> Layout:
        """From weights by offset and the kind of each variable (``num`` or ``cat``)."""
        return Layout(tuple(float(w) for w in offset_weights for _ in kinds), tuple(k == "cat" for _ in offset_weights for k in kinds))


@dataclass(frozen=True)
class Similarity:
    """Higher is better: minus the weighted squared differences, plus the weights of equal categories.

    With ``compensate``, what is missing in place or event doesn't count, and the score is
    -|penalty / support**4|, where equal categories reduce nothing and different ones cost their weight.
    Without, a place must be complete wherever the event is informed.
    """

    layout: Layout
    compensate: bool = False

    def __call__(self, event: np.ndarray, place: np.ndarray) -> np.ndarray:
        has_e, has_p = ~np.isnan(event), ~np.isnan(place)
        ve, vp = has_e.astype(float), has_p.astype(float)
        weight = np.array(self.layout.weights)
        left, right = [], []  # the score is a product of two matrices: one column pair per term of each place of a pattern
        for j, (w, cat) in enumerate(zip(self.layout.weights, self.layout.categorical, strict=True)):
            e, p = np.where(has_e[:, j], event[:, j], 0.0), np.where(has_p[:, j], place[:, j], 0.0)
            if cat:
                for c in np.unique(e[has_e[:, j]]):
                    left.append(w * (ve[:, j] * (e == c)))
                    right.append(vp[:, j] * (p == c))
                if self.compensate:
                    left.append(-w * ve[:, j])
                    right.append(vp[:, j])
            else:
                left += [-w * e * e * ve[:, j], -w * ve[:, j], 2 * w * e]
                right += [vp[:, j], p * p, p]
        score = np.stack(left, axis=1) @ np.stack(right) if left else np.zeros((len(event), len(place)))
        if self.compensate:
            support = (ve * weight) @ vp.T
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(support > 0, -np.abs(score / support**4), -np.inf)
        return np.where(ve @ (1 - vp).T > 0, -np.inf, score)


@dataclass(frozen=True)
class Distance:
    """Lower is better: the mean over variables of a weighted Lp mean or share of unequal categories.

    A place is out (infinite) if it lacks a value where the event has one of positive weight. Variables
    without an informed neighbour don't count.
    """

    layout: Layout
    variables: int
    power: float = 2.0

    def __call__(self, event: np.ndarray, place: np.ndarray) -> np.ndarray:
        total = np.zeros((len(event), len(place)))
        active = np.zeros((len(event), 1))
        bad = np.zeros(total.shape, bool)
        for v in range(self.variables):
            part, weight, cat = np.zeros_like(total), np.zeros((len(event), 1)), False
            for j in range(v, len(self.layout.weights), self.variables):
                w, cat = self.layout.weights[j], self.layout.categorical[j]
                e, p = event[:, j, None], place[None, :, j]
                informed = ~np.isnan(e) & (w > 0)
                gap = (e != p).astype(float) if cat else np.abs(e - p) ** self.power
                part += np.where(informed & ~np.isnan(p), w * gap, 0.0)
                weight += np.where(informed, w, 0.0)
                bad |= informed & np.isnan(p)
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = part / weight
            total += np.where(weight > 0, mean if cat else mean ** (1 / self.power), 0.0)
            active += weight > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(bad | (active == 0), np.inf, total / active)


def _best(score: np.ndarray, cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest finite scores per row, the smallest cell first among equals."""
    n = score.shape[1]
    rows, columns = [], []
    cut = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -np.inf)
    for i in range(len(score)):
        at = np.flatnonzero((score[i] >= cut[i]) & np.isfinite(score[i]))
        at = at[np.lexsort((cells[at], -score[i, at]))[:k]]
        rows.append(np.full(len(at), i))
        columns.append(at)
    return np.concatenate(rows), np.concatenate(columns)


def _scan(shared, measure: Callable, k: int, largest: bool, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, events = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(0).to_numpy()
            place = np.array(batch.column(1).to_pylist(), dtype=float)
            step = max(1, (1 << 21) // max(1, len(cells)))
            for a in range(0, len(ids), step):
                score = np.round(measure(events[a : a + step], place), digits)
                r, c = _best(score if largest else -score, cells, min(k, len(cells)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + r]), pa.array(cells[c]), pa.array(score[r, c])], ["target", "cell", "score"])

    return run


def best_matches(events: DataFrame, places: DataFrame, measure: Callable, k: int, largest: bool = True, digits: int = 9) -> DataFrame:
    """(target, rank, cell, score): the k best places (cell, p) for every event (target, p).

    Scores are rounded to ``digits``; equal ones rank by cell. Null values of a pattern are missing.
    Places that a measure rules out never occur. Events are handled in blocks of ``BLOCK``, each one pass
    over the places. Where all is categories, patterns are few and their copies many: equal patterns have equal scores, so each
    different event is compared once, with the first k places of each different pattern.
    """
    if all(measure.layout.categorical):
        same = W.partitionBy("p").orderBy("cell")
        first = materialise(places.select(F.col("cell").cast("long").alias("cell"), "p").withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= k).drop("_nth"))
        alike = materialise(events.groupBy("p").agg(F.min("target").alias("_like"), F.collect_list("target").alias("_targets")))
        best = _best_of(alike.select(F.col("_like").alias("target"), "p"), first, measure, k, largest, digits)
        each = alike.select("_like", F.explode("_targets").alias("target"))
        return each.join(best.withColumnRenamed("target", "_like"), "_like").select("target", "rank", "cell", "score")
    return _best_of(events, places, measure, k, largest, digits)


def _best_of(events: DataFrame, places: DataFrame, measure: Callable, k: int, largest: bool, digits: int) -> DataFrame:
    spark = places.sparkSession
    blocks = max(1, -(-events.count() // BLOCK))
    out = None
    for b in range(blocks):
        own = (events.where(F.pmod(F.xxhash64("target"), F.lit(blocks)) == b) if blocks > 1 else events).select("target", "p").collect()
        width = len(own[0]["p"]) if own else 1
        shared = spark.sparkContext.broadcast((np.array([r["target"] for r in own], np.int64), np.array([r["p"] for r in own], dtype=float).reshape(len(own), width)))
        found = places.select(F.col("cell").cast("long"), "p").mapInArrow(_scan(shared, measure, k, largest, digits), "target long, cell long, score double")
        out = found if out is None else out.unionByName(found)
    order = F.desc("score") if largest else F.asc("score")
    rank = F.row_number().over(W.partitionBy("target").orderBy(order, "cell"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("target", F.col("rank").cast("int").alias("rank"), "cell", "score")
