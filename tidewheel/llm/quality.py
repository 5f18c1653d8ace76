"""Document quality by Bradley-Terry pairwise ranking.

A document is a vector of shape features of its whole text (no vocabulary, language or source). Preference
pairs take a good and a bad document of a bounded, hash-chosen sample of labelled rows; weights
minimise the logistic loss on feature differences. Documents are accepted above a quantile of
the scores of all documents, the one of best accuracy on all labelled rows outside the held-out fold; scores are mapped to 0..1 by a
logistic curve whose 0.7 lies at that quantile.

Defined results: null and empty texts have all features 0 and are scored like others; a null
id is never held out; rows of one id each give a row; without labelled rows of both classes all scores are 0.7.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workers import map_arrow
from .bytetext import BLANKS, chunks, column_bytes, words
from .labelled import agreed, fold, training_sample
from .shared import materialise

SAMPLE_ROWS, PAIRS, STEPS = 20_000, 60_000, 300
#: Bins of the score histogram to a standard deviation of the training scores.
BINS = 200
#: Score of the accepted quantile.
CUT = 0.7

_KIND = np.full(256, 5, np.uint8)  # others: marks
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[range(ord("a"), ord("z") + 1)] = 1
_KIND[range(ord("A"), ord("Z") + 1)] = 2
_KIND[range(ord("0"), ord("9") + 1)] = 3
_KIND[128:] = 4
#: Marks of running prose.
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 6
_KIND[ord("\n")] = 7


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape features of each row's text, each within about 0..1 or a logarithm."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    kinds = _KIND[data]
    out = [np.log1p(np.diff(offsets))]
    for k in range(8):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        out.append(np.diff(total[offsets]) / size)
    starts, ends, hashes, bounds = words(data, offsets, BLANKS)
    many = np.diff(bounds)
    count = np.maximum(many, 1).astype(np.float64)
    length = np.concatenate([[0.0], np.cumsum(ends - starts)])
    squares = np.concatenate([[0.0], np.cumsum((ends - starts).astype(np.float64) ** 2)])
    mean = np.diff(length[bounds]) / count
    out += [mean / 10, np.sqrt(np.maximum(np.diff(squares[bounds]) / count - mean**2, 0)) / 10]
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[bounds[:-1][bounds[:-1] < len(hashes)]] = False
    marks = np.concatenate([[0], np.cumsum((kinds == 5) | (kinds == 3))])
    marked = (marks[ends] - marks[starts]) > 0 if len(ends) else np.zeros(0, bool)
    upper = np.concatenate([[0], np.cumsum(kinds == 2)])
    shouted = (upper[ends] - upper[starts]) > 1 if len(ends) else np.zeros(0, bool)
    short = (ends - starts) <= 3
    for flag in (again, marked, shouted, short):
        total = np.concatenate([[0], np.cumsum(flag)])
        out.append(np.diff(total[bounds]) / count)
    distinct, top = np.zeros(n), np.zeros(n)
    for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if e > s:
            x = np.sort(hashes[s:e])
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            distinct[i] = (len(edge) - 1) / (e - s) ** 0.8
            top[i] = np.diff(edge).max() / (e - s)
    out += [distinct, top, np.log1p(many)]
    return np.stack(out, axis=1)


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([z, np.abs(z), np.tanh(3 * z)], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ranker:
    """Strengths from features and labels: logistic loss on differences of PAIRS preference pairs."""
    mean, spread = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(1), np.ones(1))
    ranker = Ranker(mean, spread, np.zeros(3 * x.shape[1]), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return ranker
    rng = np.random.default_rng(seed)
    z = ranker.expand(x)
    difference = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, STEPS + 1):
        some = difference[rng.choice(PAIRS, 4096)]
        p = 1 / (1 + np.exp(np.clip(some @ ranker.weights, -30, 30)))
        grad = -(some * p[:, None]).mean(0) + 1e-3 * ranker.weights
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        ranker.weights = ranker.weights - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    s = z @ ranker.weights
    ranker.slope = 2.0 / max(float(s.std()), 1e-6)
    return ranker


def best_cut(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Of the borders of a histogram over all documents (bins rising) that of best accuracy on its labelled rows, in bins.

    Of equal accuracies it is the lowest, in the middle of the gap between labelled rows.
    """
    right = np.concatenate([[0], np.cumsum(bad)]) + good.sum() - np.concatenate([[0], np.cumsum(good)])
    k = int(np.argmax(right))
    if not k:
        return float(bins[0])
    above = np.flatnonzero((good + bad)[k:] > 0)
    return float((bins[k - 1] + 1 + (bins[k + above[0]] if len(above) else bins[k - 1] + 1)) / 2)


def _strengths(ranker: Ranker, docs: DataFrame) -> DataFrame:
    """(doc_id, strength) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def place(batches):
        r: Ranker = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            got = [r.strength(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else np.zeros(0))], names=["doc_id", "strength"])

    return map_arrow(docs.select("doc_id", "text"), place, "doc_id long, strength double")


def _set_cut(ranker: Ranker, placed: DataFrame, labels: DataFrame, folds: int, held_out: int) -> Ranker:
    """``ranker`` with the cut from a histogram of the strengths (doc_id, strength) of all rows."""
    if not ranker.weights.any():
        return ranker
    width = 2.0 / ranker.slope / BINS
    known = agreed(labels, "quality").filter(fold(F.col("doc_id"), folds) != held_out)
    # strengths are bounded by the clipped features, so the bins are few
    binned = placed.select("doc_id", F.floor(F.col("strength") / F.lit(width)).alias("bin"))
    rows = binned.join(known, "doc_id", "left").groupBy("bin").agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).collect()
    if rows:
        bins, good, bad = np.array(sorted(tuple(r) for r in rows), np.int64).T
        if good.any() or bad.any():
            ranker.cut = best_cut(bins, good, bad) * width
    return ranker


def _score(ranker: Ranker) -> Column:
    """The score of a strength: a logistic curve that is CUT at the cut."""
    x = F.lit(float(ranker.slope)) * (F.col("strength") - F.lit(float(ranker.cut))) + F.lit(float(np.log(CUT / (1 - CUT))))
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def _learn(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, sample_rows: int) -> Ranker:
    def extract(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            got = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(list(np.concatenate(got)), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    sample = training_sample(docs, labels, "quality", folds, held_out, sample_rows).select("text", "y")
    rows = map_arrow(sample, extract, "x array<double>, y int").toPandas()
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, width)
    order = np.lexsort(x.T) if len(x) else []
    return fit(x[order], rows["y"].to_numpy(np.int64)[order])


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    ranker = _learn(docs, labels, folds, held_out, sample_rows)
    placed = materialise(_strengths(ranker, docs), "strengths")
    ranker = _set_cut(ranker, placed, labels, folds, held_out)
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out")
    return placed.select("doc_id", held, _score(ranker).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows whose text the ranker rejects; all columns stay, whatever their names."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    learned = _learn(named, labels, 4, 2, sample_rows)
    ranker = docs.sparkSession.sparkContext.broadcast(_set_cut(learned, _strengths(learned, named), labels, 4, 2))
    names = docs.columns
    at = names.index("text")

    def keep(batches):
        r: Ranker = ranker.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(at))
            scores = [r.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in chunks(offsets)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= CUT))

    return map_arrow(docs, keep, docs.schema)
