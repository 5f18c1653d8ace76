"""Toxicity by a convolutional text classifier trained in numpy.

Words and their beginnings are hashed into embedding tables whose rows are joined, convolved by filters of one, two and three words, max
pooled over the whole text, and weighed by a logistic output. Training is minibatch Adam
on the driver over a bounded, hash-chosen sample of labelled rows; the model (some MB whatever the
corpus) is broadcast and scores whole texts in Arrow batches. Thresholds of F1 are calibrated by
language on all labelled rows outside the held-out fold and the training sample, from histograms of scores; one id in
CALIBRATION is never trained on. Each language's histogram is joined by the common one at the weight of PRIOR_TOXIC toxic rows, so
small languages lean on it. Language is never an input of the score.

Defined results: null, empty and wordless texts score as a text of padding; a null id is never held
out; rows of one id each give a row; without labelled rows of both classes all scores are the base rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workers import map_arrow
from .bytetext import ALNUM, RangeHash, U, chunks, column_bytes, words
from .labelled import agreed, fold, training_ids, with_texts
from .shared import materialise

#: Embedding tables of 2**TABLE_BITS rows: two by hashes of the word, the others by its first bytes.
TABLE_BITS, PART, FILTERS, WIDTHS = 16, 6, 12, (1, 2, 3)
BEGINNINGS = (4, 5)
TABLES = 2 + len(BEGINNINGS)
#: Labelled rows to train on at most, passes over them, and steps at least.
SAMPLE_ROWS, EPOCHS, LEAST_STEPS, BATCH, RATE = 12_000, 6, 500, 48, 0.01
PAD = max(WIDTHS)
#: Training texts that must hold a table row for it to be learnt.
LEAST_TEXTS = 4
#: One id in so many is kept for calibration; toxic rows' worth of the common histogram in each language's; bins to a unit of the logit.
CALIBRATION, PRIOR_TOXIC, BINS = 5, 20, 64


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word and of PAD paddings after each text (row 0), and offsets of texts."""
    starts, ends, hashes, bounds = words(data, offsets, ALNUM)
    n = len(bounds) - 1
    at = np.arange(len(hashes)) + PAD * np.repeat(np.arange(n), np.diff(bounds))
    codes = np.zeros((len(hashes) + PAD * n, TABLES), np.int32)
    top = U((1 << TABLE_BITS) - 1)
    codes[at, 0] = (hashes >> U(40)) % top + U(1)
    codes[at, 1] = (hashes & U(0xFFFFFF)) % top + U(1)
    if len(hashes):
        folded = RangeHash(ALNUM[data])
        for k, size in enumerate(BEGINNINGS):
            codes[at, 2 + k] = (folded(starts, np.minimum(ends, starts + size)) >> U(24)) % top + U(1)
    return codes, bounds + PAD * np.arange(n + 1)


@dataclass
class Model:
    tables: np.ndarray  # (TABLES, rows, PART)
    kernels: list[np.ndarray]  # of each width: (width, TABLES * PART, FILTERS)
    bias: np.ndarray  # (widths, FILTERS)
    out: np.ndarray  # (widths * FILTERS)
    base: float

    def embed(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([t[codes[:, k]] for k, t in enumerate(self.tables)], axis=1)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each width the filters' responses by first word."""
        out = []
        for k, kernel in zip(range(len(WIDTHS)), self.kernels, strict=True):
            n = len(x) - WIDTHS[k] + 1
            r = x[:n] @ kernel[0]
            for j in range(1, WIDTHS[k]):
                r += x[j : j + n] @ kernel[j]
            out.append(r)
        return out

    def logits(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        pooled = []
        responses = self.responses(self.embed(codes))
        # a window lies in its text and padding; those that would reach into the next text do not count
        for k, r in enumerate(responses):
            r = np.concatenate([r, np.full((PAD, FILTERS), -1e9, np.float32)])
            for j in range(1, WIDTHS[k]):
                r[bounds[1:] - j] = -1e9
            pooled.append(np.maximum(np.maximum.reduceat(r, bounds[:-1], axis=0) + self.bias[k], 0))
        return np.concatenate(pooled, axis=1) @ self.out + self.base

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, bounds = word_codes(data, offsets)
        return 1 / (1 + np.exp(-np.clip(self.logits(codes, bounds), -30, 30).astype(np.float64)))


def train(texts: list[tuple[np.ndarray, int]], seed: int = 3) -> Model:
    """A model from (codes with padding, label) of each text; base rates as given."""
    rng = np.random.default_rng(seed)
    rows, wide = 1 << TABLE_BITS, TABLES * PART
    y = np.array([t[1] for t in texts], np.float32)
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Model(
        rng.normal(0, 0.1, (TABLES, rows, PART)).astype(np.float32),
        [rng.normal(0, 0.3, (w, wide, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros((len(WIDTHS), FILTERS), np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        float(np.log(rate / (1 - rate))),
    )
    if len(set(y.tolist())) < 2:
        model.out[:] = 0
        return model
    # rows of words that few texts hold stay zero: they could only be learnt by heart
    seen = np.zeros((TABLES, rows), np.int32)
    for codes, _ in texts:
        for k in range(TABLES):
            seen[k, np.unique(codes[:, k])] += 1
    rare = seen < LEAST_TEXTS
    rare[:, 0] = True
    model.tables[rare] = 0
    state: dict = {}

    def adam(key, value: np.ndarray, grad: np.ndarray, step: int) -> None:
        m, v = state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    sizes = np.array([len(t[0]) for t in texts])
    base = np.array([model.base], np.float32)
    step = 0
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // len(texts))):
        # texts of like length together, batches in random order
        order = np.argsort(sizes * rng.uniform(0.8, 1.25, len(sizes)))
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for g in rng.permutation(len(groups)):
            pick = groups[g]
            step += 1
            codes = np.concatenate([texts[i][0] for i in pick])
            bounds = np.concatenate([[0], np.cumsum(sizes[pick])])
            x = model.embed(codes)
            pooled, argmax = [], []
            for k, r in enumerate(model.responses(x)):
                best = np.array([r[s : e - WIDTHS[k] + 1].argmax(0) + s for s, e in zip(bounds[:-1], bounds[1:], strict=True)])
                argmax.append(best)
                pooled.append(r[best, np.arange(FILTERS)] + model.bias[k])
            h = np.concatenate(pooled, axis=1)
            active = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model.out + base[0], -30, 30)))
            d = ((p - y[pick]) / len(pick)).astype(np.float32)
            d_h = np.outer(d, model.out) * (h > 0)
            grads_k = []
            d_b = np.zeros_like(model.bias)
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            for k, w in enumerate(WIDTHS):
                g_h = d_h[:, k * FILTERS : (k + 1) * FILTERS]
                d_b[k] = g_h.sum(0)
                grad = np.zeros_like(model.kernels[k])
                for j in range(w):
                    at = argmax[k] + j
                    grad[j] = np.einsum("bfd,bf->df", x[at], g_h)
                    touched.append((codes[at].reshape(-1, TABLES), (g_h[..., None] * model.kernels[k][j].T[None]).reshape(-1, wide)))
                grads_k.append(grad)
            hit = np.concatenate([t[0] for t in touched])
            grad_x = np.concatenate([t[1] for t in touched])
            grad_t = np.zeros_like(model.tables)
            for k in range(TABLES):
                np.add.at(grad_t[k], hit[:, k], grad_x[:, k * PART : (k + 1) * PART])
            grad_t[rare] = 0
            adam("out", model.out, active.T @ d + 1e-4 * model.out, step)
            adam("base", base, np.array([d.sum()], np.float32), step)
            adam("bias", model.bias, d_b, step)
            for k, grad in enumerate(grads_k):
                adam(k, model.kernels[k], grad, step)
            adam("tables", model.tables, grad_t, step)
            model.base = float(base[0])
    return model


def best_threshold(bins: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> float:
    """The score from which on calling toxic gives the best F1, from a histogram of logits (bins rising)."""
    hits, called = np.cumsum(toxic[::-1]), np.cumsum(rows[::-1])
    i = len(bins) - 1 - int(np.argmax(2 * hits / (called + toxic.sum())))
    logit = (bins[i] + (bins[i - 1] + 1 if i else bins[i])) / 2 / BINS
    return float(1 / (1 + np.exp(-logit)))


def thresholds(counts: list[tuple[str | None, int, float, float]]) -> tuple[float, dict[str, float]]:
    """The common threshold and that of each language, from (lang, bin, rows, toxic rows); 0.5 without rows of both classes."""
    bins = np.unique([c[1] for c in counts])
    of: dict[str, np.ndarray] = {}
    for lang, b, rows, toxic in counts:
        of.setdefault(lang or "", np.zeros((2, len(bins))))[:, np.searchsorted(bins, b)] += (rows, toxic)
    every = sum(of.values(), np.zeros((2, len(bins))))
    total, hits = every.sum(1)
    if not 0 < hits < total:
        return 0.5, {}
    return best_threshold(bins, *every), {lang: best_threshold(bins, *(h + every * (PRIOR_TOXIC / hits))) for lang, h in of.items() if lang}


def fit(sample: DataFrame) -> Model:
    """A model from (text, lang, y), whatever the order of the rows."""
    rows = sample.select("text", "y").toArrow().sort_by([("text", "ascending"), ("y", "ascending")])
    codes, y = [], rows.column("y").to_pylist()
    data, offsets = column_bytes(rows.column("text"))
    for i, j in chunks(offsets):
        c, b = word_codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        codes += [c[s:e] for s, e in zip(b[:-1], b[1:], strict=True)]
    return train([(c, int(t)) for c, t in zip(codes, y, strict=True)])


def _score(model):
    def run(batches):
        m: Model = model.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            scores = [m.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, 1 << 19)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(score)], names=["doc_id", "lang", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged) for every row of ``docs`` (doc_id, text, lang).

    ``flagged`` applies the language's calibrated threshold, ``predicted`` that of 0.5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    spark = docs.sparkSession
    ids = materialise(training_ids(docs, labels, "toxic", folds, held_out, sample_rows, CALIBRATION), "trained")
    model = spark.sparkContext.broadcast(fit(with_texts(docs, ids)))
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out")
    scored = materialise(map_arrow(docs.select("doc_id", "text", "lang", held), _score(model), "doc_id long, lang string, held_out boolean, score double"), "scored")
    checks = scored.filter("doc_id is not null and not held_out").join(agreed(labels, "toxic"), "doc_id").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_anti")
    bins = F.floor(F.ln(F.col("score") / (1 - F.col("score"))) * BINS).alias("bin")
    common, own = thresholds([tuple(r) for r in checks.groupBy("lang", bins).agg(F.count(F.lit(1)), F.sum("y")).collect()])
    table = spark.createDataFrame(sorted(own.items()), "lang string, own double")
    out = scored.join(F.broadcast(table), "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(common)))  # a row a language
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
