"""Linear models of every fold and grid value from Gram matrices by fold: one pass to tune, one to measure."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workers import map_arrow

#: Penalties that are searched (fixed values).
LINEAR_GRIDS: dict[str, dict[str, list[float]]] = {
    "Ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "Lasso": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "ElasticNet": {"alpha": [0.1, 1.0, 10.0], "l1_ratio": [0.2, 0.5, 0.8]},
}
#: What a model has where nothing is searched.
DEFAULTS: dict[str, dict[str, float]] = {
    "LinearRegression": {},
    "Ridge": {"alpha": 1.0},
    "KernelRidge": {"alpha": 1.0},
    "Lasso": {"alpha": 1.0},
    "ElasticNet": {"alpha": 1.0, "l1_ratio": 0.5},
}


@dataclass
class FoldGrams:
    """Sums of products of (features, label, 1) by fold, features and label about ``shift``."""

    grams: np.ndarray
    shift: np.ndarray

    @property
    def splits(self) -> int:
        return len(self.grams) - 1

    def before(self, fold: int) -> np.ndarray:
        """The Gram matrix of all rows before a fold: what a model tested on it is trained on."""
        return self.grams[:fold].sum(0)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    return batch.column(0).to_numpy(zero_copy_only=False), x, batch.column(2).to_numpy(zero_copy_only=False)


def _rows(folds: DataFrame) -> DataFrame:
    return folds.filter("label is not null and fold is not null").select(F.col("fold").cast("int").alias("fold"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))


def fold_grams(folds: DataFrame) -> FoldGrams:
    """Gram matrices of ``folds`` (fold from 0, features, label); rows without a label or fold are left out.

    Tasks add up numpy products and Spark adds up the tasks' cells; the driver gets folds * (features + 2)^2 numbers,
    however many rows there are. Products are taken about the means, so that large values keep their digits.
    A table without rows has no folds (``splits`` is -1).
    """
    rows = _rows(folds)
    some = folds.filter("label is not null and fold is not null")
    if some.isEmpty():
        return FoldGrams(np.zeros((0, 2, 2)), np.zeros(1))
    mean = some.agg(Summarizer.mean(F.col("features")).alias("x"), F.avg("label").alias("y"), F.max("fold").alias("k")).first()
    shift = np.append(mean["x"].toArray(), mean["y"])
    d = len(shift) + 1

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, x, y = _arrays(batch)
            z = np.column_stack([x - shift[:-1], y - shift[-1], np.ones(len(y))])
            for k in np.unique(fold):
                part = z[fold == k]
                total[int(k)] = total.get(int(k), 0) + part.T @ part
        for k, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, k, np.int32)), pa.array(np.arange(d * d)), pa.array(g.ravel())], names=["fold", "cell", "value"])

    grams = np.zeros((mean["k"] + 1, d * d))
    for r in map_arrow(rows, products, "fold int, cell long, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).collect():
        grams[r["fold"], r["cell"]] = r["value"]
    return FoldGrams(grams.reshape(-1, d, d), shift)


def descend(a: np.ndarray, b: np.ndarray, n: float, l1: float, l2: float, sweeps: int = 20_000) -> np.ndarray:
    """Least (w'aw - 2w'b) / 2n + l1 |w| + l2 w'w / 2, by coordinates until none moves by more than rounding.

    A coordinate that no row varies in stays 0.
    """
    w, slope = np.zeros(len(b)), b.astype(float).copy()  # slope: b - a w
    scale = np.diag(a) / n
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if scale[j] + l2 <= 0:
                continue
            pull = slope[j] / n + scale[j] * w[j]
            to = np.sign(pull) * max(abs(pull) - l1, 0.0) / (scale[j] + l2)
            step = to - w[j]
            if step:
                slope -= a[:, j] * step
                w[j] = to
                moved = max(moved, abs(step) * np.sqrt(scale[j]))
        if moved <= 1e-13 * max(float((np.abs(w) * np.sqrt(scale)).max(initial=0)), 1e-300):
            break
    return w


def coefficients(grams: FoldGrams, fold: int, family: str, values: dict[str, float] | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of a model of ``family`` on the rows before ``fold``.

    Ridge adds alpha |w|^2 to the sum of squares; lasso and elastic net add their penalties to half the mean square.
    """
    values = DEFAULTS[family] | (values or {})
    g, s = grams.before(fold), grams.shift
    n, centre, mean = g[-1, -1], g[-1, :-2], g[-1, -2]
    d = len(centre)
    if not n:
        return np.zeros(d), 0.0
    if family == "KernelRidge":  # no intercept: about zero instead of the shift
        a = g[:d, :d] + np.outer(s[:-1], centre) + np.outer(centre, s[:-1]) + n * np.outer(s[:-1], s[:-1])
        b = g[:d, d] + s[:-1] * mean + centre * s[-1] + n * s[:-1] * s[-1]
        return np.linalg.lstsq(a + values["alpha"] * np.eye(d), b, rcond=None)[0], 0.0
    a, b = g[:d, :d] - np.outer(centre, centre) / n, g[:d, d] - centre * mean / n
    if family in ("LinearRegression", "Ridge"):
        unit = np.sqrt(np.maximum(np.diag(a) + values.get("alpha", 0.0), 1e-300))
        w = np.linalg.lstsq((a + values.get("alpha", 0.0) * np.eye(d)) / np.outer(unit, unit), b / unit, rcond=None)[0] / unit
    else:
        share = values.get("l1_ratio", 1.0)
        w = descend(a, b, n, values["alpha"] * share, values["alpha"] * (1 - share))
    return w, float(s[-1] + mean / n - w @ (s[:-1] + centre / n))


def fold_rmse(grams: FoldGrams, fold: int, w: np.ndarray, intercept: float) -> float:
    """Root mean square error of a model on a fold, from the fold's own Gram matrix."""
    g, s = grams.grams[fold], grams.shift
    z = np.concatenate([-w, [1.0, s[-1] - w @ s[:-1] - intercept]])
    return float(np.sqrt(max(z @ g @ z, 0.0) / g[-1, -1])) if g[-1, -1] else float("nan")


def choices(grid: dict[str, list[float]]) -> list[dict[str, float]]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def tune_linear(grams: FoldGrams, family: str, grid: dict[str, list[float]] | None = None) -> tuple[dict[str, float], list[float]]:
    """The grid values of least mean RMSE over the time folds (ties: the first), and the RMSE of each; no pass over rows."""
    tried = choices(grid if grid is not None else LINEAR_GRIDS.get(family, {}))
    if grams.splits < 1:
        return tried[0], [float("nan")] * len(tried)
    scores = [float(np.mean([fold_rmse(grams, k, *coefficients(grams, k, family, v)) for k in range(1, grams.splits + 1)])) for v in tried]
    return tried[int(np.argmin(scores))], scores


def measure_linear(folds: DataFrame, grams: FoldGrams, models: list[tuple[str, dict[str, float]]]) -> list[dict[str, float]]:
    """Mean CV_R2, CV_RMSE and CV_MAE over the time folds of each (family, values), all in one pass.

    A fold without rows or, for R2, without spread has no measure; without any fold there are none.
    """
    k, m = grams.splits, len(models)
    if k < 1 or not m:
        return [{} for _ in models]
    fitted = [[coefficients(grams, f, family, values) for family, values in models] for f in range(1, k + 1)]
    weights = np.array([[w for w, _ in row] for row in fitted])
    starts = np.array([[b for _, b in row] for row in fitted])

    def errors(batches):
        total = np.zeros((k, m, 2))
        for batch in batches:
            fold, x, y = _arrays(batch)
            for f in range(1, k + 1):
                at = fold == f
                gap = y[at, None] - x[at] @ weights[f - 1].T - starts[f - 1]
                total[f - 1] += np.stack([(gap**2).sum(0), np.abs(gap).sum(0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    sums = np.zeros(k * m * 2)
    for r in map_arrow(_rows(folds).filter("fold > 0"), errors, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        sums[r["cell"]] = r["value"]
    squares, absolute = np.moveaxis(sums.reshape(k, m, 2), 2, 0)
    n = grams.grams[1:, -1, -1]
    spread = grams.grams[1:, -2, -2] - grams.grams[1:, -1, -2] ** 2 / np.where(n > 0, n, 1)
    full, varied = n > 0, (n > 0) & (spread > 0)
    mean = lambda v, at: float(v[at].mean()) if at.any() else float("nan")
    n, spread = np.where(n > 0, n, 1), np.where(spread > 0, spread, 1)
    return [{"CV_R2": mean(1 - squares[:, i] / spread, varied), "CV_RMSE": mean(np.sqrt(squares[:, i] / n), full), "CV_MAE": mean(absolute[:, i] / n, full)} for i in range(m)]
