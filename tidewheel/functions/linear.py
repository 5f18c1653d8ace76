"""Normal equations: Gram matrices in one aggregation, small algebra on the driver."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workers import map_arrow

#: Columns up to which all products are sums of one aggregation; more would be too much generated code.
MOST_SUMS = 24


def _gram_of_blocks(rows: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """The same from numpy products: one matrix a task, added up by Spark cell by cell."""

    def products(batches):
        total, n = np.zeros((d, d)), 0
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "value"])

    cells = map_arrow(rows, products, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    got = np.zeros(d * d + 1)
    for r in cells:
        got[r["cell"]] = r["value"]
    return got[:-1].reshape(d, d), int(got[-1])


def gram_of(df: DataFrame, exprs: list[Column]) -> tuple[np.ndarray, int]:
    """Sums of products of all pairs over rows where every expression is non-null, and the number of rows."""
    d = len(exprs)
    rows = df.select(*[e.cast("double").alias(f"x{i}") for i, e in enumerate(exprs)]).dropna()
    if d > MOST_SUMS:
        return _gram_of_blocks(rows, d)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    g = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            g[i, j] = g[j, i] = sums[f"s{i}_{j}"] or 0.0
    return g, sums["n"]


def gram(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int, np.ndarray]:
    """Gram matrix of columns on complete rows, number of rows, and column sums."""
    g, n = gram_of(df, [*[F.col(f"`{c}`") for c in cols], F.lit(1.0)])
    return g[:-1, :-1], n, g[-1, :-1]


def inverse_factors(g: np.ndarray, n: int, sums: np.ndarray, cols: list[str]) -> dict[str, float]:
    """Variance inflation: G_ii * (G^-1)_ii, centred when some column is constant."""
    d = len(cols)
    if not n or not d:
        return dict.fromkeys(cols, float("nan"))
    variance = np.diag(g) / n - (sums / n) ** 2
    constant = variance <= 1e-12 * np.maximum(np.diag(g) / n, 1e-300)
    if constant.any():
        g = g - np.outer(sums, sums) / n
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    unit = g / np.outer(scale, scale)
    out = {}
    for i, c in enumerate(cols):
        others = [j for j in range(d) if j != i]
        if constant.any() and constant[i]:
            out[c] = float("inf")
            continue
        explained = unit[i, others] @ np.linalg.lstsq(unit[np.ix_(others, others)], unit[others, i], rcond=None)[0] if others else 0.0
        out[c] = float("inf") if 1 - explained < 1e-12 else 1 / (1 - explained)
    return out


def ols(g: np.ndarray, n: int, target: int, features: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, standard errors and residual sum of squares from a Gram matrix."""
    a, b = g[np.ix_(features, features)], g[features, target]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    inverse = np.linalg.pinv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ b
    ssr = float(g[target, target] - beta @ b)
    error = np.sqrt(np.maximum(np.diag(inverse), 0) * max(ssr, 0.0) / max(n - len(features), 1))
    return beta, error, ssr


#: MacKinnon's polynomials for the constant-only case (fixed values).
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def adf_p_value(tau: float) -> float:
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    p = ADF_SMALL if tau <= ADF_STAR else ADF_LARGE
    return NormalDist().cdf(sum(c * tau**i for i, c in enumerate(p)))


def adf_critical(n: int) -> dict[str, float]:
    return {k: a + b / n + c / n**2 + d / n**3 for k, (a, b, c, d) in ADF_CRITICAL.items()}
