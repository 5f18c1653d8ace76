"""Profiles, correlations, outliers, collinearity and class balance; statistics of all columns in one pass."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.distinct import distinct_counts
from ..functions.linear import gram, inverse_factors
from ..functions.quantiles import exact_quantiles
from .columns import column_groups, one_row, q


def unpivot_row(one: DataFrame, cells: list[tuple[tuple, list[Column]]], names: list[str]) -> DataFrame:
    """A row of aggregates as rows: each cell gives literal keys and values for ``names``."""
    if not cells:
        return one.sparkSession.createDataFrame([], ", ".join(f"{n} {'string' if i == 0 else 'double'}" for i, n in enumerate(names)))
    rows = [F.struct(*[F.lit(k).alias(n) for k, n in zip(keys, names, strict=False)], *[v.alias(n) for v, n in zip(values, names[len(keys) :], strict=True)]) for keys, values in cells]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, type, n, missing, distinct) for every column, and a row ``*`` of rows, null cells and duplicate rows.

    One pass for all of it (``distinct_counts``); not exact, distinct values and duplicates are estimates from sketches.
    """
    cols, kinds = df.columns, dict(df.dtypes)
    one = distinct_counts(df, cols, exact)
    gone = lambda i: F.col("rows") - F.col(f"n{i}")
    repeats = F.greatest(F.col("rows") - F.col("distinct_rows"), F.lit(0))
    whole = (("*", "table"), [F.col("rows"), sum((gone(i) for i in range(len(cols))), F.lit(0)), repeats])
    cells = [((c, kinds[c]), [F.col(f"n{i}"), gone(i), F.col(f"d{i}")]) for i, c in enumerate(cols)]
    return unpivot_row(one, [*cells, whole], ["column", "type", "n", "missing", "distinct"])


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of numeric columns."""
    cols = cols if cols is not None else column_groups(df).numeric
    middle = quartiles(df, cols)
    quarter = lambda c, i: F.lit(middle[c][i] if c in middle else None).cast("double")
    stats = lambda c: [F.count(q(c)), F.avg(q(c)), F.stddev_samp(q(c)), F.min(q(c)).cast("double"), F.max(q(c)).cast("double")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[e.alias(f"{i}_{j}") for i, c in enumerate(cols) for j, e in enumerate(stats(c))])
    cell = lambda i, c: [*[F.col(f"{i}_{j}") for j in range(4)], *[quarter(c, j) for j in range(3)], F.col(f"{i}_4")]
    return unpivot_row(one, [((c,), cell(i, c)) for i, c in enumerate(cols)], ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def value_counts(df: DataFrame, col: str, top: int | None = 10) -> DataFrame:
    """(value, n, share) of the non-null values, commonest first, ties by value."""
    counts = df.filter(q(col).isNotNull()).groupBy(q(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(q(col))).first()[0]
    out = counts.withColumn("share", F.col("n") / F.lit(total))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def cardinality_report(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, distinct, share of the rows) of text columns; estimates where not ``exact``."""
    cols = cols if cols is not None else column_groups(df).string
    one = distinct_counts(df.select(*[q(c) for c in cols]), cols, exact) if cols else df.limit(0)
    return unpivot_row(one, [((c,), [F.col(f"d{i}"), F.try_divide(F.col(f"d{i}"), F.col("rows"))]) for i, c in enumerate(cols)], ["column", "distinct", "share"])


def statistical_summary(df: DataFrame, target: str) -> DataFrame:
    """(metric, value) of one column: location, spread, quartiles, shape and coefficient of variation in per cent."""
    c = q(target)
    low, middle, high = quartiles(df, [target]).get(target, (None, None, None))
    number = lambda x: F.lit(x).cast("double")
    stats = {
        "count": F.count(c).cast("double"),
        "mean": F.avg(c),
        "median": number(middle),
        "std": F.stddev_samp(c),
        "min": F.min(c).cast("double"),
        "max": F.max(c).cast("double"),
        "range": (F.max(c) - F.min(c)).cast("double"),
        "q1": number(low),
        "q3": number(high),
        "iqr": number(high) - number(low),
        "skewness": S.sample_skew(c),
        "kurtosis": S.sample_kurtosis(c),
        "cv": F.try_divide(F.stddev_samp(c), F.avg(c)) * 100,
    }
    one = df.agg(*[e.alias(n) for n, e in stats.items()])
    return unpivot_row(one, [((n,), [F.col(n)]) for n in stats], ["metric", "value"])


def skewness_report(df: DataFrame, limit: float = 0.5, cols: list[str] | None = None) -> DataFrame:
    cols = cols if cols is not None else column_groups(df).numeric
    one = df.agg(*[S.sample_skew(q(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    return unpivot_row(one, [((c,), [F.col(f"s{i}"), F.abs(F.col(f"s{i}")) > limit]) for i, c in enumerate(cols)], ["column", "skewness", "skewed"])


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, lower, upper, n, density) of equal-width bins; the last is closed; empty bins are left out."""
    ends = one_row(df, {"lo": F.min(q(col)).cast("double"), "hi": F.max(q(col)).cast("double"), "n": F.count(q(col))})
    lo, hi, n = ends["lo"], ends["hi"], ends["n"]
    if lo is None:
        lo = hi = 0.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((q(col).cast("double") - lo) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.filter(q(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"), "n", (F.col("n") / (F.lit(float(n or 1)) * width)).alias("density"))


def quartiles(df: DataFrame, cols: list[str], accuracy: int | None = None) -> dict[str, tuple[float, float, float]]:
    """First, second and third quartile by column, exact; ``accuracy`` asks for approximate ones of one pass."""
    if accuracy:
        got = one_row(df, {c: F.percentile_approx(q(c), [0.25, 0.5, 0.75], accuracy) for c in cols})
    else:
        got = exact_quantiles(df, {c: q(c) for c in cols}, [0.25, 0.5, 0.75])
    return {c: tuple(map(float, v)) for c, v in got.items() if v is not None}


def box_stats(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """One row: quartiles, whiskers (last value within k times the interquartile range) and outlier count."""
    got = quartiles(df, [col]).get(col, (0.0, 0.0, 0.0))
    lo, hi = got[0] - k * (got[2] - got[0]), got[2] + k * (got[2] - got[0])
    inside = q(col).between(lo, hi)
    return df.agg(
        F.lit(got[0]).alias("q1"), F.lit(got[1]).alias("median"), F.lit(got[2]).alias("q3"),
        F.min(F.when(inside, q(col))).cast("double").alias("whisker_low"), F.max(F.when(inside, q(col))).cast("double").alias("whisker_high"), F.count_if(~inside).alias("outliers"),
    )


def qq_points(df: DataFrame, col: str, points: int = 99) -> DataFrame:
    """(p, theoretical, sample): normal quantiles against quantiles of ``col`` on a fixed grid; no global sort."""
    grid = [(i + 1) / (points + 1) for i in range(points)]
    found = exact_quantiles(df, {col: q(col)}, grid)[col] or [None] * points
    rows = [(p, NormalDist().inv_cdf(p), v) for p, v in zip(grid, found, strict=True)]
    return df.sparkSession.createDataFrame(rows, "p double, theoretical double, sample double")


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(a, b, r) for all a < b by column order, on pairwise complete rows, in one pass."""
    cols = cols if cols is not None else column_groups(df).numeric
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    one = df.agg(*[F.corr(q(cols[i]), q(cols[j])).alias(f"r{i}_{j}") for i, j in pairs])
    return unpivot_row(one, [((cols[i], cols[j]), [S.not_nan(F.col(f"r{i}_{j}"))]) for i, j in pairs], ["a", "b", "r"])


def correlated_pairs(df: DataFrame, threshold: float = 0.8, inclusive: bool = True, cols: list[str] | None = None) -> DataFrame:
    """Pairs by absolute correlation, strongest first."""
    m = correlation_matrix(df, cols)
    return m.filter(F.abs("r") >= threshold if inclusive else F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "a", "b")


def target_correlation(df: DataFrame, target: str, top: int | None = None, cols: list[str] | None = None) -> DataFrame:
    """(column, r) with the target: descending by r, or the ``top`` by absolute value."""
    cols = [c for c in (cols if cols is not None else column_groups(df).numeric) if c != target]
    one = df.agg(*[F.corr(q(c), q(target)).alias(f"r{i}") for i, c in enumerate(cols)])
    rows = unpivot_row(one, [((c,), [S.not_nan(F.col(f"r{i}"))]) for i, c in enumerate(cols)], ["column", "r"])
    return rows.orderBy(F.desc(F.abs("r")), "column").limit(top) if top else rows.orderBy(F.desc("r"), "column")


def detect_leakage(df: DataFrame, target: str, threshold: float = 0.99, cols: list[str] | None = None) -> DataFrame:
    return target_correlation(df, target, cols=cols).filter(F.abs("r") >= threshold)


def outlier_report_iqr(df: DataFrame, k: float = 1.5, cols: list[str] | None = None, over: str = "rows") -> DataFrame:
    """(column, lower, upper, outliers, share), bounds null without values; the share is over all rows or over the ``non-null`` ones."""
    cols = cols if cols is not None else column_groups(df).numeric
    found = quartiles(df, cols)
    null = F.lit(None).cast("double")
    bounds = {c: (F.lit(found[c][0] - k * (found[c][2] - found[c][0])), F.lit(found[c][2] + k * (found[c][2] - found[c][0]))) if c in found else (null, null) for c in cols}
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~q(c).between(*bounds[c])).alias(f"o{i}") for i, c in enumerate(cols)], *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    base = lambda i: F.col("rows") if over == "rows" else F.col(f"n{i}")
    return unpivot_row(one, [((c,), [*bounds[c], F.col(f"o{i}"), F.try_divide(F.col(f"o{i}"), base(i))]) for i, c in enumerate(cols)], ["column", "lower", "upper", "outliers", "share"])


def outlier_flags(df: DataFrame, col: str, how: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """``df`` with is_outlier: outside the quartiles by threshold ranges, or a population z-score beyond threshold."""
    if how == "iqr":
        got = quartiles(df, [col]).get(col)
        flag = ~q(col).between(got[0] - threshold * (got[2] - got[0]), got[2] + threshold * (got[2] - got[0])) if got else F.lit(False)
    else:
        s = one_row(df, {"m": F.avg(q(col)), "s": F.stddev_pop(q(col))})
        flag = F.abs(q(col) - s["m"]) > threshold * s["s"] if s["s"] else F.lit(False)
    return df.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))


def class_balance(df: DataFrame, target: str, limit: float = 0.3) -> DataFrame:
    """(value, n, share, imbalanced): imbalanced when the least share is below ``limit``."""
    total = df.agg(F.count(q(target))).first()[0]
    counts = df.filter(q(target).isNotNull()).groupBy(q(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    least = counts.agg(F.min("n")).first()[0] or 0
    return counts.select("value", "n", (F.col("n") / F.lit(total)).alias("share"), F.lit(bool(total) and least / total < limit).alias("imbalanced"))


def vif_values(df: DataFrame, cols: list[str]) -> dict[str, float]:
    g, n, sums = gram(df, cols)
    return inverse_factors(g, n, sums, cols)


def vif(df: DataFrame, target: str | None = None, cols: list[str] | None = None) -> DataFrame:
    """(column, vif): of regressions without intercept on the other columns, all from one Gram matrix."""
    cols = [c for c in (cols if cols is not None else column_groups(df).numeric) if c != target]
    rows = [(c, float(v)) for c, v in vif_values(df, cols).items()]
    return df.sparkSession.createDataFrame(rows, "column string, vif double")


def drop_multicollinear(df: DataFrame, target: str, limit: float = 10.0, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns and target, without the column of the largest VIF until all are within ``limit``; one pass."""
    cols = [c for c in (cols if cols is not None else column_groups(df).numeric) if c != target]
    g, n, sums = gram(df, cols)
    keep = list(cols)
    while len(keep) > 1:
        at = [cols.index(c) for c in keep]
        found = inverse_factors(g[np.ix_(at, at)], n, sums[at], keep)
        worst = max(keep, key=lambda c: found[c])
        if found[worst] <= limit:
            break
        keep.remove(worst)
    return df.select(*[q(c) for c in keep], q(target))


def variance_report(df: DataFrame, limit: float = 0.01, cols: list[str] | None = None) -> DataFrame:
    """(column, variance, standardised, low): sample variance; variance after standardising, nulls as 0."""
    cols = cols if cols is not None else column_groups(df).numeric
    filled = lambda c: F.coalesce(q(c).cast("double"), F.lit(0.0))
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.var_samp(q(c)).alias(f"v{i}") for i, c in enumerate(cols)], *[F.var_pop(filled(c)).alias(f"p{i}") for i, c in enumerate(cols)])
    cells = [((c,), [F.col(f"v{i}"), F.when(F.col(f"p{i}") > 0, F.try_divide(F.col("rows").cast("double"), (F.col("rows") - 1).cast("double"))).otherwise(F.lit(0.0)), F.coalesce(F.col(f"v{i}") < limit, F.lit(False))]) for i, c in enumerate(cols)]
    return unpivot_row(one, cells, ["column", "variance", "standardised", "low"])


def top_variance_sample(df: DataFrame, key: list[str], top: int = 5, rows: int = 1000, seed: int = 42, cols: list[str] | None = None) -> DataFrame:
    """Of the ``top`` columns by variance a sample of ``rows`` rows, ordered by md5 of seed and key."""
    cols = cols if cols is not None else [c for c in column_groups(df).numeric if c not in key]
    var = one_row(df, {c: F.var_samp(q(c)) for c in cols})
    best = sorted((c for c in cols if var[c] is not None), key=lambda c: (-var[c], c))[:top]
    return df.select(*[q(c) for c in key], *[q(c) for c in best]).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[q(c).cast("string") for c in key]))).limit(rows)


def time_pattern_means(df: DataFrame, ts: str, target: str) -> DataFrame:
    """(pattern, bucket, mean, n): by month, weekday (Monday 0), quarter, weekend, year and hour, in one pass of grouping sets."""
    t = q(ts)
    parts = {"month": F.month(t), "weekday": F.weekday(t), "quarter": F.quarter(t), "weekend": (F.weekday(t) >= 5).cast("int"), "year": F.year(t), "hour": F.hour(t)}
    base = df.select(*[e.alias(n) for n, e in parts.items()], q(target).alias("__y"))
    grouped = base.groupingSets([[F.col(n)] for n in parts], *[F.col(n) for n in parts]).agg(F.avg("__y").alias("mean"), F.count("__y").alias("n"), F.grouping_id().alias("g"))
    names = list(parts)
    code = lambda i: (1 << len(names)) - 1 - (1 << (len(names) - 1 - i))
    name = F.coalesce(*[F.when(F.col("g") == code(i), F.lit(n)) for i, n in enumerate(names)])
    bucket = F.coalesce(*[F.when(F.col("g") == code(i), F.col(n)) for i, n in enumerate(names)])
    return grouped.select(name.alias("pattern"), bucket.alias("bucket"), "mean", "n")


def cluster_profile(df: DataFrame, cluster: str, cols: list[str] | None = None) -> DataFrame:
    """(cluster, column, n, mean, std, min, max) of every feature by cluster."""
    cols = cols if cols is not None else [c for c in column_groups(df).numeric if c != cluster]
    g = df.groupBy(q(cluster).alias("cluster")).agg(*[e.alias(f"{i}_{j}") for i, c in enumerate(cols) for j, e in enumerate([F.count(q(c)), F.avg(q(c)), F.stddev_samp(q(c)), F.min(q(c)).cast("double"), F.max(q(c)).cast("double")])])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{j}").alias(n) for j, n in enumerate(["n", "mean", "std", "min", "max"])]) for i, c in enumerate(cols)])
    return g.select("cluster", F.explode(rows).alias("r")).select("cluster", "r.*")
