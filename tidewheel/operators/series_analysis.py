"""Autocorrelation, decomposition, stationarity and time-ordered splits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import adf_critical, adf_p_value, gram_of, ols
from .columns import one_row, q
from .profile import unpivot_row
from ..functions.ranges import positions
from .calendars import join_by_key
from .series import chunked, distributed_rank, frame

PERIODS = {"D": 7, "W": 4, "M": 12, "MS": 12, "H": 24}


def _lagged(df: DataFrame, col: str, lags, keys: list[str] = (), prefix: str = "l") -> DataFrame:
    """``df`` (t, ...) with lags of ``col``; one long series is cut into chunks with a halo."""

    def add(d: DataFrame, by: list[str]) -> DataFrame:
        return d.withColumns({f"{prefix}{k}": F.lag(q(col), k).over(frame(by, "t")) for k in lags}) if lags else d

    return add(df, list(keys)) if keys else chunked(df, "t", max([*lags, 1]), add)


def lag_correlation(df: DataFrame, ts: str, target: str, lags=(1, 7, 30), keys: list[str] = ()) -> DataFrame:
    """(lag, r) of the series with itself k rows before, on valid pairs."""
    lagged = _lagged(df.select(*[q(k) for k in keys], q(ts).alias("t"), q(target).alias("y")), "y", lags, keys)
    one = lagged.agg(*[F.corr("y", f"l{k}").alias(f"r{k}") for k in lags])
    return unpivot_row(one, [((k,), [F.col(f"r{k}")]) for k in lags], ["lag", "r"])


def acf(df: DataFrame, ts: str, target: str, lags: int = 25) -> DataFrame:
    """(lag, acf) for lags 0..lags: products about the common mean over the whole sum of squares."""
    mean = one_row(df, {"m": F.avg(q(target))})["m"]
    y = df.filter(q(target).isNotNull()).select(q(ts).alias("t"), (q(target) - F.lit(mean)).alias("y"))
    y = _lagged(y, "y", range(1, lags + 1))
    one = y.agg(F.sum(F.col("y") * F.col("y")).alias("v"), *[F.sum(F.col("y") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    return unpivot_row(one, [((0,), [F.lit(1.0)]), *[((k,), [F.try_divide(F.col(f"s{k}"), F.col("v"))]) for k in range(1, lags + 1)]], ["lag", "acf"])


def pacf(df: DataFrame, ts: str, target: str, lags: int = 25) -> DataFrame:
    """(lag, pacf) by Yule-Walker, from the autocorrelations by Levinson-Durbin on the driver."""
    rho = [r["acf"] for r in acf(df, ts, target, lags).orderBy("lag").collect()]
    out, phi = [1.0], np.zeros(0)
    for k in range(1, lags + 1):
        past = np.array(rho[1:k])
        a = (rho[k] - phi @ past[::-1]) / (1 - phi @ past) if k > 1 else rho[1]
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return df.sparkSession.createDataFrame(list(enumerate(out)), "lag int, pacf double")


def seasonal_decompose(df: DataFrame, ts: str, target: str, period: int, keys: list[str] = (), extrapolate: bool = True) -> DataFrame:
    """(keys, ts, observed, trend, seasonal, residual), additive; needs two periods.

    The trend is a centred moving average (half weights at the ends of an even period), its ends lines
    fitted to the nearest ``period`` trend values; the season is the mean by phase less the mean of those.
    """
    keys = list(keys)
    by = [q(k) for k in keys]
    rows = df.select(*by, q(ts).alias("t"), q(target).cast("double").alias("observed"))
    rows = positions(rows, keys, ["t"], "i")
    h = period // 2

    def smoothed(d: DataFrame, chunk: list[str]) -> DataFrame:
        w = frame(chunk, "i")
        whole = w.rowsBetween(-h, h)
        if period % 2:
            middle, width = F.avg("observed").over(whole), period
        else:
            inner = F.sum("observed").over(w.rowsBetween(-(h - 1), h - 1))
            middle, width = (inner + (F.lag("observed", h).over(w) + F.lead("observed", h).over(w)) / 2) / period, period + 1
        return d.withColumn("trend", F.when(F.count("observed").over(whole) == width, middle))

    rows = chunked(rows, "i", h, smoothed, keys=keys, ahead=h, rank="i").withColumn("i", F.col("i") - 1)
    if extrapolate:
        ends = rows.filter("trend is not null").groupBy(*by).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
        joined = join_by_key(rows, ends, keys)
        near = lambda cond: (F.regr_slope(F.when(cond, F.col("trend")), F.col("i").cast("double")), F.regr_intercept(F.when(cond, F.col("trend")), F.col("i").cast("double")))
        a, b = near(F.col("i") < F.col("lo") + period), near(F.col("i") > F.col("hi") - period)
        lines = joined.groupBy(*by).agg(a[0].alias("s0"), a[1].alias("c0"), b[0].alias("s1"), b[1].alias("c1"))
        joined = join_by_key(joined, lines, keys)
        left, right = F.col("c0") + F.col("s0") * F.col("i"), F.col("c1") + F.col("s1") * F.col("i")
        rows = joined.withColumn("trend", F.coalesce("trend", F.when(F.col("i") < F.col("lo"), left), F.when(F.col("i") > F.col("hi"), right))).select(*rows.columns)
    rows = rows.withColumns({"phase": F.col("i") % period, "free": F.col("observed") - F.col("trend")})
    season = rows.groupBy(*by, "phase").agg(F.avg("free").alias("m"))
    centre = season.groupBy(*by).agg(F.avg("m").alias("mm"))
    season = join_by_key(season, centre, keys)
    season = season.select(*by, "phase", (F.col("m") - F.col("mm")).alias("seasonal"))
    return join_by_key(rows, season, [*keys, "phase"]).select(*by, F.col("t").alias(ts), "observed", "trend", "seasonal", (F.col("free") - F.col("seasonal")).alias("residual"))


def adf_test(df: DataFrame, ts: str, target: str, max_lag: int | None = None) -> DataFrame:
    """(metric, value) of the augmented Dickey-Fuller test with constant; the lag minimises AIC on a common sample."""
    spark = df.sparkSession
    n = df.count()
    most = int(math.ceil(12.0 * (n / 100.0) ** 0.25)) if max_lag is None else max_lag
    most = max(0, min(most, n // 2 - 2))
    base = df.select(q(ts).alias("t"), q(target).cast("double").alias("y"))
    d = _lagged(base, "y", [1]).select("t", "y", F.col("l1").alias("l"), (F.col("y") - F.col("l1")).alias("d"))
    lagged = _lagged(d, "d", range(1, most + 1), prefix="d")
    centre = one_row(base, {"m": F.avg("y")})["m"] or 0.0  # shifts the level only; keeps sums well scaled

    def matrix(k: int, on: list[str]) -> tuple[np.ndarray, int]:
        rows = lagged.dropna(subset=on)
        return gram_of(rows, [F.col("d"), F.col("l") - F.lit(centre), F.lit(1.0), *[F.col(f"d{j}") for j in range(1, k + 1)]])

    g, m = matrix(most, ["d", "l", *[f"d{j}" for j in range(1, most + 1)]])
    best = min(range(most + 1), key=lambda k: m * math.log(max(ols(g, m, 0, [1, 2, *range(3, 3 + k)])[2], 1e-300) / m) + 2 * (2 + k))
    g, m = matrix(best, ["d", "l", *[f"d{j}" for j in range(1, best + 1)]])
    beta, error, _ = ols(g, m, 0, [1, 2, *range(3, 3 + best)])
    tau = float(beta[0] / error[0]) if error[0] else float("nan")
    rows = [("statistic", tau), ("p_value", adf_p_value(tau)), ("used_lag", float(best)), ("n", float(m)), *[(f"critical {k}", v) for k, v in adf_critical(m).items()]]
    return spark.createDataFrame(rows, "metric string, value double")


def with_rank(df: DataFrame, ts: str, name: str = "rank") -> DataFrame:
    return distributed_rank(df, [ts], name)


def chronological_split(df: DataFrame, ts: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The first int(n * (1 - test_share)) rows by time, and the rest; ``ts`` should be unique."""
    cut = int(df.count() * (1 - test_share) + 1e-9)
    ranked = with_rank(df, ts, "__rank")
    return ranked.filter(F.col("__rank") <= cut).drop("__rank"), ranked.filter(F.col("__rank") > cut).drop("__rank")


def time_series_folds(df: DataFrame, ts: str, splits: int = 5) -> DataFrame:
    """``df`` with ``fold``: 0 is only ever trained on; fold k is tested with all folds before it as training."""
    n = df.count()
    size = n // (splits + 1)
    first = n - splits * size
    ranked = with_rank(df, ts, "__rank")
    fold = F.when(F.col("__rank") <= first, 0).otherwise(1 + F.floor((F.col("__rank") - 1 - first) / max(size, 1))).cast("int")
    return ranked.withColumn("fold", fold).drop("__rank")
