"""Series operators against pandas and numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import series as W
from tidewheel.operators import series_analysis as WA


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(4)
    days = pd.date_range("2024-01-01", periods=200, freq="D")
    y = np.cumsum(rng.normal(size=200)) + 3 * np.sin(np.arange(200) * 2 * np.pi / 7)
    return spark.createDataFrame(pd.DataFrame({"ts": days, "y": y})), pd.Series(y, index=days)


def test_gaps_of_one_and_five_days(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 4, 10, 11)]
    df = spark.createDataFrame([(d, float(d.day)) for d in days], "ts timestamp, y double")
    assert sorted(r["missing"] for r in W.find_gaps(df, "ts", "D").collect()) == [1, 5]
    assert W.missing_timestamps(df, "ts", "D").count() == 6
    filled = [r["y"] for r in W.fill_gaps(df, "ts", "D").orderBy("ts").collect()]
    assert filled == [float(i) for i in range(1, 12)]
    assert W.fill_gaps(df, "ts", "D", "mean").filter("y = 5.6").count() == 6


def test_blocks_of_nulls(spark):
    values = [None, 1.0, None, None, None, 2.0, None, None]
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1 + i), v) for i, v in enumerate(values)], "ts timestamp, y double")
    blocks = W.null_blocks(df, "ts", ["y"]).collect()
    assert [(r["block_start"].day, r["block_end"].day, r["size"]) for r in blocks] == [(3, 5, 3)]
    assert [r["y"] for r in W.interpolate_linear(df, "ts", ["y"]).orderBy("ts").collect()] == [1.0, 1.0, 1.25, 1.5, 1.75, 2.0, 2.0, 2.0]


def test_order_and_duplicates(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), 1.0), (2, dt.datetime(2024, 1, 1), 2.0), (3, dt.datetime(2024, 1, 2), None)], "i int, ts timestamp, y double")
    r = W.check_monotonic(df, "ts", "i").first()
    assert (r["negative_steps"], r["duplicated_rows"], r["monotonic"]) == (1, 2, False)
    assert W.duplicate_timestamps(df, "ts").count() == 2
    assert {r["y"] for r in W.resolve_duplicate_timestamps(df, "ts", "last", "i").collect()} == {None, 2.0}


def test_exponential_features_equal_pandas(daily):
    df, s = daily
    got = W.ewm_features(df, "ts", "y", (7,)).orderBy("ts").toPandas()
    e = s.ewm(span=7, adjust=True)
    assert np.allclose(got["y_ewm_mean_7"], e.mean()) and np.allclose(got["y_ewm_std_7"][1:], e.std()[1:])


def test_chunked_windows_equal_plain_ones(daily):
    df, _ = daily
    plain = W.rolling_features(df, "ts", "y", (7,)).orderBy("ts").toPandas()
    parts = W.chunked(df, "ts", 6, lambda d, keys: W.rolling_features(d, "ts", "y", (7,), keys), chunk_rows=30).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(plain, parts[plain.columns])


def test_ranks_splits_and_folds(daily):
    df, _ = daily
    ranks = [r["rank"] for r in WA.with_rank(df, "ts").orderBy("ts").collect()]
    assert ranks == list(range(1, 201))
    train, test = WA.chronological_split(df, "ts")
    assert (train.count(), test.count()) == (160, 40) and train.agg(F.max("ts")).first()[0] < test.agg(F.min("ts")).first()[0]
    sizes = {r["fold"]: r["count"] for r in WA.time_series_folds(df, "ts", 4).groupBy("fold").count().collect()}
    assert sizes == {0: 40, 1: 40, 2: 40, 3: 40, 4: 40}


def test_autocorrelations(daily):
    df, s = daily
    y = s.to_numpy() - s.mean()
    want = [1.0, *[float((y[k:] * y[:-k]).sum() / (y * y).sum()) for k in range(1, 6)]]
    assert np.allclose([r["acf"] for r in WA.acf(df, "ts", "y", 5).orderBy("lag").collect()], want)
    r = np.array(want)
    system = np.array([[r[abs(i - j)] for j in range(3)] for i in range(3)])
    assert WA.pacf(df, "ts", "y", 3).filter("lag = 3").first()["pacf"] == pytest.approx(np.linalg.solve(system, r[1:4])[-1])


def test_decomposition_adds_up(daily):
    df, s = daily
    got = WA.seasonal_decompose(df, "ts", "y", 7).orderBy("ts").toPandas()
    assert np.allclose(got.trend + got.seasonal + got.residual, got.observed)
    middle = s.rolling(7, center=True).mean()
    assert np.allclose(got.trend[3:-3], middle[3:-3])
    assert abs(got.seasonal[:7].sum()) < 1e-9 and got.trend.notna().all()


def test_stationarity(spark):
    rng = np.random.default_rng(5)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    for y, low in ((walk, False), (noise, True)):
        df = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=400), "y": y}))
        got = {r["metric"]: r["value"] for r in WA.adf_test(df, "ts", "y", 4).collect()}
        assert (got["p_value"] < 0.01) == low
        k = int(got["used_lag"])
        d = np.diff(y)
        x = np.column_stack([y[k:-1], np.ones(len(d) - k), *[d[k - j : len(d) - j] for j in range(1, k + 1)]])
        beta, res, *_ = np.linalg.lstsq(x, d[k:], rcond=None)
        error = np.sqrt(res[0] / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
        assert got["statistic"] == pytest.approx(beta[0] / error, rel=1e-6)


def test_feature_table_is_complete(daily):
    df, _ = daily
    out = W.engineer_features(df, "ts", "y", W.FeaturePlan((1, 7), (7,), (1,), (7,)))
    assert out.count() == 193 and out.dropna().count() == 193
