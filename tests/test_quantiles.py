"""Quantiles by sketches equal exact percentiles, whatever the sketches say; frequent values equal full counts."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import quantiles as Q
from tidewheel.operators import columns as P

PS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    x = F.col("id")
    return spark.range(0, 20000, 1, 7).select(
        (F.rand(3) * 1e6).alias("smooth"), F.when(F.rand(4) < 0.4, 0.0).otherwise(F.randn(5)).alias("zeros"), (x % 3).alias("few"), F.when(x % 5 == 0, F.rand(6)).alias("holes"), F.lit(None).cast("double").alias("none"),
        F.when(x == 17, 2.0).alias("one"), F.when(x % 2 == 0, float("nan")).otherwise(F.rand(8)).alias("nan"), F.exp(F.randn(9) * 8).alias("wide"), (-x).alias("falling"),
    ).persist()


def plain(df, c):
    v = np.sort(np.array([float(r[0]) for r in df.select(c).collect() if r[0] is not None and not math.isnan(r[0])]))
    return np.quantile(v, PS) if len(v) else None


def check(df):
    got = Q.exact_quantiles(df, {c: F.col(c) for c in df.columns}, PS)
    for c in df.columns:
        want = plain(df, c)
        assert (got[c] is None) == (want is None)
        if want is not None:
            assert np.allclose(got[c], want, rtol=1e-13, atol=0)


def test_equal_to_exact_percentiles(numbers):
    check(numbers)


def test_many_values_are_sketched_again(numbers, monkeypatch):
    monkeypatch.setattr(Q, "MOST_VALUES", 40)
    check(numbers.select("smooth", "zeros", "wide", "falling"))


def test_sketches_that_miss_are_corrected(numbers, monkeypatch):
    monkeypatch.setattr(Q, "SKETCH_K", 8)
    monkeypatch.setattr(Q, "MARGIN", 1e-5)
    check(numbers.select("smooth", "zeros", "holes"))


def test_empty_tables_and_no_columns(numbers):
    assert Q.exact_quantiles(numbers.limit(0), {"a": F.col("smooth")}, PS) == {"a": None}
    assert Q.exact_quantiles(numbers, {}, PS) == {}


def test_frequent_values_equal_full_counts(spark, monkeypatch):
    monkeypatch.setattr(P, "TRACKED", 64)
    x = F.col("id")
    df = spark.range(3000).select(
        F.lit("a").alias("constant"), F.when(x % 50 == 0, x.cast("string")).otherwise("top").alias("near"), F.when(x % 10 == 0, x.cast("string")).otherwise("top").alias("not_quite"), x.alias("keys"), F.lit(None).cast("string").alias("none"),
        F.when(x < 40, F.when(x == 7, 1.0).otherwise(2.0)).alias("of_few_rows"), (x % 2).alias("halves"),
    )
    for share in (0.95, 0.5, 0.3):
        got = P.dominant_values(df, df.columns, share)
        full = {r["column"]: r for r in P.dominance(df, df.columns).collect()}
        for c, (n, top, single) in got.items():
            r = full.get(c)
            assert n == (r["n"] if r else 0) and single == bool(r and r["distinct"] == 1)
            assert top == (r["top"] if r and r["top"] >= share * r["n"] else 0)
    kept, report = P.drop_constant_columns(df)
    assert report.dropped == {"constant": "constant", "near": "near-constant", "of_few_rows": "near-constant"}
    assert kept.columns == ["not_quite", "keys", "none", "halves"]


def test_equal_columns_of_one_fingerprint(spark):
    x = F.col("id")
    df = spark.range(10).select(x.alias("a"), (9 - x).alias("b"), (9 - x).cast("double").alias("c"), x.alias("d"), (9 - x).alias("e"))
    assert P.drop_duplicate_columns(df).columns == ["a", "b"]
