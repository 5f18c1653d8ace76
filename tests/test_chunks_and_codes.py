"""Chunked series equal plain windows across chunk boundaries, and codes of many values equal their sorted order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import series as W
from tidewheel.operators import transforms as T


@pytest.mark.parametrize("features", [W.lag_features, W.rolling_features, W.rolling_bands, W.difference_features])
def test_chunks_equal_one_window(spark, features, monkeypatch):
    df = spark.range(180).select(F.col("id").alias("ts"), (F.col("id") * 37 % 101).cast("double").alias("y"))
    monkeypatch.setattr(W, "CHUNK_ROWS", 50)
    chunks = features(df, "ts", "y")
    plain = features(df.withColumn("one", F.lit(1)), "ts", "y", keys=["one"]).drop("one")
    assert chunks.columns == plain.columns
    assert chunks.orderBy("ts").collect() == plain.orderBy("ts").collect()


def test_a_window_longer_than_a_chunk_is_an_error(spark):
    with pytest.raises(ValueError, match="rows"):
        W.chunked(spark.range(10), "id", 9, lambda d, by: d, 5)


def test_codes_of_many_values_are_their_order(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLED", 3)  # many ranges
    values = [f"v{i * 7919 % 1000}é" for i in range(1000)] + [None, "", "v1é"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, s string")
    got = {r["id"]: r["s"] for r in T.label_encode(df, ["s"]).collect()}
    order = {v: k for k, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
    assert got == {i: None if v is None else order[v] for i, v in enumerate(values)}


def test_codes_of_an_empty_table(spark):
    assert T.label_encode(spark.createDataFrame([], "s string"), ["s"]).count() == 0
