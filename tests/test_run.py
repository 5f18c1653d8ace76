"""The whole run: cleaning, exploring and training or clustering, and what happens when cleaning fails."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewheel.plans import jobs


@pytest.fixture(scope="module")
def raw(spark):
    x = F.col("id")
    return spark.range(240).select(
        F.concat(F.lit(" "), (x % 17).cast("string")).alias("a"), ((x * 37) % 101).cast("double").alias("b"), F.when(x % 11 == 0, None).otherwise((x * 7) % 23).cast("double").alias("c"), F.lit("same").alias("constant"),
        ((x % 17) * 3 + (x * 37) % 101 + x % 2).cast("double").alias("y"), F.when(x % 9 == 0, 1).otherwise(0).alias("label"),
    )


def test_regression_with_exploration(raw):
    got = jobs.run(raw.drop("label"), "regression", "y", models=["LinearRegression"])
    assert got.fell_back is None and got.clean.columns == ["a", "b", "c", "y"] and got.clean.filter("c is null").count() == 0
    assert {"describe", "profile", "outliers", "vif"} <= set(got.explored.reports) and got.explored.train.count() + got.explored.test.count() == got.clean.count()
    assert got.board.first()["Test_R2"] > 0.99


def test_unsupervised_is_cleaned_and_explored(raw):
    got = jobs.run(raw.select("a", "b", "c", "constant"), "unsupervised", ks=range(2, 4))
    assert got.clean.columns == ["a", "b", "c"] and got.clean.filter("c is null").count() == 0
    assert "pca" in got.explored.reports and got.board.count() == 3 and got.result.rows.count() == got.clean.count()


def test_fallback_says_why(raw, monkeypatch):
    def broken(df, target=None):
        raise ValueError("bad value")

    monkeypatch.setattr(jobs, "preprocess_tabular", broken)
    got = jobs.run(raw.select("b", "c", "y"), "regression", "y", models=["LinearRegression"])
    assert got.fell_back == "bad value" and got.board.count() == 1


def test_balancing(raw):
    df = raw.select("b", "y", "label", F.monotonically_increasing_id().alias("k"))
    sizes = {way: sorted(r["count"] for r in jobs.balance_classes(df, "label", ["k"], way)[0].groupBy("label").count().collect()) for way in ("smote", "oversample", "undersample")}
    assert sizes == {"smote": [213, 213], "oversample": [213, 213], "undersample": [27, 27]}
    _, way = jobs.balance_classes(df.withColumn("s", F.lit("text")), "label", ["k"], "smote")
    assert way == "oversample"
    made = jobs.balance_classes(df, "label", ["k"], "smote")[0].filter("label = 1")
    ends = df.filter("label = 1").agg(F.min("b"), F.max("b")).first()
    assert made.filter(~F.col("b").between(*ends)).count() == 0


def test_bad_calls(raw):
    with pytest.raises(ValueError, match="task"):
        jobs.run(raw, "guess", "y")
    with pytest.raises(ValueError, match="target"):
        jobs.run(raw, "regression")
