"""Distinct values and rows from hash pairs against sets of the values."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewheel.functions.distinct import distinct_counts
from tidewheel.operators import profile as A

SCHEMA = "a long, b string, c double, d array<int>, `e f` string"


def rows(n=400):
    r = random.Random(5)
    pick = lambda *v: r.choice(v)
    out = [(pick(None, 1, 2, 3), pick(None, "", "x", "X"), pick(None, 0.0, 1.5), pick(None, [], [1, None], [None, 1], [1]), pick(None, "u", "v")) for _ in range(n)]
    return [*out, *out[:50], (None,) * 5, (None,) * 5]


def test_counts_are_those_of_sets(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = distinct_counts(df, df.columns).first().asDict()
    frozen = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in data]
    assert got["rows"] == len(data) and got["distinct_rows"] == len(set(frozen))
    for i in range(5):
        held = [r[i] for r in frozen if r[i] is not None]
        assert (got[f"n{i}"], got[f"d{i}"]) == (len(held), len(set(held)))


def test_a_null_is_told_apart_by_its_place(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    whole = A.profile(df).filter("column = '*'").first()
    assert (whole["n"], whole["missing"], whole["distinct"]) == (3, 3, 1)


def test_zeros_and_nan_are_one_value_each(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert distinct_counts(df, ["x"]).first()["d0"] == df.distinct().count() == 2


def test_empty_tables_and_estimates(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert all(v == 0 for v in distinct_counts(none, none.columns).first().asDict().values())
    assert A.cardinality_report(none, []).count() == 0
    many = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("s"), "id")
    near = {r["column"]: r["distinct"] for r in A.profile(many, exact=False).collect()}
    assert abs(near["s"] - 5000) < 500 and abs(near["id"] - 20_000) < 2000
    assert A.cardinality_report(many).first()["distinct"] == 5000


def test_no_row_is_expanded_by_column(spark):
    df = spark.createDataFrame(rows(20), SCHEMA)
    plan = A.profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan
