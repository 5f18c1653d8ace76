"""Names, types and useless columns, on small hand-made tables."""

from __future__ import annotations

import datetime as dt

import pytest

from tidewheel.operators import columns as P


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  a  b ", "C-d", " "])
    assert P.normalize_names(df.select("`  a  b `", "C-d")).columns == ["a_b", "C-d"]
    assert P.snake_case_names(df.select("C-d")).columns == ["c_d"]
    assert P.name_blank_columns(df).columns == ["  a  b ", "C-d", "no_name_1"]
    with pytest.raises(ValueError, match="twice"):
        P.normalize_names(spark.createDataFrame([(1, 2)], ["a b", "a  b"]))


def test_missing_words(spark):
    df = spark.createDataFrame([(" nan ",), ("?",), ("a \t b",), (None,), ("  ",)], "s string")
    assert [r[0] for r in P.clean_strings(df).collect()] == [None, "?", "a b", None, ""]
    assert [r[0] for r in P.recognize_missing(df).collect()] == ["nan", None, "a \t b", None, None]


@pytest.mark.parametrize(("text", "value"), [("1d", None), ("0x1p3", None), (" 12 ", 12.0), ("1e5", 1e5), ("?", None), ("1_000", None), ("-.5", -0.5), ("inf", None)])
def test_numbers_in_text(spark, text, value):
    df = spark.createDataFrame([(text,), ("1",), ("2",)], "s string")
    assert P.infer_numeric_columns(df).first()[0] == value


def test_number_modes(spark):
    df = spark.createDataFrame([("1", "1.5", "x"), ("2", "2", "y"), ("3", None, "1"), (None, "4", "z")], "a string, b string, c string")
    assert [k for _, k in P.infer_numeric_columns(df).dtypes] == ["double", "double", "string"]
    assert [k for _, k in P.infer_numeric_columns(df, mode="ts").dtypes] == ["bigint", "double", "string"]


def test_dates_month_first(spark):
    df = spark.createDataFrame([("8/7/2018",), ("29/08/2018",), ("nan",), ("rubbish",)], "d string")
    out = [r[0] for r in P.infer_datetime_columns(df).collect()]
    assert out == [dt.datetime(2018, 8, 7), dt.datetime(2018, 8, 29), None, None]
    words = spark.createDataFrame([("a",), ("b",)], "d string")
    assert P.infer_datetime_columns(words).dtypes == [("d", "string")]


def test_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 1.0, "1", None, None), (None, None, None, None, None), (2, 2.0, "2", None, None)], "a int, b double, c string, d string, e string")
    assert P.drop_duplicate_columns(df).columns == ["a", "c", "d"]


def test_constant_columns(spark):
    df = spark.createDataFrame([(i, 1, "a" if i else "b", None) for i in range(40)], "i int, one int, near string, empty string")
    out, report = P.drop_constant_columns(df)
    assert out.columns == ["i", "empty"] and report.dropped == {"one": "constant", "near": "near-constant"}


def test_high_cardinality(spark):
    df = spark.createDataFrame([(str(i), str(i % 3)) for i in range(30)], "id string, k string")
    assert P.drop_high_cardinality(df)[0].columns == ["k"]
    assert P.drop_high_cardinality(df, absolute=3)[0].columns == []


def test_units(spark):
    df = spark.createDataFrame([(20.0, 3000.0, 150.0, "95 hp @ 5000", 1)], "city_mpg double, curb_weight double, engine_size double, horsepower string, n int")
    out, report = P.standardize_units(df)
    r = out.first()
    assert r["city_mpg"] == pytest.approx(47.04) and r["curb_weight"] == 3000.0 and r["engine_size"] == pytest.approx(0.15) and r["horsepower"] == 95.0
    assert set(report) == {"city_mpg", "engine_size", "horsepower"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    for f in (P.clean_strings, P.recognize_missing, P.infer_datetime_columns, P.infer_numeric_columns, P.normalise_nan):
        assert f(df).count() == 0
    assert P.drop_constant_columns(df)[0].columns == ["a", "b"]
