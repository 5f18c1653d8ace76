"""A raw series with text inputs, text keys, repeats, disorder and steps of its own comes out whole."""

from __future__ import annotations

import datetime as dt

import pytest

from tidewheel.plans import jobs

DAY0 = dt.datetime(2024, 1, 1)
SCHEMA = "n long, series string, `when` string, target string, ` num ` string, constant string, note string, y double"


def raw():
    rows = []

    def add(key, t, y, num, note="a"):
        rows.append((len(rows), key, t if isinstance(t, str) else t.strftime("%Y-%m-%d %H:%M:%S"), f"t{len(rows) % 2}", num, "same", note, y))

    for i in range(96):  # 15 minutes, two missing
        if i not in (40, 41):
            add("001", DAY0 + dt.timedelta(minutes=15 * i), float(i), f" {i} ", "ab"[i % 2])
    for i in (3, 1, 2, 5, 2, 4, 0):  # two days, in disorder, with a repeated stamp
        add("1", DAY0 + dt.timedelta(days=2 * i), 100.0 + i + len(rows), str(i))
    rows.append((len(rows), *rows[-1][1:]))  # a repeated row
    add("1", "not a date", 5.0, "7")
    return rows


@pytest.mark.parametrize("duplicates", ["first", "last", "mean"])
def test_series_of_two_steps(spark, duplicates):
    rows = raw()
    out, report = jobs.preprocess_series(spark.createDataFrame(rows, SCHEMA), "when", "target", None, duplicates, ["series"], "n")
    assert (report.rows, report.repeated_rows, report.unparsed_stamps, report.duplicated_rows, report.merged_rows) == (len(rows), 1, 1, 2, 1)
    assert report.monotonic is False and report.negative_steps == 3
    assert {r["series"]: (r["frequency"], r["rows"], r["points"], r["off_grid"]) for r in report.steps.collect()} == {"001": ("900s", 94, 96, 0), "1": ("2D", 6, 6, 0)}
    assert set(out.columns) == {"series", "when", "target", "num", "note", "y"}  # the order column and the constant are gone
    assert dict(out.dtypes)["num"] in ("bigint", "double") and dict(out.dtypes)["series"] == "string"
    got = {(r["series"], r["when"]): r for r in out.collect()}
    assert len(got) == 102
    assert [got["001", DAY0 + dt.timedelta(minutes=15 * i)]["y"] for i in (39, 40, 41, 42)] == [39, 40, 41, 42]
    both = [r[-1] for r in rows if r[1] == "1" and r[2].startswith("2024-01-05")]
    assert len(both) == 2 and got["1", DAY0 + dt.timedelta(days=4)]["y"] == {"first": both[0], "last": both[1], "mean": sum(both) / 2}[duplicates]


def test_order_unknown_and_rows_off_the_grid(spark):
    stamps = [DAY0 + dt.timedelta(days=d) for d in (0, 1, 2, 3, 4)] + [DAY0 + dt.timedelta(days=2, hours=5)]
    df = spark.createDataFrame([(t, float(i)) for i, t in enumerate(stamps)], "ts timestamp, y double")
    out, report = jobs.preprocess_series(df, "ts", "y")
    assert report.monotonic is None and report.negative_steps is None and report.merged_rows == 0
    assert [tuple(r) for r in report.steps.collect()] == [("D", 6, 5, 1)] and out.count() == 5
    again, _ = jobs.preprocess_series(df.limit(0), "ts", "y")
    assert again.count() == 0
