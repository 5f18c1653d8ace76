"""Carries, islands, features and grids over many small ranges equal one window, pandas or SQL."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.functions import ranges as R
from tidewheel.operators import calendars as C
from tidewheel.operators import series as W
from tidewheel.operators import series_analysis as WA

DAY0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def holes():
    """A key of 90 % of the rows, a small one, and a null one; runs of nulls that cross ranges; nulls at both ends."""
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("hot", 450), ("small", 40), (None, 10)):
        y, s = rng.normal(size=n), rng.integers(0, 9, n).astype(str)
        empty = np.zeros(n, bool)
        empty[:3] = empty[-2:] = True
        for at in rng.integers(0, n, n // 20 + 1):
            empty[at : at + rng.integers(1, 90 if n > 100 else 4)] = True
        rows += [(key, DAY0 + dt.timedelta(hours=i), None if empty[i] else float(y[i]), None if empty[(i * 7) % n] else str(s[i]), i) for i in range(n)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, holes):
    return spark.createDataFrame(holes, "key string, ts timestamp, y double, s string, i long")


@pytest.fixture(autouse=True)
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def tables(holes, keyed):
    p = pd.DataFrame(holes, columns=["key", "ts", "y", "s", "i"])
    if keyed:
        return {k: g.set_index("ts").sort_index() for k, g in p.groupby("key", dropna=False)}
    return {"all": p[p.key == "hot"].set_index("ts").sort_index()}


def parts(frame, keyed):
    return frame if keyed else frame.filter("key = 'hot'")


def name(k, keyed):
    return (None if k is None or k != k else k) if keyed else "all"


def by_key(df, keyed, *cols):
    out = {}
    for r in df.orderBy("ts").collect():
        out.setdefault(name(r["key"], keyed), []).append(tuple(r[c] for c in cols))
    return out


@pytest.mark.parametrize("keyed", [True, False])
def test_interpolation_and_fills_equal_pandas(frame, holes, keyed):
    df, keys = parts(frame, keyed), ["key"] if keyed else []
    got = by_key(W.interpolate_linear(df, "ts", ["y"], keys), keyed, "y")
    ahead, behind = (by_key(W.carry_values(df, "ts", ["y", "s"], how, keys), keyed, "y", "s") for how in ("ffill", "bfill"))
    for k, t in tables(holes, keyed).items():
        k = name(k, keyed)
        assert np.allclose([v[0] for v in got[k]], t.y.interpolate("linear", limit_direction="both"))
        for found, a, b in ((ahead, "ffill", "bfill"), (behind, "bfill", "ffill")):
            want = getattr(getattr(t[["y", "s"]], a)(), b)()
            assert np.allclose([v[0] for v in found[k]], want.y) and [v[1] for v in found[k]] == list(want.s)


@pytest.mark.parametrize("keyed", [True, False])
def test_blocks_of_nulls_cross_ranges(frame, holes, keyed):
    df, keys = parts(frame, keyed), ["key"] if keyed else []
    got = {((name(r["key"], True) if keyed else "all"), r["column"], r["block_start"], r["block_end"], r["size"]) for r in W.null_blocks(df, "ts", ["y", "s"], 2, keys).collect()}
    want = set()
    for k, t in tables(holes, keyed).items():
        for c in ("y", "s"):
            run = []
            for at, v in [*t[c].items(), (None, 0)]:
                if at is not None and pd.isna(v):
                    run.append(at.to_pydatetime())
                    continue
                if len(run) >= 2:
                    want.add((name(k, keyed), c, run[0], run[-1], len(run)))
                run = []
    assert max(w[-1] for w in want) > 60 and got == want


@pytest.mark.parametrize("keyed", [True, False])
def test_positions_order_and_steps(frame, keyed):
    keys = ["key"] if keyed else []
    df = parts(frame, keyed)
    w = Window.partitionBy(*keys).orderBy("ts")
    plain = df.select("key", "ts", F.row_number().over(w).alias("n"), (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))).alias("step"))
    assert sorted(map(repr, R.positions(df, keys, ["ts"], "n").select("key", "ts", "n").collect())) == sorted(map(repr, plain.select("key", "ts", "n").collect()))
    got = C.steps_between(df, "ts", keys).agg(F.sum("step"), F.count("step")).first()
    assert tuple(got) == tuple(plain.agg(F.sum("step"), F.count("step")).first())
    shuffled = df.withColumn("o", F.xxhash64("i", F.lit(5)))
    back = Window.partitionBy(*keys).orderBy("o")
    want = shuffled.select((F.col("ts") < F.lag("ts").over(back)).cast("int").alias("x")).agg(F.sum("x")).first()[0]
    assert W.check_monotonic(shuffled, "ts", "o", keys).first()["negative_steps"] == want


@pytest.mark.parametrize("keyed", [True, False])
def test_exponential_features_equal_pandas(frame, holes, keyed, monkeypatch):
    monkeypatch.setattr(W, "CHUNK_ROWS", 50)
    df, keys = parts(frame, keyed), ["key"] if keyed else []
    got = by_key(W.ewm_features(df.withColumn("y", F.col("y") + 1e4), "ts", "y", (7, 30), keys), keyed, "y_ewm_mean_7", "y_ewm_std_7", "y_ewm_mean_30", "y_ewm_std_30")
    for k, t in tables(holes, keyed).items():
        a = np.array(got[name(k, keyed)], dtype=float)
        for c, span in ((0, 7), (2, 30)):
            e = (t.y + 1e4).ewm(span=span, adjust=True)
            assert np.allclose(a[:, c], e.mean(), equal_nan=True) and np.allclose(a[:, c + 1], e.std(), equal_nan=True, rtol=1e-6, atol=1e-6)


def test_a_hot_key_is_in_many_chunks(frame, monkeypatch):
    monkeypatch.setattr(W, "CHUNK_ROWS", 50)
    for features in (W.lag_features, W.rolling_features, W.rolling_bands, W.difference_features):
        got = features(frame, "ts", "y", keys=["key"])
        plain = features(frame.withColumn("__chunk", F.lit(0)), "ts", "y", keys=["key", "__chunk"]).drop("__chunk")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.select(*got.columns).collect()))
    seen = []
    W.chunked(frame, "ts", 3, lambda d, by: seen.append(d.groupBy(*by).count().count()) or d, keys=["key"])
    assert seen == [12]  # ten of the hot key, the last of them a halo only


@pytest.mark.parametrize("period", [6, 7])
@pytest.mark.parametrize("keyed", [True, False])
def test_decomposition_in_chunks_equals_one_window(frame, monkeypatch, period, keyed):
    df, keys = parts(frame, keyed), ["key"] if keyed else []
    df = df.filter("key is null or key <> 'small'").withColumn("y", F.coalesce("y", F.lit(0.5)) + F.col("i") % period)
    plain = sorted(map(repr, WA.seasonal_decompose(df, "ts", "y", period, keys).select(*keys, "ts", F.round("trend", 6), F.round("seasonal", 6)).collect()))
    monkeypatch.setattr(W, "CHUNK_ROWS", 20)
    got = WA.seasonal_decompose(df, "ts", "y", period, keys)
    assert sorted(map(repr, got.select(*keys, "ts", F.round("trend", 6), F.round("seasonal", 6)).collect())) == plain
    assert got.count() == df.count()


def steps(spark, stamps):
    df = spark.createDataFrame([(k, t) for k, ts in stamps.items() for t in ts], "key string, ts timestamp")
    found = C.infer_steps(df, "ts", ["key"])
    points = C.grid(found, "ts", ["key"])
    report = {r["key"]: (r["frequency"], r["rows"], r["points"], r["off_grid"]) for r in C.grid_report(df, "ts", found, points, ["key"]).collect()}
    grids = {}
    for r in points.orderBy("ts").collect():
        grids.setdefault(r["key"], []).append(r["ts"])
    return report, grids


def test_every_key_has_its_own_step(spark):
    make = lambda freq, n, start="2024-01-01", **k: [t.to_pydatetime() for t in pd.date_range(start, periods=n, freq=freq, **k)]
    quarter, two = make("15min", 96), make("2D", 30)
    stamps = {
        "15min": quarter[:40] + quarter[43:], "2 days": two[:5] + two[6:], None: make("h", 30), "days": make("D", 20)[::-1], "business": make("B", 15), "weeks": make("7D", 5), "months": make("MS", 14), "quarters": make("QS", 6),
        "month ends": make("ME", 14), "the 15th": [DAY0.replace(month=m, day=15) for m in (1, 2, 3, 5, 6)], "years": make("YS", 4), "one": [DAY0], "two": [DAY0, DAY0 + dt.timedelta(days=3)],
        "none": [DAY0 + dt.timedelta(days=d) for d in (0, 1, 2, 3, 4)] + [DAY0 + dt.timedelta(days=2, hours=5)], "repeats": [DAY0, DAY0, DAY0 + dt.timedelta(hours=6), DAY0 + dt.timedelta(hours=12)],
    }
    report, grids = steps(spark, stamps)
    assert {k: v[0] for k, v in report.items()} == {
        "15min": "900s", "2 days": "2D", None: "H", "days": "D", "business": "B", "weeks": "7D", "months": "MS", "quarters": "3MS", "month ends": "ME", "the 15th": "MS", "years": "12MS", "one": "D", "two": "3D", "none": "D", "repeats": "21600s",
    }
    assert grids["15min"] == quarter and grids["2 days"] == two and grids["business"] == stamps["business"]
    for k in ("months", "quarters", "month ends", "years", "weeks", "one"):
        assert grids[k] == stamps[k]
    assert grids["the 15th"] == [DAY0.replace(month=m, day=15) for m in range(1, 7)]
    assert {k: v[3] for k, v in report.items() if v[3]} == {"none": 1}  # what the grid leaves out is counted
    for k, (_, n, points, off) in report.items():
        assert n == len(stamps[k]) and points == len(grids[k]) and len(set(stamps[k]) - set(grids[k])) == off


def test_long_grids_are_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "GRID_ROWS", 7)
    df = spark.createDataFrame([(DAY0,), (DAY0 + dt.timedelta(days=100),)], "ts timestamp")
    assert [r["ts"] for r in W.calendar(df, "ts", "D").orderBy("ts").collect()] == [DAY0 + dt.timedelta(days=i) for i in range(101)]
    assert W.calendar(df, "ts", "15min").count() == 9601 and W.calendar(df, "ts", "2MS").count() == 2
    with pytest.raises(ValueError, match="frequency"):
        W.calendar(df, "ts", "3X")


def test_empty_tables(spark):
    df = spark.createDataFrame([], "key string, ts timestamp, y double")
    for keys in ([], ["key"]):
        found = C.infer_steps(df, "ts", keys)
        assert C.grid(found, "ts", keys).count() == 0 and W.fill_gaps(df, "ts", found, "interpolate", keys).count() == 0
        assert W.null_blocks(df, "ts", ["y"], keys=keys).count() == 0 and W.ewm_features(df, "ts", "y", (7,), keys).count() == 0
