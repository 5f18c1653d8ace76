"""Nearest neighbours in rings around pivots against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from tidewheel.functions import neighbours as N


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "id long, v array<double>")


def plain(x, ids, y, names, k, skip):
    out = {}
    for name, q in zip(names, y, strict=True):
        d = np.sqrt(((x - q) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if not (skip and ids[j] == name)][:k]
        out[int(name)] = [(int(ids[j]), round(float(d[j]), 9)) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["point"], round(r["distance"], 9)))
    return out


@pytest.mark.parametrize("skip", [False, True])
def test_rings_find_what_all_pairs_find(spark, monkeypatch, skip):
    monkeypatch.setattr(N, "BLOCK", 64)
    rng = np.random.default_rng(2)
    heads = rng.normal(0, 8, (12, 6))
    x = np.concatenate([heads[rng.integers(12, size=700)] + rng.normal(0, 0.5, (700, 6)), np.repeat(heads[:1] + 3, 150, 0), rng.integers(-2, 3, (50, 6))])
    ids = rng.permutation(len(x)) * 3
    pairs = []
    y, names = (x, ids) if skip else (np.concatenate([x[::9], rng.normal(0, 20, (15, 6))]), np.arange(115)[: len(x[::9]) + 15])
    got = found(N.nearest(frame(spark, x, ids), frame(spark, y, names), 4, skip, pairs))
    assert got == plain(x, ids, y, names, 4, skip)
    assert sum(pairs) < 0.2 * len(x) * len(y)


def test_fewer_points_than_asked_and_missing_components(spark, monkeypatch):
    x = np.arange(6.0)[:, None]
    rows = [(i, [float(v)]) for i, v in enumerate(x[:, 0])] + [(10, [float("nan")]), (11, [None]), (12, [float("inf")])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = plain(x, np.arange(6), x, np.arange(6), 9, True)
    assert found(N.nearest(df, df, 9, True)) == want
    monkeypatch.setattr(N, "BLOCK", 2)
    assert found(N.nearest(df, df, 9, True)) == want
    assert N.nearest(df, df.filter("id > 99"), 3).count() == 0
    assert N.nearest(df.filter("id > 99"), df, 3).count() == 0


def test_queries_in_turns_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 32)
    seen = []
    monkeypatch.setattr(N, "rounds_for", lambda copies, rows: seen.append((copies, rows)) or 3)
    rng = np.random.default_rng(8)
    x, ids = rng.normal(size=(300, 5)), rng.permutation(300)
    assert found(N.nearest(frame(spark, x, ids), frame(spark, x, ids), 3, True)) == plain(x, ids, x, ids, 3, True)
    assert len(seen) == 2
