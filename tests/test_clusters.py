"""Long dense clusters in one piece, and eps from all points."""

from __future__ import annotations

import numpy as np
import pytest

from tidewheel.operators import cluster as U


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "id long, v array<double>")


def test_a_long_chain_is_one_cluster(spark):
    ids = np.random.default_rng(3).permutation(400)
    x = np.zeros((400, 3))
    x[:, 0] = np.arange(400)
    got = U.dbscan(frame(spark, x, ids), 1.5, 3).collect()
    assert len(got) == 400
    # the two ends have two neighbours within reach, themselves included, and are border points
    assert {r["cluster"] for r in got} == {min(ids[1:-1].tolist())}


def test_eps_is_of_all_points(spark, monkeypatch):
    monkeypatch.setattr(U, "TILE", 37)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.1, (250, 5)), rng.normal(4, 2.0, (70, 5)), np.zeros((9, 5))])
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 4]
    for sample in (3, 2000):
        assert U.auto_eps(frame(spark, x), 5, sample) == pytest.approx(np.percentile(d, 90), rel=1e-12)
    assert U.auto_eps(frame(spark, x[:4]), 5) == 1.0


def test_order_statistic(spark):
    x = np.concatenate([np.random.default_rng(5).normal(size=300), np.full(200, 0.25), [1e9]])
    df = frame(spark, x[:, None]).selectExpr("v[0] AS d")
    assert [U.order_statistic(df, "d", r, 20) for r in (0, 250, 400, 500)] == np.sort(x)[[0, 250, 400, 500]].tolist()


def plain_dbscan(x, ids, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        lower = np.where(core, np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1), label)
        if (lower == label).all():
            break
        label = lower
    border = np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(1)
    return {int(i): int(c) if c < np.iinfo(np.int64).max else -1 for i, c in zip(ids, np.where(core, label, border), strict=True)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dense_cells_give_the_clusters_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(U, "TILE", 23)
    rng = np.random.default_rng(seed)
    # tight groups at about one reach from each other, a cloud between them, copies, and points on the limit
    heads = rng.uniform(0, 3, (6, 2))
    parts = [rng.normal(h, 0.15, (40, 2)) for h in heads] + [rng.uniform(-1, 4, (120, 2)), np.repeat(heads[:2] + 0.5, 7, 0), np.array([[9.0, 0], [9.5, 0], [10.0, 0], [10.5, 0]])]
    x = np.concatenate(parts)
    ids = rng.permutation(len(x)) * 7 - 900
    got = {r["id"]: r["cluster"] for r in U.dbscan(frame(spark, x, ids), 0.5 if seed < 3 else 0.2, 4).collect()}
    assert got == plain_dbscan(x, ids, 0.5 if seed < 3 else 0.2, 4)


def test_points_within_one_reach_are_not_compared(spark, monkeypatch):
    """20,000 points in one eps and a few beside them: rows dealt stay near the points, and all is one cluster."""
    dealt = []
    tiles = U._tiles

    def counted(points, reach, asks=None):
        out, keys = tiles(points, reach, asks)
        dealt.append(out.count())
        return out, keys

    monkeypatch.setattr(U, "_tiles", counted)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(0, 0.5, (20000, 3)), [[1.2, 0.2, 0.2], [40.0, 0, 0]]])
    got = {r["id"]: r["cluster"] for r in U.dbscan(frame(spark, x), 1.0, 5).collect()}
    assert {got[i] for i in range(20001)} == {0} and got[20001] == -1
    assert sum(dealt) < 4 * len(x)


def test_reach_must_be_above_zero(spark):
    with pytest.raises(ValueError, match="eps"):
        U.dbscan(frame(spark, np.zeros((3, 2))), 0.0)


def test_missing_components_link_with_nothing(spark):
    rows = [(i, [0.0, float("nan")]) for i in range(6)] + [(10 + i, [0.0, 0.0]) for i in range(6)]
    got = {r["id"]: r["cluster"] for r in U.dbscan(spark.createDataFrame(rows, "id long, v array<double>"), 1.0, 3).collect()}
    assert got == {i: -1 for i in range(6)} | {10 + i: 10 for i in range(6)}


def test_silhouette_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(U, "TILE", 20)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(3, 1, (25, 3)), [[9.0, 9, 9]], np.zeros((4, 3))])
    label = np.array([0] * 40 + [5] * 25 + [7] + [8] * 4)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))] + [(99, [float("nan")] * 3, 0), (98, [0.0] * 3, None)]
    got = {r["id"]: r for r in U.silhouette_rows(spark.createDataFrame(rows, "id long, v array<double>, cluster int")).collect()}
    assert set(got) == set(range(len(x)))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i, c in enumerate(label):
        own, outer = (label == c).sum() - 1, min(d[i, label == o].mean() for o in {0, 5, 7, 8} - {int(c)})
        inner = d[i, label == c].sum() / own if own else None
        assert got[i]["outer"] == pytest.approx(outer)
        assert got[i]["inner"] == (None if inner is None else pytest.approx(inner))
        assert got[i]["silhouette"] == pytest.approx(0 if inner is None else (outer - inner) / max(inner, outer))
    one = U.silhouette_rows(spark.createDataFrame(rows[:5], "id long, v array<double>, cluster int")).collect()
    assert {(r["outer"], r["silhouette"]) for r in one} == {(None, 0.0)}
    assert U.silhouette_rows(spark.createDataFrame([], "id long, v array<double>, cluster int")).count() == 0


def test_rounds_give_the_rows_of_one_and_shuffle_few_copies(spark, monkeypatch):
    from tidewheel.functions import graph

    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    df = frame(spark, x).withColumn("cluster", U.F.col("id") % 3)

    def rows():
        near = {r["id"]: r["cluster"] for r in U.dbscan(frame(spark, x), 0.9, 4).collect()}
        return near, U.auto_eps(frame(spark, x), 5), {r["id"]: (r["inner"], r["outer"]) for r in U.silhouette_rows(df).collect()}

    def twice(copies, rows):
        dealt.append((copies, rows, split(copies, rows, 500)))
        return dealt[-1][2]

    whole, dealt, split = rows(), [], graph.rounds_for
    monkeypatch.setattr(U, "TILE", 50)
    monkeypatch.setattr(U, "rounds_for", twice)
    got = rows()
    assert got[0] == whole[0] == plain_dbscan(x, np.arange(400), 0.9, 4) and got[1] == pytest.approx(whole[1], rel=1e-12)
    assert all(got[2][i] == pytest.approx(w) for i, w in whole[2].items()) and len(got[2]) == 400
    assert max(n for _, _, n in dealt) > 3 and all(c / n <= max(2 * r, 500) for c, r, n in dealt)
