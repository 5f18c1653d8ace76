"""Clustering features against sums of all points, Ward's chain against merging the least costly pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tidewheel.functions import summaries as S
from tidewheel.operators import cluster as U


def plain_ward(x, n, k):
    """All pairs, the cheapest merges, until k are left."""
    groups = [([i], x[i].astype(float), float(n[i])) for i in range(len(x))]
    while len(groups) > k:
        cost, i, j = min(
            (a[2] * b[2] / (a[2] + b[2]) * float(((a[1] - b[1]) ** 2).sum()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
        )
        a, b = groups[i], groups.pop(j)
        groups[i] = (a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2])
    return {frozenset(g[0]) for g in groups}


def as_sets(labels):
    return {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist())}


@pytest.mark.parametrize("seed", range(6))
def test_the_chain_merges_as_the_cheapest_pair_does(seed):
    rng = np.random.default_rng(seed)
    x, n = rng.normal(size=(40, 3)) + 1e4, rng.integers(1, 50, 40)
    for k in (1, 2, 5, 17, 40, 60):
        assert as_sets(S.ward_labels(x, n, k)) == plain_ward(x, n, k)
    assert len(S.ward_tree(x, n)[2]) == 39


def points(spark, x, parts):
    rows = [(i, Vectors.dense(r)) for i, r in enumerate(x.tolist())]
    return spark.createDataFrame(rows, ["id", "features"]).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_all_points_are_merged_exactly_while_they_fit(spark, parts):
    rng = np.random.default_rng(parts)
    x = rng.normal(size=(60, 2))
    x = np.concatenate([x, x[:7], x[:7]])  # copies weigh as often as they stand there
    got = U.hierarchical(points(spark, x, parts), 4).collect()
    label = np.zeros(len(x), int)
    for r in got:
        label[r["id"]] = r["prediction"]
    assert as_sets(label) == plain_ward(x, np.ones(len(x)), 4)
    assert (np.diff(np.bincount(label)) <= 0).all()  # the largest comes first


@pytest.mark.parametrize("parts", [1, 20])
def test_sums_stay_whole_when_leaves_are_merged(spark, parts):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 4)) * [1, 5, 0.1, 2] + [0, 100, -3, 1e5]
    df = points(spark, x, parts)
    held = S.clustering_features(df.select(U.vector_to_array("features").alias("v")), 32).collect()
    n, mean, ss = (np.array([r[c] for r in held]) for c in ("n", "mean", "ss"))
    assert len(n) <= 32 and n.sum() == 3000
    middle = (n[:, None] * mean).sum(0) / n.sum()
    assert np.allclose(middle, x.mean(0), rtol=1e-12)
    assert ss.sum() + (n * ((mean - middle) ** 2).sum(1)).sum() == pytest.approx(((x - x.mean(0)) ** 2).sum(), rel=1e-9)


@pytest.mark.parametrize("parts", [2, 9])
def test_groups_apart_are_found_from_few_leaves(spark, parts):
    rng = np.random.default_rng(9)
    centre = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0], [0, 0, 20]])
    of = rng.choice(4, 4000, p=[0.9, 0.06, 0.03, 0.01])
    got = U.hierarchical(points(spark, centre[of] + rng.normal(size=(4000, 3)), parts), 4, 60).toPandas().sort_values("id").prediction.to_numpy()
    assert as_sets(got) == as_sets(of)


def test_gaps_few_points_and_empty_tables(spark):
    x = np.array([[0.0, 0.0], [np.nan, 1.0], [5.0, 5.0], [np.inf, 0.0], [0.0, 0.0]])
    got = {r["id"]: r["prediction"] for r in U.hierarchical(points(spark, x, 2), 9).collect()}
    assert got == {0: 0, 1: None, 2: 1, 3: None, 4: 0}
    none = U.hierarchical(points(spark, x, 2).filter("id < 0"), 3)
    assert none.count() == 0 and none.schema["prediction"].dataType.simpleString() == "int"
    clash = U.hierarchical(points(spark, x, 1).withColumn("part", U.F.lit("p")).withColumn("prediction", U.F.lit("old")), 2)
    assert sorted((r["id"], r["prediction"]) for r in clash.collect() if r["prediction"] is not None) == [(0, 0), (2, 1), (4, 0)]


def test_partitions_without_rows_fold_to_nothing(spark):
    df = spark.range(0, 40, 1, 8).filter("id < 10").select(U.F.array(U.F.col("id").cast("double"), U.F.lit(1.0)).alias("v"))  # rows in two of eight
    held = S.clustering_features(df, 64).collect()
    assert sorted((r["n"], *r["mean"], r["ss"]) for r in held) == [(1, float(i), 1.0, 0.0) for i in range(10)]
