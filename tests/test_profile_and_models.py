"""Profiles, transforms, metrics, models and clusters against numpy, pandas and closed forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.functions.neighbours import nearest
from tidewheel.operators import cluster as U
from tidewheel.operators import estimators as M
from tidewheel.operators import metrics as MM
from tidewheel.operators import profile as A
from tidewheel.operators import transforms as T


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=200)
    pdf = pd.DataFrame({"id": range(200), "a": a, "b": 2 * a + rng.normal(scale=0.3, size=200), "c": rng.exponential(size=200), "y": rng.integers(0, 2, 200)})
    pdf["t"] = 3 * pdf.a - 2 * pdf.c + 1 + rng.normal(scale=0.1, size=200)
    return spark.createDataFrame(pdf), pdf


def test_shape_statistics_equal_pandas(table):
    df, pdf = table
    got = {r["metric"]: r["value"] for r in A.statistical_summary(df, "c").collect()}
    assert got["skewness"] == pytest.approx(pdf.c.skew()) and got["kurtosis"] == pytest.approx(pdf.c.kurt())
    assert got["q1"] == pytest.approx(pdf.c.quantile(0.25))
    assert {r["column"]: r["skewness"] for r in A.skewness_report(df, cols=["a", "c"]).collect()}["c"] == pytest.approx(pdf.c.skew())


def test_correlations_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 1.0), (3.0, 5.0, 2.0), (None, 4.0, 7.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in A.correlation_matrix(df).collect()}
    want = df.toPandas().astype(float).corr()
    assert all(got[k] == pytest.approx(want.loc[k]) for k in got)


def test_vif_by_gram_equals_regressions(table):
    df, pdf = table
    got = {r["column"]: r["vif"] for r in A.vif(df, cols=["a", "b", "c"]).collect()}
    x = pdf[["a", "b", "c"]].to_numpy()
    for i, c in enumerate("abc"):
        others = np.delete(x, i, 1)
        residual = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert got[c] == pytest.approx((x[:, i] ** 2).sum() / (residual**2).sum(), rel=1e-6)
    assert A.drop_multicollinear(df, "t", 10, ["a", "b", "c"]).columns in (["a", "c", "t"], ["b", "c", "t"])


def test_edge_tables(spark):
    one = spark.createDataFrame([(1.0, 5.0)], "a double, b double")
    assert A.describe(one).filter("column = 'a'").first()["std"] is None
    assert A.histogram(one, "a", 4).first()["n"] == 1
    none = one.limit(0)
    assert A.describe(none).count() == 2 and A.profile(none).filter("column = '*'").first()["n"] == 0
    assert [r["outliers"] for r in A.outlier_report_iqr(none).collect()] == [0, 0]
    assert A.describe(spark.createDataFrame([], "s string")).count() == 0
    constant = spark.createDataFrame([(2.0,)] * 5, "a double")
    assert [r["a"] for r in T.scale(constant, ["a"]).collect()] == [0.0] * 5
    assert A.class_balance(constant, "a").first()["imbalanced"] is False


def test_blocked_neighbours_equal_brute_force(table):
    df, pdf = table
    points = df.select("id", F.array("a", "b", "c").alias("v"))
    got = nearest(points, points.filter("id < 20"), 4, skip_same=True).toPandas()
    x = pdf[["a", "b", "c"]].to_numpy()
    for i in range(20):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert got[got["query"] == i].sort_values("rank").point.tolist() == np.argsort(d, kind="stable")[:4].tolist()


@pytest.mark.parametrize("name", ["LinearRegression", "Ridge", "KernelRidge", "Lasso"])
def test_linear_models_equal_their_closed_forms(table, name):
    df, pdf = table
    rows = M.prepared(df, ["a", "c"], "t")
    model = M.regressors(rows, [name])[name].fit(rows)
    x, y = pdf[["a", "c"]].to_numpy(), pdf.t.to_numpy()
    xc, yc = (x - x.mean(0), y - y.mean()) if name != "KernelRidge" else (x, y)
    if name == "Lasso":
        w = np.zeros(2)
        for _ in range(500):
            for j in range(2):
                r = yc - xc @ w + xc[:, j] * w[j]
                rho = xc[:, j] @ r / len(y)
                w[j] = np.sign(rho) * max(abs(rho) - 1.0, 0) / ((xc[:, j] ** 2).mean())
    else:
        w = np.linalg.solve(xc.T @ xc + (0.0 if name == "LinearRegression" else 1.0) * np.eye(2), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-4)


def test_leaderboards(table):
    df, _ = table
    train, test = T.random_split(df, ["id"])
    r, c = (lambda d, t: M.prepared(d, ["a", "b", "c"], t).persist()), None
    board = M.train_and_rank(M.regressors(r(train, "t"), ["LinearRegression", "DecisionTree5", "AdaBoost", "KNN"], 3), r(train, "t"), r(test, "t"), "regression").board.collect()
    assert board[0]["Model"] == "LinearRegression" and board[0]["Test_R2"] > 0.98 and len(board) == 4
    two = df.withColumn("y", (F.col("t") > 0).cast("int"))
    train, test = T.random_split(two, ["id"])
    c = M.train_and_rank(M.classifiers(r(train, "y"), ["LogisticRegression", "GaussianNB", "AdaBoost", "RBFSVC", "KNN"], 5), r(train, "y"), r(test, "y"), "classification").board.collect()
    assert len(c) == 5 and c[0]["Test_Accuracy"] >= 0.9


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.8), (0, 0, 0.1), (1, 1, 0.7)], "label int, prediction int, score double")
    r = MM.classification_metrics(df, average="binary").first()
    assert (r["accuracy"], r["precision"], r["recall"]) == pytest.approx((0.6, 2 / 3, 2 / 3))
    pos, neg = [0.9, 0.8, 0.7], [0.8, 0.1]
    assert MM.auc(df).first()["auc"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 6)
    never = df.withColumn("prediction", F.lit(0))
    assert MM.classification_metrics(never, average="binary").first()["precision"] == 0.0


def test_density_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 0.3, (60, 5)) for m in (0, 3, 6)] + [rng.uniform(-5, 12, (20, 5))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    eps = 0.8
    got = {r["id"]: r["cluster"] for r in U.dbscan(df, eps, 5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = (d <= eps).sum(1) >= 5
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        new = np.array([min(label[j] for j in np.flatnonzero((d[i] <= eps) & core)) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        near = np.flatnonzero((d[i] <= eps) & core)
        want = label[i] if core[i] else min((label[j] for j in near), default=-1)
        assert got[i] == want


def test_clusters_and_components(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 0.2, (40, 3)) for m in (0, 4, 8)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ["p", "q", "r"])
    matrix, cols = U.prepare_matrix(df)
    sweep, best = U.kmeans_sweep(matrix, cols, range(2, 5), [1])
    assert best == 3 and sweep.count() == 3
    assert sorted(r["n"] for r in U.kmeans_fit(matrix, 3)[1].collect()) == [40, 40, 40]
    assert sorted(r["count"] for r in U.hierarchical(matrix, 3, 20).groupBy("prediction").count().collect()) == [40, 40, 40]
    values = np.linalg.eigvalsh(np.cov(((x - x.mean(0)) / x.std(0)).T))[::-1]
    assert np.allclose([r["variance"] for r in U.pca_report(df, ["p", "q", "r"]).collect()], values)
    projected = U.pca_project(df, ["p", "q", "r"]).toPandas()
    assert abs(projected.pc1.mean()) < 1e-9 and projected.pc1.var(ddof=0) == pytest.approx(values[0] * 119 / 120, rel=1e-3)


def test_query_names_have_known_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100
