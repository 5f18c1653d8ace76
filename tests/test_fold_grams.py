"""Linear models from fold Gram matrices against refits and the conditions of their optimum."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tidewheel.operators import estimators as M
from tidewheel.operators import fold_grams as G


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 3, 0.2, 50, 1] + [0, 1000, 0, -7, 2]
    x[:, 4] = 2.0  # constant
    y = x @ [1.5, -0.7, 0.0, 0.01, 0] + rng.normal(size=400) + 1e4
    fold = np.minimum(np.arange(400) // 100, 3)
    rows = [(int(f), Vectors.dense(v), float(t)) for f, v, t in zip(fold, x, y, strict=True)] + [(1, Vectors.dense([0.0] * 5), None)]
    df = spark.createDataFrame(rows, ["fold", "features", "label"])
    return df.persist(), x, y, fold


def test_ridge_equals_a_refit(table):
    df, x, y, fold = table
    grams = G.fold_grams(df)
    assert grams.splits == 3
    for k in (1, 2, 3):
        a, t = x[fold < k], y[fold < k]
        for alpha in (0.1, 100.0):
            w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + alpha * np.eye(5), (a - a.mean(0)).T @ (t - t.mean()))
            got, start = G.coefficients(grams, k, "Ridge", {"alpha": alpha})
            assert got == pytest.approx(w, rel=1e-8, abs=1e-10)
            assert start == pytest.approx(t.mean() - w @ a.mean(0), rel=1e-9)
            gap = y[fold == k] - x[fold == k] @ got - start
            assert G.fold_rmse(grams, k, got, start) == pytest.approx(np.sqrt((gap**2).mean()), rel=1e-8)
        w = np.linalg.solve(a.T @ a + np.eye(5), a.T @ t)
        assert G.coefficients(grams, k, "KernelRidge")[0] == pytest.approx(w, rel=1e-5, abs=1e-6)


def test_lasso_and_elastic_net_meet_their_conditions(table):
    df, x, y, fold = table
    grams = G.fold_grams(df)
    for family, values in (("Lasso", {"alpha": 0.1}), ("Lasso", {"alpha": 1.0}), ("ElasticNet", {"alpha": 0.5, "l1_ratio": 0.5})):
        share = values.get("l1_ratio", 1.0)
        for k in (1, 3):
            a, t = x[fold < k], y[fold < k]
            w, start = G.coefficients(grams, k, family, values)
            slope = a.T @ (t - a @ w - start) / len(t)
            slope -= a.mean(0) * (t - a @ w - start).mean()
            slope -= values["alpha"] * (1 - share) * w
            limit = values["alpha"] * share
            assert (np.abs(slope) <= limit + 1e-6).all()
            assert slope[w != 0] == pytest.approx(limit * np.sign(w[w != 0]), abs=1e-6)
            assert w[4] == 0


def test_measures_of_all_values_in_one_pass(table):
    df, x, y, fold = table
    grams = G.fold_grams(df)
    models = [("Ridge", {"alpha": 1.0}), ("Lasso", {"alpha": 0.1}), ("LinearRegression", {})]
    for (family, values), got in zip(models, G.measure_linear(df, grams, models), strict=True):
        rmse, mae, r2 = [], [], []
        for k in (1, 2, 3):
            w, start = G.coefficients(grams, k, family, values)
            t = y[fold == k]
            gap = t - x[fold == k] @ w - start
            rmse.append(np.sqrt((gap**2).mean()))
            mae.append(np.abs(gap).mean())
            r2.append(1 - (gap**2).sum() / ((t - t.mean()) ** 2).sum())
        assert [got["CV_RMSE"], got["CV_MAE"], got["CV_R2"]] == pytest.approx([np.mean(rmse), np.mean(mae), np.mean(r2)], rel=1e-7)


def test_least_error_wins_and_models_are_made_of_it(table):
    df = table[0].filter("label is not null")
    best, scores = G.tune_linear(G.fold_grams(df), "ElasticNet")
    assert best == G.choices(G.LINEAR_GRIDS["ElasticNet"])[int(np.argmin(scores))]
    made, measured = M.linear_on_folds(df, df, ["Lasso", "LinearRegression"], True)
    assert made["Lasso"].getRegParam() == G.tune_linear(G.fold_grams(df), "Lasso")[0]["alpha"]
    assert set(measured) == {"Lasso", "LinearRegression"}


def test_tables_without_folds(table):
    df = table[0]
    grams = G.fold_grams(df.filter("fold = 0"))
    assert grams.splits == 0 and G.measure_linear(df, grams, [("Ridge", {})]) == [{}]
    assert G.fold_grams(df.filter("false")).splits == -1


def test_grid_values_of_other_estimators():
    knn = M.with_values(M.NearestNeighbours("regression"), {"k": 3, "weighted": True}, 10)
    assert (knn.k, knn.weighted) == (3, True)
