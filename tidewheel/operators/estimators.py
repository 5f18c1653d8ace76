"""Models, tuning on time folds, leaderboards and scoring, on pyspark.ml."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import materialise
from ..functions.neighbours import nearest
from . import metrics
from .columns import one_row, q
from .fold_grams import DEFAULTS, LINEAR_GRIDS, choices, fold_grams, measure_linear, tune_linear

FEATURES, LABEL, PREDICTION = "features", "label", "prediction"


def prepared(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """``df`` with features as a vector and the target as a double label."""
    return VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="skip").transform(df).withColumn(LABEL, q(target).cast("double"))


def _spread(df: DataFrame) -> tuple[float, int]:
    r = one_row(df, {"s": F.stddev_samp(LABEL), "n": F.count(LABEL)})
    return (r["s"] or 1.0), max(r["n"], 1)


def linear_regression() -> R.LinearRegression:
    return R.LinearRegression(solver="normal", standardization=False)


def ridge(df: DataFrame, alpha: float = 1.0, intercept: bool = True) -> R.LinearRegression:
    """Ridge of penalty ``alpha`` on the sum of squares: Spark's penalty is per row and in units of the label's spread."""
    s, n = _spread(df)
    return R.LinearRegression(solver="l-bfgs", standardization=False, fitIntercept=intercept, regParam=alpha * s / n, maxIter=500, tol=1e-12)


def lasso(alpha: float = 1.0) -> R.LinearRegression:
    return R.LinearRegression(solver="l-bfgs", standardization=False, regParam=alpha, elasticNetParam=1.0, maxIter=500, tol=1e-10)


def elastic_net(df: DataFrame, alpha: float = 1.0, l1: float = 0.5) -> R.LinearRegression:
    s, _ = _spread(df)
    reg = alpha * l1 + alpha * (1 - l1) * s
    return R.LinearRegression(solver="l-bfgs", standardization=False, regParam=reg, elasticNetParam=alpha * l1 / reg, maxIter=500, tol=1e-10)


def huber() -> R.LinearRegression:
    return R.LinearRegression(loss="huber", epsilon=1.35, maxIter=200)


def logistic(df: DataFrame, c: float = 1.0) -> C.LogisticRegression:
    return C.LogisticRegression(regParam=1.0 / (c * _spread(df)[1]), maxIter=200)


def _one_vs_rest(estimator: Estimator, classes: int) -> Estimator:
    return estimator if classes <= 2 else C.OneVsRest(classifier=estimator)


def regressors(df: DataFrame, names: list[str] | None = None, trees: int = 100, seed: int = 42, rounds: int = 50) -> dict[str, Estimator]:
    """Estimators by name, fitted to the size and spread of ``df`` (label); ``rounds`` is for AdaBoost, ``trees`` for all other ensembles."""
    makers: dict[str, Callable[[], Estimator]] = {
        "LinearRegression": linear_regression,
        "Ridge": lambda: ridge(df),
        "Lasso": lasso,
        "ElasticNet": lambda: elastic_net(df),
        "Huber": huber,
        "KernelRidge": lambda: ridge(df, intercept=False),
        "DecisionTree": lambda: R.DecisionTreeRegressor(maxDepth=15, seed=seed),
        "DecisionTree5": lambda: R.DecisionTreeRegressor(maxDepth=5, seed=seed),
        "RandomForest": lambda: R.RandomForestRegressor(numTrees=trees, maxDepth=10, seed=seed),
        "GradientBoosting": lambda: R.GBTRegressor(maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed),
        "AdaBoost": lambda: AdaBoostRegressor(rounds, seed=seed),
        "KNN": lambda: NearestNeighbours("regression"),
    }
    return {n: makers[n]() for n in (names or makers)}


def classifiers(df: DataFrame, names: list[str] | None = None, trees: int = 100, seed: int = 42, rounds: int = 50) -> dict[str, Estimator]:
    classes = df.select(F.count_distinct(LABEL)).first()[0]
    makers: dict[str, Callable[[], Estimator]] = {
        "LogisticRegression": lambda: logistic(df),
        "LinearSVC": lambda: _one_vs_rest(C.LinearSVC(regParam=0.01, maxIter=100), classes),
        "RBFSVC": lambda: Pipeline(stages=[FourierFeatures(seed=seed), _one_vs_rest(C.LinearSVC(featuresCol="fourier", regParam=0.001, maxIter=100), classes)]),
        "DecisionTree": lambda: C.DecisionTreeClassifier(maxDepth=15, seed=seed),
        "DecisionTree5": lambda: C.DecisionTreeClassifier(maxDepth=5, seed=seed),
        "RandomForest": lambda: C.RandomForestClassifier(numTrees=trees, maxDepth=10, seed=seed),
        "GradientBoosting": lambda: _one_vs_rest(C.GBTClassifier(maxIter=trees, maxDepth=3, seed=seed), classes),
        "AdaBoost": lambda: AdaBoostClassifier(rounds, seed=seed),
        "GaussianNB": lambda: C.NaiveBayes(modelType="gaussian"),
        "KNN": lambda: NearestNeighbours("classification"),
    }
    return {n: makers[n]() for n in (names or makers)}


class FourierFeatures(Transformer):
    """Random Fourier features of the RBF kernel (Rahimi and Recht 2007), by one vectorised projection."""

    def __init__(self, dims: int = 128, gamma: float | None = None, seed: int = 42):
        super().__init__()
        self.dims, self.gamma, self.seed = dims, gamma, seed

    def _transform(self, df: DataFrame) -> DataFrame:
        dims, gamma, seed = self.dims, self.gamma, self.seed

        def project(column):
            x = np.array(column.tolist(), dtype=float)
            if not len(x):
                return column
            rng = np.random.default_rng(seed)
            g = gamma if gamma is not None else 1.0 / x.shape[1]
            w, b = rng.normal(0, math.sqrt(2 * g), (x.shape[1], dims)), rng.uniform(0, 2 * math.pi, dims)
            return column.__class__(list(math.sqrt(2 / dims) * np.cos(x @ w + b)), index=column.index)

        run = F.pandas_udf(_typed(project), "array<double>")
        return df.withColumn("fourier", array_to_vector(run(vector_to_array(F.col(FEATURES)))))


def _typed(f):
    import pandas as pd

    def typed(column: pd.Series) -> pd.Series:
        return f(column)

    typed.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return typed


@dataclass
class NeighbourModel:
    train: DataFrame
    task: str
    k: int
    weighted: bool

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the mean label, or the label of most votes (ties: the least), of the k nearest training rows."""
        rows = materialise(df.withColumn("__id", F.monotonically_increasing_id()), "numbered")  # ids outlive lost executors
        near = nearest(self.train.select("id", "v"), rows.select(F.col("__id").alias("id"), vector_to_array(FEATURES).alias("v")), self.k)
        votes = near.join(self.train.select(F.col("id").alias("point"), F.col(LABEL).alias("y")), "point")
        weight = F.lit(1.0) / F.greatest("distance", F.lit(1e-12)) if self.weighted else F.lit(1.0)
        if self.task == "regression":
            got = votes.groupBy("query").agg((F.sum(F.col("y") * weight) / F.sum(weight)).alias(PREDICTION))
        else:
            per = votes.groupBy("query", "y").agg(F.sum(weight).alias("w"))
            got = per.groupBy("query").agg(F.max_by("y", F.struct("w", -F.col("y"))).alias(PREDICTION))
        return rows.join(got, F.col("__id") == F.col("query"), "left").drop("__id", "query")


class NearestNeighbours:
    """k nearest neighbours by blocked distances."""

    def __init__(self, task: str, k: int = 5, weighted: bool = False):
        self.task, self.k, self.weighted = task, k, weighted

    def fit(self, df: DataFrame) -> NeighbourModel:
        rows = df.select(F.monotonically_increasing_id().alias("id"), vector_to_array(FEATURES).alias("v"), LABEL)
        rows = materialise(rows, "numbered")
        return NeighbourModel(rows, self.task, self.k, self.weighted)


@dataclass
class BoostedModel:
    models: list[Transformer]
    weights: list[float]
    classes: list[float] | None

    def transform(self, df: DataFrame) -> DataFrame:
        """Weighted median of the rounds' predictions (regression), or the class of most weight."""
        out = df
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumnRenamed(PREDICTION, f"__p{i}").drop("rawPrediction", "probability")
        names = [f"__p{i}" for i in range(len(self.models))]
        if self.classes is None:
            pairs = F.array_sort(F.array(*[F.struct(F.col(n).alias("p"), F.lit(w).alias("w")) for n, w in zip(names, self.weights, strict=True)]))
            half = sum(self.weights) / 2
            walk = F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("p")), lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(a["p"].isNull() & (a["s"] + x["w"] >= half), x["p"]).otherwise(a["p"]).alias("p")))
            out = out.withColumn(PREDICTION, walk["p"])
        else:
            votes = F.array(*[F.struct(F.col(n).alias("p"), F.lit(w).alias("w")) for n, w in zip(names, self.weights, strict=True)])
            for_class = lambda c: F.aggregate(F.col("__votes"), F.lit(0.0), lambda a, x: a + F.when(x["p"] == c, x["w"]).otherwise(0.0))
            best = F.array_max(F.transform(F.array(*[F.lit(float(c)) for c in self.classes]), lambda c: F.struct(for_class(c).alias("s"), (-c).alias("c"))))
            out = out.withColumn("__votes", votes).withColumn(PREDICTION, best["c"] * -1).drop("__votes")
        return out.drop(*names)


class _AdaBoost:
    def __init__(self, rounds: int = 50, depth: int = 1, seed: int = 42):
        self.rounds, self.depth, self.seed = rounds, depth, seed


class AdaBoostRegressor(_AdaBoost):
    """AdaBoost.R2 with linear loss over shallow Spark trees."""

    def fit(self, df: DataFrame) -> BoostedModel:
        now = df.select(FEATURES, LABEL, F.lit(1.0).alias("__w"))
        models, weights = [], []
        for i in range(self.rounds):
            tree = R.DecisionTreeRegressor(maxDepth=max(self.depth, 3), weightCol="__w", seed=self.seed + i).fit(now)
            rows = tree.transform(now).withColumn("__e", F.abs(F.col(PREDICTION) - F.col(LABEL)))
            top = rows.agg(F.max("__e")).first()[0] or 0.0
            if top == 0:
                return BoostedModel([*models, tree], [*weights, 1.0 if not weights else max(weights)], None)
            loss = rows.agg(F.sum(F.col("__w") * F.col("__e") / top) / F.sum("__w")).first()[0]
            if loss >= 0.5:
                break
            beta = loss / (1 - loss)
            models.append(tree)
            weights.append(math.log(1 / beta))
            now = materialise(rows.select(FEATURES, LABEL, (F.col("__w") * F.pow(F.lit(beta), 1 - F.col("__e") / top)).alias("__w")), "boosted")
        return BoostedModel(models or [tree], weights or [1.0], None)


class AdaBoostClassifier(_AdaBoost):
    """SAMME over shallow Spark trees."""

    def fit(self, df: DataFrame) -> BoostedModel:
        classes = sorted(r[0] for r in df.select(LABEL).distinct().collect())
        now = df.select(FEATURES, LABEL, F.lit(1.0).alias("__w"))
        models, weights = [], []
        for i in range(self.rounds):
            tree = C.DecisionTreeClassifier(maxDepth=self.depth, weightCol="__w", seed=self.seed + i).fit(now)
            rows = tree.transform(now).withColumn("__e", (F.col(PREDICTION) != F.col(LABEL)).cast("double"))
            err = rows.agg(F.sum(F.col("__w") * F.col("__e")) / F.sum("__w")).first()[0] or 0.0
            if err <= 0:
                return BoostedModel([*models, tree], [*weights, 1.0 if not weights else max(weights)], classes)
            if err >= 1 - 1 / max(len(classes), 2):
                break
            a = math.log((1 - err) / err) + math.log(max(len(classes) - 1, 1))
            models.append(tree)
            weights.append(a)
            now = materialise(rows.select(FEATURES, LABEL, (F.col("__w") * F.exp(F.lit(a) * F.col("__e"))).alias("__w")), "boosted")
        return BoostedModel(models or [tree], weights or [1.0], classes)


@dataclass
class Trained:
    """Fitted models by name and their leaderboard."""

    models: dict[str, object] = field(default_factory=dict)
    board: DataFrame | None = None


def _measures(model, df: DataFrame, task: str, prefix: str, average: str) -> dict[str, float]:
    got = model.transform(df)
    if task == "regression":
        r = metrics.regression_metrics(got).first()
        return {f"{prefix}_R2": r["r2"], f"{prefix}_RMSE": r["rmse"], f"{prefix}_MAE": r["mae"]}
    r = metrics.classification_metrics(got, average=average).first()
    return {f"{prefix}_{n}": r[k] for n, k in (("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"))}


def train_and_rank(models: dict[str, Estimator], train: DataFrame, test: DataFrame, task: str, average: str = "weighted") -> Trained:
    """Fits every model, measures it on both sets, and ranks: RMSE ascending or accuracy descending."""
    out, rows = Trained(), []
    for name, estimator in models.items():
        began = time.time()
        model = estimator.fit(train)
        seconds = time.time() - began
        out.models[name] = model
        rows.append({"Model": name} | _measures(model, train, task, "Train", average) | _measures(model, test, task, "Test", average) | {"Train_Time": seconds})
    names = list(rows[0])
    schema = ", ".join("Model string" if n == "Model" else f"{n} double" for n in names)
    board = train.sparkSession.createDataFrame([tuple(None if r[n] is None else r[n] if n == "Model" else float(r[n]) for n in names) for r in rows], schema)
    out.board = metrics.leaderboard_sort(board, task)
    return out


def cross_validate(estimator: Estimator, folds: DataFrame, task: str, average: str = "weighted") -> dict[str, float]:
    """Mean test measures over the time folds of ``folds`` (fold, features, label): training is all before a fold."""
    splits = folds.agg(F.max("fold")).first()[0] or 0
    got = [_measures(estimator.fit(folds.filter(F.col("fold") < k)), folds.filter(F.col("fold") == k), task, "CV", average) for k in range(1, splits + 1)]
    return {n: float(np.mean([g[n] for g in got])) for n in got[0]} if got else {}


#: Parameter grids by model (fixed values). Linear ones are in ``fold_grams``; 30 is the deepest tree that Spark grows,
#: and the least size of a split node, which has no counterpart, is not searched.
GRIDS: dict[str, dict[str, list]] = {
    "RandomForest": {"numTrees": [100, 200], "maxDepth": [10, 20, 30]},
    "GradientBoosting": {"maxIter": [100, 200], "stepSize": [0.01, 0.1], "maxDepth": [3, 5]},
    "DecisionTree": {"maxDepth": [5, 10]},
    "KNN": {"k": [3, 5, 7], "weighted": [False, True]},
    "LogisticRegression": {"C": [0.1, 1.0, 10.0]},
    "LinearSVC": {"C": [0.1, 1.0, 10.0]},
}


def with_values(estimator, values: dict, rows: int):
    """A copy of an estimator with other parameters; C is the inverse of Spark's penalty, which is per row."""
    if isinstance(estimator, NearestNeighbours):
        return NearestNeighbours(estimator.task, **({"k": estimator.k, "weighted": estimator.weighted} | values))
    if isinstance(estimator, C.OneVsRest):
        return C.OneVsRest(classifier=with_values(estimator.getClassifier(), values, rows))
    named = {("regParam" if n == "C" else n): (1.0 / (v * max(rows, 1)) if n == "C" else v) for n, v in values.items()}
    return estimator.copy({estimator.getParam(n): v for n, v in named.items()})


def grid_search(estimator: Estimator, grid: dict[str, list], folds: DataFrame, task: str, threads: int = 4) -> tuple[Estimator, dict[str, float]]:
    """The estimator with the grid values of best mean fold measure (RMSE or accuracy); fits run in a driver thread pool."""
    n = folds.count() if "C" in grid else 0
    ready = [with_values(estimator, c, n) for c in choices(grid)]
    with ThreadPoolExecutor(threads) as pool:
        scores = list(pool.map(lambda e: cross_validate(e, folds, task), ready))
    best = min(range(len(ready)), key=lambda i: scores[i]["CV_RMSE"] if task == "regression" else -scores[i]["CV_Accuracy"])
    return ready[best], scores[best]


def linear_on_folds(folds: DataFrame, train: DataFrame, names: list[str], tune: bool) -> tuple[dict[str, Estimator], dict[str, dict[str, float]]]:
    """Linear models of ``names`` ready to fit on ``train``, and their measures on the time folds: two passes for all
    of them, with every grid value tried when ``tune`` is set, and no refit on a fold."""
    grams = fold_grams(folds)
    values = {n: tune_linear(grams, n)[0] if tune and n in LINEAR_GRIDS else DEFAULTS[n] for n in names}
    made = {
        "LinearRegression": lambda v: linear_regression(),
        "Ridge": lambda v: ridge(train, v["alpha"]),
        "KernelRidge": lambda v: ridge(train, v["alpha"], intercept=False),
        "Lasso": lambda v: lasso(v["alpha"]),
        "ElasticNet": lambda v: elastic_net(train, v["alpha"], v["l1_ratio"]),
    }
    return {n: made[n](v) for n, v in values.items()}, dict(zip(values, measure_linear(folds, grams, list(values.items())), strict=True))


def feature_importance(model, features: list[str]) -> DataFrame:
    """(feature, importance) of a tree model, largest first."""
    from pyspark.sql import SparkSession

    values = model.featureImportances.toArray()
    return SparkSession.getActiveSession().createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def scoring_pipeline(categorical: list[str], numeric: list[str], estimator: Estimator) -> Pipeline:
    """Encode, assemble, predict as one pipeline that can be saved; unseen categories get an index of their own."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__code", stringOrderType="alphabetAsc", handleInvalid="keep") for c in categorical]
    return Pipeline(stages=[*index, VectorAssembler(inputCols=[*numeric, *[f"{c}__code" for c in categorical]], outputCol=FEATURES, handleInvalid="skip"), estimator])


def score_batch(df: DataFrame, path: str) -> DataFrame:
    """Predictions of a saved pipeline; ``df`` may be a stream."""
    return PipelineModel.load(path).transform(df)


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, task: str = "regression", weighted: bool = False) -> DataFrame:
    """(id, prediction) for test (id, v) from train (id, v, label)."""
    near = nearest(train.select("id", "v"), test.select("id", "v"), k)
    votes = near.join(train.select(F.col("id").alias("point"), F.col("label").alias("y")), "point")
    weight = F.lit(1.0) / F.greatest("distance", F.lit(1e-12)) if weighted else F.lit(1.0)
    if task == "regression":
        return votes.groupBy(F.col("query").alias("id")).agg((F.sum(F.col("y") * weight) / F.sum(weight)).alias("prediction"))
    per = votes.groupBy("query", "y").agg(F.sum(weight).alias("w"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("w"), "y"))
    return per.withColumn("r", best).filter("r = 1").select(F.col("query").alias("id"), F.col("y").alias("prediction"))
