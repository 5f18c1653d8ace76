"""Composed jobs: cleaning, profiling, training and clustering from one call each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.graph import materialise
from ..functions.quantiles import exact_quantiles
from ..operators import calendars as C
from ..operators import cluster as U
from ..operators import columns as P
from ..operators import estimators as M
from ..operators import nulls as N
from ..operators import profile as A
from ..operators import series as W
from ..operators import series_analysis as WA
from ..operators import transforms as T
from ..operators.columns import q


def handle_supervised_nulls(df: DataFrame, target: str | None) -> DataFrame:
    """Rows without target (if there is one), all-null and corrupted rows go; then columns of many nulls; medians and modes fill; target last."""
    inputs = [c for c in df.columns if c != target]
    df = N.drop_null_target(df, target) if target else df
    df = N.drop_all_null_rows(df, inputs)
    df = N.drop_corrupted_rows(df, 0.8, inputs)
    df = N.drop_high_null_columns(df, 0.6, keep=[target] if target else None)
    inputs = [c for c in df.columns if c != target]
    numeric = [c for c in P.column_groups(df).numeric if c != target]
    df = N.impute_numeric(df, "median", numeric)
    df = N.impute_categorical(df, "mode", [c for c in inputs if c not in numeric])
    return df.select(*[q(c) for c in inputs], *([q(target)] if target else []))


def preprocess_tabular(df: DataFrame, target: str | None = None) -> DataFrame:
    """A raw table cleaned for ``target`` (None: for clustering): names, strings, types, useless columns, duplicate rows, nulls; target last.

    Written once when its types are known and once without its repeated rows, so that the statistics
    passes read columns of a table instead of repeating what came before.
    """
    df = P.name_blank_columns(P.clean_strings(P.normalize_names(P.normalise_nan(df))))
    df = materialise(P.infer_numeric_columns(P.infer_datetime_columns(df)), "typed")
    df = P.drop_duplicate_columns(df)
    judged = [c for c in df.columns if c != target]
    df, _ = P.drop_constant_columns(df, judged)
    df, _ = P.drop_high_cardinality(df, cols=[c for c in df.columns if c != target])
    df = materialise(T.drop_duplicate_rows(df), "distinct")
    if any(N.null_shares(df, df.columns).values()):
        return handle_supervised_nulls(df, target)
    return df.select(*[q(c) for c in df.columns if c != target], *([q(target)] if target else []))


@dataclass
class SeriesReport:
    """What happened to the rows of a series: none is lost without being counted here.

    monotonic and negative_steps are None without a column of the input order. steps has a row for each key: frequency, rows,
    points of its grid, and rows off the grid (which have no place in the result).
    """

    rows: int = 0
    repeated_rows: int = 0
    unparsed_stamps: int = 0
    negative_steps: int | None = None
    monotonic: bool | None = None
    duplicated_rows: int = 0
    merged_rows: int = 0
    steps: DataFrame | None = None


def preprocess_series(
    df: DataFrame, ts: str, target: str | None = None, freq: str | None = None, duplicates: str = "mean", keys: list[str] = (), order_col: str | None = None
) -> tuple[DataFrame, SeriesReport]:
    """A raw series parsed, its inputs typed, without repeated rows and stamps, on its regular grid and filled; with a report.

    Every key has its own step unless ``freq`` gives one. Only input columns are typed or dropped: stamp, keys and target
    stay as they are (a target of texts is not interpolated). ``order_col`` tells the input order: it decides
    the order check and the first and last of a stamp, and is not part of the result; without it the order is not judged and
    the first of a stamp is the least row. Written once when parsed and once when stamps are unique.
    """
    keys = list(keys)
    fixed = [ts, *keys, *([target] if target else []), *([order_col] if order_col else [])]
    typed = P.clean_strings(P.normalise_nan(df), fixed).withColumnsRenamed({c: P.plain_name(c) for c in df.columns if c not in fixed})
    typed = P.name_blank_columns(typed)
    if len(typed.columns) > len(fixed):
        typed = P.infer_numeric_columns(P.infer_datetime_columns(typed, keep=fixed), 0.6, mode="ts", keep=fixed)
        typed = P.drop_duplicate_columns(typed, fixed)
        typed, _ = P.drop_constant_columns(typed, [c for c in typed.columns if c not in fixed])
        typed, _ = P.drop_high_cardinality(typed, cols=[c for c in typed.columns if c not in fixed])
    judged = [c for c in typed.columns if c != order_col]
    once = typed.groupBy(*[q(c) for c in judged]).agg(*([F.min(q(order_col)).alias(order_col)] if order_col else []), F.count(F.lit(1)).alias("__k"))
    kind = dict(once.dtypes)[ts]
    parsed = S.to_date(q(ts)) if kind == "string" else q(ts).cast("timestamp")
    once = materialise(once.withColumn(ts, parsed), "parsed")
    seen = once.agg(F.sum("__k"), F.sum(F.col("__k") - 1), F.count_if(q(ts).isNull())).first()
    report = SeriesReport(rows=seen[0] or 0, repeated_rows=seen[1] or 0, unparsed_stamps=seen[2])
    once = once.filter(q(ts).isNotNull()).drop("__k")
    if order_col:
        order = W.check_monotonic(once, ts, order_col, keys).first()
        report.negative_steps, report.monotonic, report.duplicated_rows = order["negative_steps"], order["monotonic"], order["duplicated_rows"]
    else:
        same = once.groupBy(*[q(k) for k in keys], q(ts)).agg(F.count(F.lit(1)).alias("k"))
        report.duplicated_rows = same.agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0))).first()[0]
    stamps = W.resolve_duplicate_timestamps(once, ts, duplicates, order_col, keys)
    stamps = materialise(stamps.drop(order_col) if order_col else stamps, "stamps")
    report.merged_rows = once.count() - stamps.count()
    steps = materialise(C.infer_steps(stamps, ts, keys) if freq is None else C.fixed_steps(stamps, ts, freq, keys), "steps")
    report.steps = C.grid_report(stamps, ts, steps, C.grid(steps, ts, keys), keys)
    filled = materialise(W.fill_gaps(stamps, ts, steps, "interpolate", keys), "filled")
    return W.fill_series_nulls(filled, ts, "auto", keys), report


@dataclass
class AutoPreprocessor:
    """Fits cleaning statistics on one table and reuses them on others."""

    strategy: str = "auto"
    clip: str = "iqr"
    scaling: str = "standard"
    columns: list[str] = field(default_factory=list)

    def _start(self, df: DataFrame) -> DataFrame:
        return P.standardize_units(P.snake_case_names(P.recognize_missing(df)))[0]

    def fit(self, df: DataFrame, target: str | None = None) -> AutoPreprocessor:
        df = T.drop_duplicate_rows(self._start(df))
        groups = P.column_groups(df)
        self.numeric = [c for c in groups.numeric if c != target]
        self.text = [c for c in groups.string if c != target]
        shares = N.null_shares(df, self.numeric)
        mean = [c for c in self.numeric if self.strategy == "mean" or self.strategy == "auto" and shares[c] < 0.3]
        got = P.one_row(df, {c: F.avg(q(c)) for c in mean} | {c: F.mode(q(c), deterministic=True) for c in self.text})
        got |= {c: v[0] if v else None for c, v in exact_quantiles(df, {c: q(c) for c in self.numeric if c not in mean}, [0.5]).items()}
        self.fill = {c: got[c] if got[c] is not None else "Unknown" for c in [*self.numeric, *self.text] if got[c] is not None or c in self.text}
        filled = self._fill(df)
        self.bounds = T.fit_iqr_bounds(filled, cols=self.numeric) if self.clip == "iqr" else T.fit_zscore_bounds(filled, cols=self.numeric)
        clipped = self.bounds.apply(filled)
        self.encoder = T.fit_label_encoder(clipped, self.text)
        self.scaler = T.fit_scaler(clipped, self.numeric, self.scaling)
        self.columns = df.columns
        return self

    def _fill(self, df: DataFrame) -> DataFrame:
        return N._fill(df, self.fill)

    def transform(self, df: DataFrame) -> DataFrame:
        df = self._fill(self._start(df).select(*[q(c) for c in self.columns]))
        return self.scaler.apply(self.encoder.apply(self.bounds.apply(df)))

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        return self.fit(df, target).transform(df)


@dataclass
class Explored:
    """Reports by name, and train and test after the fitted transforms."""

    reports: dict[str, DataFrame]
    train: DataFrame | None = None
    test: DataFrame | None = None
    balanced: str | None = None


def balance_classes(train: DataFrame, target: str, key: list[str], how: str = "smote", seed: int = 42) -> tuple[DataFrame, str]:
    """Classes made equal: ``smote`` (synthetic rows of the smaller ones; the result has inputs and target), ``oversample`` or
    ``undersample``; and the way that was taken. SMOTE needs numbers without nulls; other inputs are oversampled instead.
    """
    if how == "undersample":
        return T.random_undersample(train, target, key, seed), how
    inputs = [c for c in train.columns if c not in key and c != target]
    numeric = set(P.column_groups(train).numeric)
    if how == "smote" and inputs and all(c in numeric for c in inputs) and not any(N.null_shares(train, [*inputs, target]).values()):
        keyed = train.withColumn("__key", F.xxhash64(*[q(c) for c in key]))
        return T.smote(keyed, target, inputs, "__key", seed=seed), how
    if how not in ("smote", "oversample"):
        raise ValueError(f"unknown way {how!r} of balancing")
    return T.random_oversample(train, target, key, seed), "oversample"


def eda_tabular(df: DataFrame, target: str, task: str, key: list[str], seed: int = 42, balance: str | None = "smote") -> Explored:
    """Profile, split, leakage, clipping, skew, balance and collinearity; bounds are fitted on train and applied to both.

    Imbalanced classes of train are balanced in the way of ``balance`` (None: not).
    """
    stratify = target if task == "classification" else None
    train, test = T.random_split(df, key, 0.2, seed, stratify)
    reports = {"describe": A.describe(df), "profile": A.profile(df)}
    numeric = [c for c in P.column_groups(df).numeric if c not in key and c != target]
    if target in P.column_groups(df).numeric:
        reports["leakage"] = A.detect_leakage(train, target, cols=numeric)
        reports["target_correlation"] = A.target_correlation(train, target, 15, numeric)
    reports |= {"outliers": A.outlier_report_iqr(train, cols=numeric), "skewness": A.skewness_report(train, cols=numeric), "pairs": A.correlated_pairs(train, cols=numeric), "vif": A.vif(train, target, numeric)}
    bounds = T.fit_iqr_bounds(train, target, cols=numeric)
    train, test = bounds.apply(train), bounds.apply(test)
    logged = T.skewed_columns(train, target, cols=numeric)
    train, test = T.log_columns(train, logged), T.log_columns(test, logged)
    if task == "classification":
        reports["balance"] = A.class_balance(train, target)
        if balance and reports["balance"].filter("imbalanced").limit(1).count():
            train, way = balance_classes(materialise(train, "train"), target, key, balance, seed)
            return Explored(reports, train, test, way)
    return Explored(reports, train, test)


def eda_series(df: DataFrame, ts: str, target: str, freq: str = "D", lags: int = 25) -> Explored:
    period = WA.PERIODS.get(freq, 7)
    return Explored(
        {
            "summary": A.statistical_summary(df, target), "histogram": A.histogram(df, target), "box": A.box_stats(df, target), "outliers": A.outlier_flags(df, target).filter("is_outlier"),
            "adf": WA.adf_test(df, ts, target), "decomposition": WA.seasonal_decompose(df, ts, target, period), "acf": WA.acf(df, ts, target, lags), "pacf": WA.pacf(df, ts, target, lags),
            "bands": W.rolling_bands(df, ts, target), "lags": WA.lag_correlation(df, ts, target), "patterns": A.time_pattern_means(df, ts, target), "correlations": A.correlation_matrix(df),
        }
    )


def eda_unsupervised(df: DataFrame, key: list[str]) -> Explored:
    numeric = [c for c in P.column_groups(df).numeric if c not in key]
    return Explored(
        {
            "profile": A.profile(df), "skewness": A.skewness_report(df, cols=numeric), "correlations": A.correlation_matrix(df, numeric), "pairs": A.correlated_pairs(df, 0.7, False, numeric), "outliers": A.outlier_report_iqr(df, cols=numeric),
            "cardinality": A.cardinality_report(df), "variance": A.variance_report(df, cols=numeric), "sample": A.top_variance_sample(df, key, cols=numeric), "pca": U.pca_report(df, numeric),
        }
    )


def train_tabular(df: DataFrame, target: str, task: str, key: list[str], models: list[str] | None = None, trees: int = 100, seed: int = 42, best: int = 10) -> M.Trained:
    """Fills, encodes, splits, scales and selects on train only, then trains and ranks; tree importances come with the board."""
    df = T.drop_duplicate_rows(N.drop_null_target(df, target))
    text = [c for c in P.column_groups(df).string if c not in key and c != target]
    inputs = [c for c in df.columns if c not in key and c != target and (c in text or c in P.column_groups(df).numeric)]
    train, test = T.random_split(df, key, 0.2, seed, target if task == "classification" else None)
    numeric = [c for c in inputs if c not in text]
    fill = P.one_row(train, {c: F.avg(q(c)) for c in numeric} | {c: F.mode(q(c), deterministic=True) for c in text})
    fill = {c: v for c, v in fill.items() if v is not None}
    encoder = T.fit_label_encoder(N._fill(train, fill), text)
    ready = lambda d: encoder.apply(N._fill(d, fill))
    train, test = ready(train).persist(), ready(test).persist()
    scaler = T.fit_scaler(train, inputs, "standard")
    train, test = scaler.apply(train), scaler.apply(test)
    chosen = T.select_k_best(train, inputs, target, task, best)
    train, test = M.prepared(train, chosen, target).persist(), M.prepared(test, chosen, target).persist()
    make = M.regressors if task == "regression" else M.classifiers
    return M.train_and_rank(make(train, models, trees, seed), train, test, task)


def train_series(df: DataFrame, ts: str, target: str, task: str = "regression", plan: W.FeaturePlan = W.FeaturePlan(), models: list[str] | None = None, trees: int = 100, splits: int = 3, tune: bool = False) -> M.Trained:
    """Features, chronological split, scaling on train, optional grid search on time folds, cross-validation and ranking."""
    rows = W.engineer_features(df, ts, target, plan).persist()
    inputs = [c for c in P.column_groups(rows).numeric if c != target]
    train, test = WA.chronological_split(rows, ts)
    scaler = T.fit_scaler(train, inputs, "standard")
    train, test = M.prepared(scaler.apply(train), inputs, target).persist(), M.prepared(scaler.apply(test), inputs, target).persist()
    make = M.regressors if task == "regression" else M.classifiers
    estimators = make(train, models, trees)
    folds = WA.time_series_folds(train, ts, splits).persist()
    linear = [n for n in estimators if n in M.DEFAULTS]
    ready, measured = M.linear_on_folds(folds, train, linear, tune) if linear else ({}, {})
    estimators |= ready
    if tune:
        estimators |= {n: M.grid_search(e, M.GRIDS[n], folds, task)[0] for n, e in estimators.items() if n in M.GRIDS}
    cv = {n: measured[n] if n in measured else M.cross_validate(e, folds, task) for n, e in estimators.items()}
    out = M.train_and_rank(estimators, train, test, task)
    names = list(next(iter(cv.values())))
    table = train.sparkSession.createDataFrame([(n, *[float(v[k]) for k in names]) for n, v in cv.items()], ", ".join(["Model string", *[f"{k} double" for k in names]]))
    out.board = M.metrics.leaderboard_sort(out.board.join(table, "Model"), task)
    return out


@dataclass
class Clustered:
    rows: DataFrame
    sweep: DataFrame
    sizes: DataFrame
    profile: DataFrame
    comparison: DataFrame


def cluster(df: DataFrame, cols: list[str] | None = None, ks: range = range(2, 9)) -> Clustered:
    """Standardised matrix, k-means sweep and fit, Ward, density clusters, projection, profiles and their comparison."""
    matrix, cols = U.prepare_matrix(df, cols)
    matrix = materialise(matrix.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    sweep, k = U.kmeans_sweep(matrix, cols, ks)
    fitted, sizes = U.kmeans_fit(matrix, k)
    fitted = fitted.withColumnRenamed("prediction", "kmeans")
    ward = U.hierarchical(matrix, k).select("__id", F.col("prediction").alias("ward"))
    dense = U.dbscan(matrix.select(F.col("__id").alias("id"), F.array(*[q(c) for c in cols]).alias("v"))).select(F.col("id").alias("__id"), F.col("cluster").alias("dbscan"))
    rows = U.pca_project(fitted, cols, 2).join(ward, "__id").join(dense, "__id").persist()
    return Clustered(rows.drop("__id", "features"), sweep, sizes, A.cluster_profile(rows, "kmeans", cols), U.compare_clusterings(rows, cols, {"kmeans": "kmeans", "ward": "ward", "dbscan": "dbscan"}))


@dataclass
class Run:
    """A whole run: the cleaned table, what was explored, and the models or clusters."""

    clean: DataFrame
    explored: Explored
    result: M.Trained | Clustered
    series: SeriesReport | None = None
    fell_back: str | None = None

    @property
    def board(self) -> DataFrame:
        return self.result.board if isinstance(self.result, M.Trained) else self.result.comparison


def run(
    df: DataFrame, task: str, target: str | None = None, ts: str | None = None, key: list[str] = (), order_col: str | None = None, models: list[str] | None = None, trees: int = 100, ks: range = range(2, 9)
) -> Run:
    """Cleans, explores, and trains or clusters: tabular (regression, classification), series (with ``ts``), or unsupervised.

    When a cleaning job fails on its input (a bad value, or an error of Spark's) the fitted preprocessor takes its place and
    ``fell_back`` says why. ``key`` names columns that tell rows apart; without it a hash of the row does.
    """
    if task not in ("regression", "classification", "unsupervised"):
        raise ValueError(f"unknown task {task!r}")
    if task != "unsupervised" and target is None:
        raise ValueError("training needs a target")
    report, fell_back = None, None
    try:
        if ts is not None and task != "unsupervised":
            clean, report = preprocess_series(df, ts, target, order_col=order_col)
        else:
            clean = preprocess_tabular(df, target)
    except (ValueError, PySparkException) as e:
        fell_back = str(e).splitlines()[0] if str(e) else type(e).__name__
        clean = AutoPreprocessor().fit_transform(df, target)
    clean = materialise(clean, "clean")
    if ts is not None and task != "unsupervised":
        return Run(clean, eda_series(clean, ts, target), train_series(clean, ts, target, task, models=models, trees=trees), report, fell_back)
    keyed = clean if key else clean.withColumn("__key", F.xxhash64(*[q(c) for c in clean.columns]))
    key = list(key) or ["__key"]
    if task == "unsupervised":
        return Run(clean, eda_unsupervised(keyed, key), cluster(clean, ks=ks), None, fell_back)
    return Run(clean, eda_tabular(keyed, target, task, key), train_tabular(keyed, target, task, key, models, trees), None, fell_back)
