"""Row transforms: outliers, skew, encoding, scaling, resampling, selection, splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.distinct import hash_pair, hashable
from ..functions.quantiles import exact_quantiles
from ..functions.graph import materialise
from ..functions.neighbours import nearest
from .columns import column_groups, one_row, q
from .series import sums_before
from .profile import quartiles, unpivot_row


def keyed_order(key: list[str], seed: int, salt: str = "") -> Column:
    """md5 of seed and key: an order that is the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), *[q(c).cast("string") for c in key]))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


@dataclass(frozen=True)
class Bounds:
    """Fitted clipping bounds by column."""

    limits: dict[str, tuple[float, float]]

    def apply(self, df: DataFrame) -> DataFrame:
        clip = lambda c: F.when(q(c).isNotNull(), F.least(F.greatest(q(c).cast("double"), F.lit(self.limits[c][0])), F.lit(self.limits[c][1])))
        return df.select(*[clip(c).alias(c) if c in self.limits else q(c) for c in df.columns])


def fit_iqr_bounds(df: DataFrame, target: str | None = None, k: float = 1.5, cols: list[str] | None = None) -> Bounds:
    cols = [c for c in (cols if cols is not None else column_groups(df).numeric) if c != target]
    return Bounds({c: (a - k * (b - a), b + k * (b - a)) for c, (a, _, b) in quartiles(df, cols).items()})


def fit_zscore_bounds(df: DataFrame, threshold: float = 3.0, target: str | None = None, cols: list[str] | None = None) -> Bounds:
    cols = [c for c in (cols if cols is not None else column_groups(df).numeric) if c != target]
    got = one_row(df, {f"{n} {c}": f(q(c)) for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))})
    return Bounds({c: (got[f"m {c}"] - threshold * got[f"s {c}"], got[f"m {c}"] + threshold * got[f"s {c}"]) for c in cols if got[f"s {c}"] is not None})


def clip_outliers(df: DataFrame, target: str | None = None, k: float = 1.5, cols: list[str] | None = None) -> DataFrame:
    return fit_iqr_bounds(df, target, k, cols).apply(df)


def clip_zscore(df: DataFrame, threshold: float = 3.0, cols: list[str] | None = None) -> DataFrame:
    return fit_zscore_bounds(df, threshold, cols=cols).apply(df)


def positive_columns(df: DataFrame, cols: list[str]) -> list[str]:
    got = one_row(df, {c: F.bool_and(F.coalesce(q(c) > 0, F.lit(False))) for c in cols})
    return [c for c in cols if got[c]]


def log_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.log1p(q(c)).alias(c) if c in cols else q(c) for c in df.columns])


def log_transform(df: DataFrame, target: str | None = None, cols: list[str] | None = None) -> DataFrame:
    """log1p of numeric columns that are all above 0 (a null is not)."""
    cols = [c for c in (cols if cols is not None else column_groups(df).numeric) if c != target]
    return log_columns(df, positive_columns(df, cols))


def skewed_columns(df: DataFrame, target: str | None = None, limit: float = 0.5, cols: list[str] | None = None) -> list[str]:
    """Columns that transform_skewness changes: skewed beyond ``limit`` and all above 0."""
    cols = [c for c in (cols if cols is not None else column_groups(df).numeric) if c != target]
    skew = one_row(df, {c: S.sample_skew(q(c)) for c in cols})
    return positive_columns(df, [c for c in cols if skew[c] is not None and abs(skew[c]) > limit])


def transform_skewness(df: DataFrame, target: str | None = None, limit: float = 0.5, cols: list[str] | None = None) -> DataFrame:
    return log_columns(df, skewed_columns(df, target, limit, cols))


@dataclass(frozen=True)
class LabelEncoder:
    """Codes by sorted value; unseen values are code 0, nulls stay null."""

    cols: list[str]
    codes: dict[str, DataFrame]

    def apply(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.cols:
            table = self.codes[c].select(F.col("value").alias("__v"), F.col("code").alias("__code"))
            out = out.join(table, q(c).cast("string") == F.col("__v"), "left").withColumn(c, F.when(q(c).isNotNull(), F.coalesce("__code", F.lit(0)))).drop("__v", "__code")
        return out.select(*[q(c) for c in df.columns])


#: Distinct values sampled for each range in which they are ranked.
SAMPLED = 50


def fit_label_encoder(df: DataFrame, cols: list[str]) -> LabelEncoder:
    """The distinct values are ranked in ranges of about equal size and offset by the ranges' counts, then written.

    The ranges' bounds are values of a sample by hash, fixed as literals; no task sorts all values.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def table(c: str) -> DataFrame:
        values = materialise(df.filter(q(c).isNotNull()).select(q(c).cast("string").alias("value")).distinct(), "values")
        sample = sorted(r[0] for r in values.orderBy(F.xxhash64("value")).limit(parts * SAMPLED).collect())
        bounds = sample[SAMPLED::SAMPLED]
        place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("value"))) if bounds else F.lit(0)
        ranged = values.withColumn("__b", place)
        before = sums_before(ranged.groupBy("__b").agg(F.count(F.lit(1)).alias("n")), ["n"])
        local = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("value")))
        ranked = local.join(F.broadcast(before), F.col("__b") == F.col("__q"))  # a row a range
        return materialise(ranked.select("value", (F.col("__r") + F.col("__before_n") - 1).cast("int").alias("code")), "codes")

    return LabelEncoder(cols, {c: table(c) for c in cols})


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    return fit_label_encoder(df, cols).apply(df)


@dataclass(frozen=True)
class Scaler:
    """(x - centre) / spread by column."""

    centre: dict[str, float]
    spread: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[((q(c) - F.lit(self.centre[c])) / F.lit(self.spread[c])).alias(c) if c in self.centre else q(c) for c in df.columns])


def fit_scaler(df: DataFrame, cols: list[str], how: str = "standard") -> Scaler:
    """standard: mean and population std; minmax: least and range; robust: median and interquartile range. Zero spread is 1."""
    if how == "robust":
        got = quartiles(df, cols)
        centre, spread = {c: v[1] for c, v in got.items()}, {c: v[2] - v[0] for c, v in got.items()}
    else:
        a, b = (F.avg, F.stddev_pop) if how == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
        row = one_row(df, {f"{n} {c}": f(q(c)).cast("double") for c in cols for n, f in (("a", a), ("b", b))})
        centre, spread = {c: row[f"a {c}"] for c in cols}, {c: row[f"b {c}"] for c in cols}
    known = [c for c in cols if centre.get(c) is not None]
    return Scaler({c: centre[c] for c in known}, {c: spread[c] or 1.0 for c in known})


def scale(df: DataFrame, cols: list[str], how: str = "standard") -> DataFrame:
    return fit_scaler(df, cols, how).apply(df)


def _ranked(df: DataFrame, target: str, key: list[str], seed: int) -> DataFrame:
    """``df`` with __r, the md5-ordered position within its class, and __n, the class size.

    Classes are cut by the first hash byte, ranked in those buckets and offset by bucket counts, so that
    a class of most rows is not sorted in one task. Rows of equal keys follow a hash of all their columns, so that every
    evaluation ranks them alike: such a row is in the train or in the test set, never in both or neither.
    """
    ties = hash_pair(*[hashable(df, c) for c in df.columns])
    rows = df.withColumns({"__h": keyed_order(key, seed), "__t": ties[0], "__u": ties[1]}).withColumn("__b", F.substring("__h", 1, 2))
    counts = rows.groupBy(q(target).alias("__y"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy("__y").orderBy("__c")
    counts = counts.select("__y", "__c", (F.sum("__k").over(w) - F.col("__k")).alias("__before"), F.sum("__k").over(Window.partitionBy("__y")).alias("__n"))
    local = rows.withColumn("__i", F.row_number().over(Window.partitionBy(q(target), "__b").orderBy("__h", *[q(c) for c in key], "__t", "__u")))
    joined = local.join(counts, q(target).eqNullSafe(F.col("__y")) & (F.col("__b") == F.col("__c")))
    return joined.withColumn("__r", F.col("__i") + F.col("__before")).drop("__h", "__t", "__u", "__b", "__y", "__c", "__before", "__i")


def random_split(df: DataFrame, key: list[str], test_share: float = 0.2, seed: int = 42, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test of exact sizes (test = ceil(share * n), by class if stratified), ordered by md5 of seed and key."""
    base = df if stratify else df.withColumn("__all", F.lit(1))
    ranked = _ranked(base, stratify or "__all", key, seed)
    test = F.col("__r") <= F.ceil(F.col("__n") * F.lit(test_share) - 1e-9)
    cut = lambda cond: ranked.filter(cond).select(*[q(c) for c in df.columns])
    return cut(~test), cut(test)


def random_undersample(df: DataFrame, target: str, key: list[str], seed: int = 42) -> DataFrame:
    """Every class down to the least class count."""
    least = df.groupBy(q(target)).agg(F.count(F.lit(1)).alias("k")).agg(F.min("k")).first()[0] or 0
    return _ranked(df, target, key, seed).filter(F.col("__r") <= least).select(*[q(c) for c in df.columns])


def random_oversample(df: DataFrame, target: str, key: list[str], seed: int = 42) -> DataFrame:
    """Every class up to the largest class count: whole copies, and one more of the first rows by md5."""
    most = df.groupBy(q(target)).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    copies = (F.floor(F.lit(most) / F.col("__n")) + F.when(F.col("__r") <= F.lit(most) % F.col("__n"), 1).otherwise(0)).cast("int")
    return _ranked(df, target, key, seed).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select(*[q(c) for c in df.columns])


def smote(df: DataFrame, target: str, features: list[str], key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` (features and target) with synthetic rows of every smaller class up to the largest.

    A synthetic row lies at a hashed share of the way from a row to one of its k nearest of the class.
    Classes of one row are copied. Neighbours come from blocked distances, never from a cross join of rows.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(q(target)).agg(F.count(F.lit(1))).collect()}
    most = max(sizes.values(), default=0)
    out = df.select(*[q(c) for c in features], q(target))
    for value, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        if n >= most or value is None:
            continue
        rows = df.filter(q(target) == F.lit(value)).select(q(key).cast("long").alias("id"), F.array(*[q(c).cast("double") for c in features]).alias("v"))
        # how many synthetic rows each row starts: evenly, the first by hash one more
        ranked = _ranked(rows.withColumn("__one", F.lit(1)), "__one", ["id"], seed)
        times = (F.floor(F.lit(most - n) / F.lit(n)) + F.when(F.col("__r") <= (most - n) % n, 1).otherwise(0)).cast("int")
        starts = ranked.filter(times > 0).withColumn("t", F.explode(F.sequence(F.lit(1), times))).select("id", "v", "t")
        if n == 1:
            made = starts.select(F.col("v").alias("s"))
        else:
            near = nearest(rows, rows, min(k, n - 1), skip_same=True).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "point"))).alias("near"))
            unit = lambda salt: F.pmod(F.xxhash64("id", "t", F.lit(seed), F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))
            chosen = starts.join(near, F.col("id") == F.col("query")).withColumn("other", F.get("near", F.floor(unit("n") * F.size("near")).cast("int"))["point"]).withColumn("u", unit("u"))
            other = rows.select(F.col("id").alias("other"), F.col("v").alias("w"))
            made = chosen.join(other, "other").select(F.zip_with("v", "w", lambda a, b: a + F.lit(1.0) * (b - a) * F.col("u")).alias("s"))
        out = out.unionByName(made.select(*[F.get("s", F.lit(i)).alias(c) for i, c in enumerate(features)], F.lit(value).alias(target)))
    return out


def f_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(column, score): F of each feature alone against a numeric target."""
    one = df.agg(*[e for i, c in enumerate(features) for e in (F.corr(q(c), q(target)).alias(f"r{i}"), F.count_if(q(c).isNotNull() & q(target).isNotNull()).alias(f"n{i}"))])
    score = lambda i: F.try_divide(F.col(f"r{i}") * F.col(f"r{i}"), 1 - F.col(f"r{i}") * F.col(f"r{i}")) * (F.col(f"n{i}") - 2)
    return unpivot_row(one, [((c,), [S.not_nan(score(i))]) for i, c in enumerate(features)], ["column", "score"])


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """(column, score): mutual information in nats of each feature, cut at its quantiles, with a class target."""
    edges = exact_quantiles(df, {c: q(c) for c in features}, [i / bins for i in range(1, bins)])
    rows = df.select(q(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), sum((F.when(q(c) > e, 1).otherwise(0) for e in edges[c] or []), F.lit(0)).alias("bin"), q(c).isNotNull().alias("ok")) for c in features])).alias("p")).select("y", "p.*").filter("ok and y is not null")
    joint = rows.groupBy("column", "bin", "y").agg(F.count(F.lit(1)).alias("k"))
    total = lambda *by: F.sum("k").over(Window.partitionBy("column", *by))
    p = joint.select("column", "k", total().alias("n"), total("bin").alias("kb"), total("y").alias("ky"))
    return p.groupBy("column").agg(F.sum(F.col("k") / F.col("n") * F.log(F.col("k") * F.col("n") / (F.col("kb") * F.col("ky")))).alias("score"))


def select_k_best(df: DataFrame, features: list[str], target: str, task: str = "regression", k: int = 10) -> list[str]:
    scores = f_scores(df, features, target) if task == "regression" else mutual_information(df, features, target)
    return [r["column"] for r in scores.orderBy(F.desc_nulls_last("score"), "column").limit(k).collect()]


def assemble(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol=name).transform(df)


