"""Metrics over (label, prediction) columns, each from one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import q
from .profile import unpivot_row
from .series import running_sums


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mse, rmse, mae, r2, mape (per cent, with 1e-10 added to the label)."""
    y, p = q(label).cast("double"), q(prediction).cast("double")
    mse = F.avg((y - p) * (y - p))
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), (1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"), (F.avg(F.abs((y - p) / (y + 1e-10))) * 100).alias("mape"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(q(label).alias("label"), q(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", average: str = "weighted") -> DataFrame:
    """One row: accuracy, precision, recall, f1; weighted by class support, or of class 1 (binary). Zero division is 0."""
    m = confusion_matrix(df, label, prediction)
    hit = m.filter(q("label") == q("prediction")).groupBy("label").agg(F.sum("n").alias("tp"))
    support = m.groupBy("label").agg(F.sum("n").alias("support"))
    called = m.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("called"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    by = support.join(called, "label", "full").join(hit, "label", "left").select("label", zero("support").alias("support"), zero("called").alias("called"), zero("tp").alias("tp"))
    by = by.withColumns({"p": zero(F.try_divide("tp", "called")), "r": zero(F.try_divide("tp", "support"))}).withColumn("f", zero(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))))
    n = F.sum("support")
    if average == "binary":
        one = lambda c: F.coalesce(F.max(F.when(F.col("label") == 1, F.col(c))), F.lit(0.0))
        parts = [one("p").alias("precision"), one("r").alias("recall"), one("f").alias("f1")]
    else:
        parts = [(F.sum(F.col(c) * F.col("support")) / n).alias(name) for c, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))]
    return by.agg((F.sum("tp") / n).alias("accuracy"), *parts)


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tpr, fpr): one row for each distinct score, from counts by score."""
    counts = df.groupBy(q(score).alias("threshold")).agg(F.sum((q(label) == 1).cast("long")).alias("p"), F.sum((q(label) != 1).cast("long")).alias("n"))
    total = counts.agg(F.sum("p").alias("tp_all"), F.sum("n").alias("fp_all"))
    sums = running_sums(counts.withColumn("o", -F.col("threshold")), "o", ["p", "n"])
    return sums.crossJoin(F.broadcast(total)).select("threshold", F.try_divide("sum_p", "tp_all").alias("tpr"), F.try_divide("sum_n", "fp_all").alias("fpr"))  # one row joins


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the area under the ROC curve by ranks; ties count half."""
    counts = df.groupBy(q(score).alias("s")).agg(F.sum((q(label) == 1).cast("double")).alias("p"), F.sum((q(label) != 1).cast("double")).alias("n"))
    below = F.col("sum_n") - F.col("n")
    return running_sums(counts, "s", ["n"]).select("p", "n", below.alias("b")).agg(F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def leaderboard_sort(df: DataFrame, task: str) -> DataFrame:
    """RMSE ascending or accuracy descending, ties by name."""
    best = F.asc_nulls_last("Test_RMSE") if task == "regression" else F.desc_nulls_last("Test_Accuracy")
    return df.orderBy(best, *[F.col(c) for c in df.columns if c == "Model"])


def best_model(results: DataFrame, metric: str, order: str, higher: bool = True) -> DataFrame:
    """The row of the best metric; the first by ``order`` wins ties, null and NaN are skipped."""
    good = results.filter(q(metric).isNotNull() & ~F.isnan(q(metric)))
    return good.orderBy(F.desc(q(metric)) if higher else F.asc(q(metric)), order).limit(1)


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[q(c) for c in order]).limit(n)


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(q(score) * bins), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.avg(q(score)).alias("mean_score"), F.avg(q(label).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def metric_rows(one: DataFrame) -> DataFrame:
    return unpivot_row(one, [((c,), [F.col(c).cast("double")]) for c in one.columns], ["metric", "value"])
