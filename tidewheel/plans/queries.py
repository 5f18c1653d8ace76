"""Registered queries over the given tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import materialise
from ..operators import cluster as U
from ..operators import columns as P
from ..operators import estimators as M
from ..operators import metrics as MM
from ..operators import nulls as N
from ..operators import profile as A
from ..operators import series as W
from ..operators import series_analysis as WA
from ..operators import transforms as T
from . import jobs as E
from .catalog import plain, relation

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Line items with nulls by rule.
LINES = """SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_extendedprice AS price,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS disc,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS tax,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag FROM {lineitem}"""
#: Orders as raw text.
TEXTS = """SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 11 = 0 THEN '?' WHEN o_orderkey % 13 = 0 THEN ' nan ' WHEN o_orderkey % 17 = 0 THEN '  ' ELSE '  ' || o_orderpriority || '   x ' END AS word,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 0 THEN '?' ELSE ' ' || CAST(o_custkey AS STRING) || ' ' END AS num,
  CASE WHEN o_orderkey % 10 = 0 THEN 'none at all' ELSE CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) END AS day
  FROM {orders}"""
#: One long daily series with real gaps.
DAILY = "SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, sum(o_totalprice) / 700 AS y, count(*) AS n FROM {orders} GROUP BY 1"
#: Several hourly series.
HOURLY = "SELECT event_type AS kind, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts, sum(value) AS y FROM {events} GROUP BY 1, 2"
#: Orders and a rule that guesses their status.
GUESSES = "SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS prediction, floor(o_totalprice / 20000) AS score FROM {orders}"
PRICES = "SELECT l_extendedprice AS label, l_quantity * 1500.0 AS prediction FROM {lineitem}"
DOCS = "SELECT d.doc_id, d.n_chars, d.lang, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"


def register(name: str, base: str, sql: str | None = None):
    """A query from a function of the relation ``base``; in ``sql`` the relation is ``base``."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        _QUERIES[name] = lambda spark, folder: f(relation(spark, folder, base))
        if sql is not None:
            _SQL[name] = f"WITH base AS ({plain(base)}) {sql.lstrip() if not sql.lstrip().upper().startswith('WITH') else ', ' + sql.lstrip()[4:]}"
        return f

    return add


def scaled_round(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded by scaling: unlike decimal rounding, small negative numbers keep their sign as -0.0."""
    unit = float(10**digits)
    return df.select(*[(F.rint(P.q(c) * unit) / unit).alias(c) if k in ("double", "float") else P.q(c) for c, k in df.dtypes])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(P.q(c), digits).alias(c) if k in ("double", "float") else P.q(c) for c, k in df.dtypes])


def as_day(df: DataFrame, *cols: str) -> DataFrame:
    """Stamps as text, which every engine writes alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


def as_ordered(df: DataFrame) -> DataFrame:
    """``df`` with position, from 1, as its rows come: a set of rows shows their order, too."""
    # written first: the numbers of partitions and rows are those of the sorted rows
    return W.distributed_rank(materialise(df.withColumn("__at", F.monotonically_increasing_id()), "ordered"), ["__at"], "position").drop("__at")


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# --- columns -------------------------------------------------------------------------------------
register("clean_strings", TEXTS, r"""SELECT id, CASE WHEN t IN ('nan','NaN','Nan','null','Null') THEN NULL ELSE t END AS word
FROM (SELECT id, trim(regexp_replace(word, '\s+', ' ', 'g')) AS t FROM base)""")(lambda df: P.clean_strings(df).select("id", "word"))

register("recognize_missing", TEXTS, """SELECT id, CASE WHEN word IN ('?','NA','N/A','na','n/a','nan','NaN','-','--','',' ','null','NULL','None','NONE','missing','MISSING','unknown','UNKNOWN') THEN NULL ELSE nullif(trim(word), '') END AS word,
CASE WHEN num IN ('?','NA','N/A','na','n/a') THEN NULL ELSE trim(num) END AS num FROM base""")(lambda df: P.recognize_missing(df).select("id", "word", "num"))

register("infer_datetime_columns", TEXTS, """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day FROM orders""")(
    lambda df: P.infer_datetime_columns(df).select("id", F.date_format("day", "yyyy-MM-dd").alias("day"))
)

register("infer_numeric_columns", TEXTS, "SELECT id, CASE WHEN num IN ('n/a', '?') THEN NULL ELSE CAST(trim(num) AS DOUBLE) END AS num FROM base")(lambda df: P.infer_numeric_columns(df).select("id", "num"))

register("infer_numeric_series", TEXTS, "SELECT id, CASE WHEN num IN ('n/a', '?') THEN NULL ELSE CAST(trim(num) AS BIGINT) END AS num FROM base")(lambda df: P.infer_numeric_columns(df, mode="ts").select("id", "num"))

register("drop_duplicate_columns", "SELECT l_orderkey AS a, l_linenumber AS n, l_orderkey * 1.0 AS b, l_quantity AS c, l_quantity AS d FROM {lineitem}", "SELECT a, n, c FROM base")(P.drop_duplicate_columns)

register("column_dominance", LINES, """, u AS (SELECT 'qty' AS "column", CAST(qty AS VARCHAR) AS v FROM base UNION ALL SELECT 'disc', CAST(disc AS VARCHAR) FROM base UNION ALL SELECT 'flag', flag FROM base)
SELECT "column", count(*) AS "distinct", max(k) AS top, CAST(sum(k) AS BIGINT) AS n FROM (SELECT "column", v, count(*) AS k FROM u WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")(lambda df: P.dominance(df, ["qty", "disc", "flag"]))

register("drop_constant_columns", "SELECT l_orderkey AS a, 1 AS b, CASE WHEN l_orderkey % 100 = 0 THEN 'x' ELSE 'y' END AS c, l_returnflag AS d, CAST(NULL AS STRING) AS e FROM {lineitem}", "SELECT a, d, e FROM base")(lambda df: P.drop_constant_columns(df)[0])

register("drop_high_cardinality", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM {customer}", "SELECT id, segment FROM base")(lambda df: P.drop_high_cardinality(df)[0])

register("standardize_units", "SELECT p_partkey AS id, p_size * 0.5 AS mpg, p_retailprice * 20 AS curb_weight, p_retailprice AS engine_size, CAST(p_size AS STRING) || ' hp' AS horsepower FROM {part}",
"""SELECT id, round(mpg * 2.352, 6) AS mpg, round(curb_weight * 0.453592, 6) AS curb_weight, round(engine_size / 1000, 6) AS engine_size, CAST(regexp_extract(horsepower, '(\\d+\\.?\\d*)', 1) AS DOUBLE) AS horsepower FROM base""")(lambda df: rounded(P.standardize_units(df)[0].withColumn("mpg", F.col("mpg").cast("double"))))  # fmt: skip

# --- nulls ---------------------------------------------------------------------------------------
register("drop_null_target", LINES, "SELECT l_orderkey, l_linenumber, disc FROM base WHERE disc IS NOT NULL")(lambda df: N.drop_null_target(df, "disc").select("l_orderkey", "l_linenumber", "disc"))
register("drop_all_null_rows", LINES, "SELECT l_orderkey, l_linenumber FROM base WHERE NOT (disc IS NULL AND tax IS NULL AND flag IS NULL)")(lambda df: N.drop_all_null_rows(df, ["disc", "tax", "flag"]).select("l_orderkey", "l_linenumber"))
register("drop_corrupted_rows", LINES, "SELECT l_orderkey, l_linenumber FROM base WHERE (CAST(disc IS NULL AS INT) + CAST(tax IS NULL AS INT) + CAST(flag IS NULL AS INT)) < 2")(lambda df: N.drop_corrupted_rows(df, 0.6, ["disc", "tax", "flag"]).select("l_orderkey", "l_linenumber"))
register("drop_any_null_rows", LINES, "SELECT * FROM base WHERE disc IS NOT NULL AND tax IS NOT NULL AND flag IS NOT NULL")(N.drop_any_null_rows)
register("drop_high_null_columns", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_totalprice END AS mostly_null, o_orderstatus AS status FROM {orders}", "SELECT id, status FROM base")(N.drop_high_null_columns)
register("parse_and_require_date", TEXTS, "SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 10 <> 0")(lambda df: N.parse_and_require_date(df, "day").select("id", F.date_format("day", "yyyy-MM-dd").alias("day")))
register("impute_numeric_median", LINES, "SELECT l_orderkey, l_linenumber, coalesce(disc, (SELECT quantile_cont(disc, 0.5) FROM base)) AS disc, coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM base)) AS tax FROM base")(lambda df: N.impute_numeric(df.select("l_orderkey", "l_linenumber", "disc", "tax"), "median", ["disc", "tax"]))
register("impute_numeric_mean", LINES, "SELECT l_orderkey, l_linenumber, round(coalesce(disc, (SELECT avg(disc) FROM base)), 8) AS disc FROM base")(lambda df: rounded(N.impute_numeric(df.select("l_orderkey", "l_linenumber", "disc"), "mean", ["disc"]), 8))
register("impute_numeric_zero", LINES, "SELECT l_orderkey, l_linenumber, coalesce(tax, 0) AS tax FROM base")(lambda df: N.impute_numeric(df.select("l_orderkey", "l_linenumber", "tax"), "zero", ["tax"]))
register("impute_categorical", LINES, "SELECT l_orderkey, l_linenumber, coalesce(flag, (SELECT flag FROM base WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM base")(lambda df: N.impute_categorical(df.select("l_orderkey", "l_linenumber", "flag")))
register("impute_auto", LINES, """SELECT l_orderkey, l_linenumber, round(coalesce(disc, (SELECT avg(disc) FROM base)), 8) AS disc,
coalesce(flag, (SELECT flag FROM base WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM base""")(lambda df: rounded(N.impute_auto(df.select("l_orderkey", "l_linenumber", "disc", "flag")), 8))
register("null_report", LINES, """, r AS (SELECT count(*) AS n, count(disc) AS a, count(tax) AS b, count(flag) AS c,
 CAST(sum(CASE WHEN k BETWEEN 1 AND 2 THEN 1 ELSE 0 END) AS BIGINT) AS part, CAST(sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) AS BIGINT) AS whole
 FROM (SELECT disc, tax, flag, CAST(disc IS NULL AS INT) + CAST(tax IS NULL AS INT) + CAST(flag IS NULL AS INT) AS k FROM base))
SELECT 'disc' AS "column", n - a AS nulls, round((n - a) / n, 8) AS share FROM r UNION ALL SELECT 'tax', n - b, round((n - b) / n, 8) FROM r UNION ALL SELECT 'flag', n - c, round((n - c) / n, 8) FROM r
UNION ALL SELECT '*', 3 * n - a - b - c, round((3 * n - a - b - c) / (3 * n), 8) FROM r UNION ALL SELECT '*partial', part, round(part / n, 8) FROM r UNION ALL SELECT '*full', whole, round(whole / n, 8) FROM r""")(lambda df: rounded(N.null_report(df.select("disc", "tax", "flag")), 8))

# --- profiles ------------------------------------------------------------------------------------
register("profile", LINES, """, s AS (SELECT qty, tax, flag FROM base)
SELECT 'qty' AS "column", 'double' AS type, count(qty) AS n, count(*) - count(qty) AS missing, count(DISTINCT qty) AS "distinct" FROM s
UNION ALL SELECT 'tax', 'double', count(tax), count(*) - count(tax), count(DISTINCT tax) FROM s
UNION ALL SELECT 'flag', 'string', count(flag), count(*) - count(flag), count(DISTINCT flag) FROM s
UNION ALL SELECT '*', 'table', count(*), 3 * count(*) - count(qty) - count(tax) - count(flag), count(*) - (SELECT count(*) FROM (SELECT DISTINCT qty, tax, flag FROM s)) FROM s""")(lambda df: A.profile(df.select("qty", "tax", "flag")))
#: Columns of lineitem with their types in Spark; one is null where the line has a discount.
_WIDE = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double", "l_extendedprice": "double", "undiscounted": "double", "l_returnflag": "string"}
_WIDE_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
  CASE WHEN l_discount = 0 THEN CAST(l_tax AS DOUBLE) END AS undiscounted, l_returnflag FROM {lineitem}"""
register(
    "profile_wide",  # every column of a table and whole rows, in one pass
    _WIDE_SQL,
    "\n"
    + "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS type, count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct" FROM base""" for c, t in _WIDE.items())
    + f"""
UNION ALL SELECT '*', 'table', count(*), {len(_WIDE)} * count(*) - {" - ".join(f"count({c})" for c in _WIDE)}, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM base)) FROM base""",
)(A.profile)
_D = lambda c: f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM base"""
register("describe", LINES, " UNION ALL ".join(map(_D, ("qty", "price", "disc", "tax"))))(lambda df: rounded(A.describe(df, ["qty", "price", "disc", "tax"]), 4))
register("value_counts", TEXTS, "SELECT word AS value, count(*) AS n, round(count(*) / (SELECT count(word) FROM base), 8) AS share FROM base WHERE word IS NOT NULL GROUP BY word ORDER BY n DESC, value LIMIT 10")(lambda df: rounded(A.value_counts(df, "word"), 8))
register("cardinality_report", "SELECT c_name AS name, c_mktsegment AS segment FROM {customer}", """SELECT 'name' AS "column", count(DISTINCT name) AS "distinct", count(DISTINCT name) / count(*) AS share FROM base UNION ALL SELECT 'segment', count(DISTINCT segment), count(DISTINCT segment) / count(*) FROM base""")(A.cardinality_report)
_S = "round(quantile_cont(tax, {p}), 6)"
register("statistical_summary", LINES, """, s AS (SELECT count(tax) AS n, avg(tax) AS m, quantile_cont(tax, 0.5) AS md, stddev_samp(tax) AS sd, min(tax) AS lo, max(tax) AS hi, quantile_cont(tax, 0.25) AS q1, quantile_cont(tax, 0.75) AS q3, skewness(tax) AS sk, kurtosis(tax) AS ku FROM base)
SELECT metric, round(value, 6) AS value FROM (
SELECT 'count' AS metric, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'mean', m FROM s UNION ALL SELECT 'median', md FROM s UNION ALL SELECT 'std', sd FROM s UNION ALL SELECT 'min', lo FROM s UNION ALL SELECT 'max', hi FROM s
UNION ALL SELECT 'range', hi - lo FROM s UNION ALL SELECT 'q1', q1 FROM s UNION ALL SELECT 'q3', q3 FROM s UNION ALL SELECT 'iqr', q3 - q1 FROM s UNION ALL SELECT 'skewness', sk FROM s UNION ALL SELECT 'kurtosis', ku FROM s UNION ALL SELECT 'cv', sd / m * 100 FROM s)""")(lambda df: rounded(A.statistical_summary(df, "tax")))
register("skewness_report", LINES, """SELECT 'qty' AS "column", round(skewness(qty), 6) AS skewness, abs(skewness(qty)) > 0.5 AS skewed FROM base UNION ALL SELECT 'price', round(skewness(price), 6), abs(skewness(price)) > 0.5 FROM base UNION ALL SELECT 'disc', round(skewness(disc), 6), abs(skewness(disc)) > 0.5 FROM base""")(lambda df: rounded(A.skewness_report(df, cols=["qty", "price", "disc"])))
register("histogram", LINES, """, e AS (SELECT min(price) AS lo, max(price) AS hi, count(price) AS n FROM base), b AS (SELECT CAST(least(floor((price - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, lo, hi, n FROM base, e WHERE price IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / 30), 4) AS lower, round(lo + (bin + 1) * ((hi - lo) / 30), 4) AS upper, count(*) AS n, round(count(*) / (n * ((hi - lo) / 30)) * 1000, 6) AS density FROM b GROUP BY bin, lo, hi, b.n""")(
    lambda df: A.histogram(df, "price", 30).select("bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "n", F.round(F.col("density") * 1000, 6).alias("density"))
)
register("box_stats", LINES, """, s AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3 FROM base)
SELECT round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(CASE WHEN price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN price END), 4) AS whisker_low,
round(max(CASE WHEN price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN price END), 4) AS whisker_high, CAST(sum(CASE WHEN price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM base, s GROUP BY q1, median, q3""")(lambda df: rounded(A.box_stats(df, "price"), 4))
register("qq_points", LINES, """SELECT round(i / 10.0, 6) AS p, round(quantile_cont(price, i / 10.0), 4) AS sample FROM base, (SELECT unnest([1,2,3,4,5,6,7,8,9]) AS i) GROUP BY i""".replace("quantile_cont(price, i / 10.0)", "list_extract((SELECT quantile_cont(price, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FROM base), i)"))(lambda df: A.qq_points(df, "price", 9).select(F.round("p", 6).alias("p"), F.round("sample", 4).alias("sample")))
_C = [("qty", "price"), ("qty", "disc"), ("qty", "tax"), ("price", "disc"), ("price", "tax"), ("disc", "tax")]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM base" for a, b in _C)
register("correlation_matrix", LINES, _CORR)(lambda df: rounded(A.correlation_matrix(df, ["qty", "price", "disc", "tax"])))
register("correlated_pairs", LINES, f"SELECT * FROM ({_CORR}) WHERE abs(r) >= 0.5")(lambda df: rounded(A.correlated_pairs(df, 0.5, cols=["qty", "price", "disc", "tax"])))
_TC = " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(corr({c}, price), 6) AS r FROM base""" for c in ("qty", "disc", "tax"))
register("target_correlation", LINES, _TC)(lambda df: rounded(A.target_correlation(df, "price", cols=["qty", "disc", "tax"])))
register("detect_leakage", "SELECT l_extendedprice AS y, l_extendedprice * 2 + 1 AS leak, l_tax AS tax FROM {lineitem}", """SELECT 'leak' AS "column", round(corr(leak, y), 6) AS r FROM base""")(lambda df: rounded(A.detect_leakage(df, "y")))
_OUT = lambda c: f"""SELECT '{c}' AS "column", round(lo, 4) AS lower, round(hi, 4) AS upper, CAST(sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) AS BIGINT) AS outliers, round(sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) / count(*), 8) AS share
FROM base, (SELECT quantile_cont({c}, 0.25) - 1.0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM base) GROUP BY lo, hi"""  # noqa: E731
register("outlier_report_iqr", LINES, " UNION ALL ".join(map(_OUT, ("qty", "price"))))(lambda df: A.outlier_report_iqr(df, 1.0, ["qty", "price"]).select("column", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "outliers", F.round("share", 8).alias("share")))
register("outlier_flags_zscore", LINES, "SELECT l_orderkey, l_linenumber, coalesce(abs(price - (SELECT avg(price) FROM base)) > 1.5 * (SELECT stddev_pop(price) FROM base), false) AS is_outlier FROM base")(lambda df: A.outlier_flags(df, "price", "zscore", 1.5).select("l_orderkey", "l_linenumber", "is_outlier"))
register("outlier_flags_iqr", LINES, "SELECT l_orderkey, l_linenumber, coalesce(price < lo OR price > hi, false) AS is_outlier FROM base, (SELECT quantile_cont(price, 0.25) - 0.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS lo, quantile_cont(price, 0.75) + 0.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS hi FROM base)")(lambda df: A.outlier_flags(df, "price", "iqr", 0.5).select("l_orderkey", "l_linenumber", "is_outlier"))
register("class_balance", DOCS, "SELECT quality AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM base), 8) AS share, (SELECT min(k) FROM (SELECT count(*) AS k FROM base GROUP BY quality)) / (SELECT count(*) FROM base) < 0.3 AS imbalanced FROM base GROUP BY quality")(lambda df: rounded(A.class_balance(df, "quality"), 8))
register("vif", LINES, """SELECT 'qty' AS "column", round(sum(qty * qty) * sum(price * price) / (sum(qty * qty) * sum(price * price) - sum(qty * price) * sum(qty * price)), 6) AS vif FROM base
UNION ALL SELECT 'price', round(sum(qty * qty) * sum(price * price) / (sum(qty * qty) * sum(price * price) - sum(qty * price) * sum(qty * price)), 6) FROM base""")(lambda df: rounded(A.vif(df, cols=["qty", "price"])))
register("variance_report", LINES, """SELECT 'qty' AS "column", round(var_samp(qty), 4) AS variance, round(count(*) / (count(*) - 1), 8) AS standardised, var_samp(qty) < 0.01 AS low FROM base UNION ALL SELECT 'disc', round(var_samp(disc), 4), round(count(*) / (count(*) - 1), 8), var_samp(disc) < 0.01 FROM base""")(lambda df: A.variance_report(df, cols=["qty", "disc"]).select("column", F.round("variance", 4).alias("variance"), F.round("standardised", 8).alias("standardised"), "low"))
register("top_variance_sample", LINES, "SELECT l_orderkey, l_linenumber, price, qty FROM base ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber) LIMIT 1000")(lambda df: A.top_variance_sample(df, ["l_orderkey", "l_linenumber"], 2))
register("time_pattern_means", "SELECT CAST(ts AS TIMESTAMP) AS ts, value FROM {events}", " UNION ALL ".join(f"SELECT '{n}' AS pattern, CAST({e} AS INTEGER) AS bucket, round(avg(value), 6) AS mean, count(value) AS n FROM base GROUP BY 2" for n, e in (("month", "month(ts)"), ("weekday", "isodow(ts) - 1"), ("quarter", "quarter(ts)"), ("weekend", "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END"), ("year", "year(ts)"), ("hour", "hour(ts)"))))(lambda df: rounded(A.time_pattern_means(df, "ts", "value")))
register("cluster_profile", "SELECT l_linenumber AS c, l_quantity AS qty, l_extendedprice AS price FROM {lineitem}", " UNION ALL ".join(f"""SELECT c AS cluster, '{x}' AS "column", count({x}) AS n, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, min({x}) AS min, max({x}) AS max FROM base GROUP BY c""" for x in ("qty", "price")))(lambda df: rounded(A.cluster_profile(df, "c", ["qty", "price"]), 4))

# --- series --------------------------------------------------------------------------------------
register("check_monotonic", "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM {events}", "SELECT CAST(sum(CASE WHEN ts < b THEN 1 ELSE 0 END) AS BIGINT) AS negative_steps, (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM base GROUP BY ts HAVING count(*) > 1)) AS duplicated_rows, sum(CASE WHEN ts < b THEN 1 ELSE 0 END) = 0 AS monotonic FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS b FROM base)")(lambda df: W.check_monotonic(df, "ts", "event_id"))
register("sort_series", DAILY, f"SELECT {stamp('ts')} AS ts, n, row_number() OVER (ORDER BY ts) AS position FROM base")(lambda df: as_day(as_ordered(W.sort_series(df, "ts").select("ts", "n")), "ts"))
_EV = "SELECT event_type AS kind, event_id, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts, value, user_id FROM {events}"
register("duplicate_timestamps", _EV, f"SELECT kind, event_id, {stamp('ts')} AS ts FROM (SELECT *, count(*) OVER (PARTITION BY kind, ts) AS k FROM base) WHERE k > 1")(lambda df: as_day(W.duplicate_timestamps(df, "ts", ["kind"]).select("kind", "event_id", "ts"), "ts"))
register("resolve_duplicates_first", _EV, f"SELECT kind, {stamp('ts')} AS ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY kind, ts ORDER BY event_id) AS r FROM base) WHERE r = 1")(lambda df: as_day(W.resolve_duplicate_timestamps(df, "ts", "first", "event_id", ["kind"]).select("kind", "ts", "event_id", "value"), "ts"))
register("resolve_duplicates_last", _EV, f"SELECT kind, {stamp('ts')} AS ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY kind, ts ORDER BY event_id DESC) AS r FROM base) WHERE r = 1")(lambda df: as_day(W.resolve_duplicate_timestamps(df, "ts", "last", "event_id", ["kind"]).select("kind", "ts", "event_id", "value"), "ts"))
register("resolve_duplicates_mean", _EV, f"SELECT kind, {stamp('ts')} AS ts, round(avg(value), 6) AS value FROM base GROUP BY kind, ts")(lambda df: as_day(rounded(W.resolve_duplicate_timestamps(df, "ts", "mean", "event_id", ["kind"]).select("kind", "ts", "value")), "ts"))
register("infer_frequency", DAILY, "SELECT CASE WHEN min(s) = max(s) THEN CAST(CAST(min(s) AS BIGINT) AS VARCHAR) || 's' WHEN quantile_cont(s, 0.5) <= 3600 THEN 'H' WHEN quantile_cont(s, 0.5) <= 86400 THEN 'D' WHEN quantile_cont(s, 0.5) <= 604800 THEN 'W' WHEN quantile_cont(s, 0.5) <= 2678400 THEN 'MS' ELSE 'YS' END AS frequency, quantile_cont(s, 0.5) AS step_seconds FROM (SELECT epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) AS s FROM base)")(lambda df: W.infer_frequency(df, "ts"))
_GRID = "g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM base))"
register("calendar_left_join", DAILY, f", {_GRID} SELECT {stamp('g.ts')} AS ts, n, round(y, 4) AS y FROM g LEFT JOIN base ON g.ts = base.ts")(lambda df: as_day(rounded(W.calendar_left_join(df, "ts", "D").select("ts", "n", "y"), 4), "ts"))
register("missing_timestamps", DAILY, f", {_GRID} SELECT {stamp('ts')} AS ts FROM g WHERE ts NOT IN (SELECT ts FROM base)")(lambda df: as_day(W.missing_timestamps(df, "ts", "D"), "ts"))
register("find_gaps", DAILY, f"SELECT {stamp('ts + INTERVAL 1 DAY')} AS gap_start, {stamp('nx - INTERVAL 1 DAY')} AS gap_end, date_diff('day', ts, nx) - 1 AS missing FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nx FROM base) WHERE date_diff('day', ts, nx) > 1")(lambda df: as_day(W.find_gaps(df, "ts", "D"), "gap_start", "gap_end"))
_LERP = f""", {_GRID}, j AS (SELECT g.ts, y, row_number() OVER (ORDER BY g.ts) AS i FROM g LEFT JOIN base ON g.ts = base.ts),
k AS (SELECT ts, y, i, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS ia, last_value(y IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS ya,
 first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib, first_value(y IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS yb FROM j)"""
register("fill_gaps_interpolate", DAILY, _LERP + f" SELECT {stamp('ts')} AS ts, round(coalesce(y, ya + (yb - ya) * (i - ia) / nullif(ib - ia, 0), ya, yb), 4) AS y FROM k")(lambda df: as_day(rounded(W.fill_gaps(df.select("ts", "y"), "ts", "D"), 4), "ts"))
register("fill_gaps_ffill", DAILY, _LERP + f" SELECT {stamp('ts')} AS ts, round(coalesce(y, ya, yb), 4) AS y FROM k")(lambda df: as_day(rounded(W.fill_gaps(df.select("ts", "y"), "ts", "D", "ffill"), 4), "ts"))
register("fill_gaps_bfill", DAILY, _LERP + f" SELECT {stamp('ts')} AS ts, round(coalesce(y, yb, ya), 4) AS y FROM k")(lambda df: as_day(rounded(W.fill_gaps(df.select("ts", "y"), "ts", "D", "bfill"), 4), "ts"))
register("fill_gaps_zero", DAILY, _LERP + f" SELECT {stamp('ts')} AS ts, round(coalesce(y, 0), 4) AS y FROM k")(lambda df: as_day(rounded(W.fill_gaps(df.select("ts", "y"), "ts", "D", "zero"), 4), "ts"))
_HOLES = "SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, CASE WHEN year(o_orderdate) * 372 + month(o_orderdate) * 31 + day(o_orderdate) IS NULL OR (day(o_orderdate) BETWEEN 4 AND 9) THEN NULL ELSE round(sum(o_totalprice) / 1000, 3) END AS y, count(*) AS n FROM {orders} GROUP BY 1, o_orderdate"
register("null_blocks", _HOLES, f""", f AS (SELECT ts, y IS NULL AS e, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY y IS NULL ORDER BY ts) AS run FROM base)
SELECT 'y' AS "column", {stamp('min(ts)')} AS block_start, {stamp('max(ts)')} AS block_end, count(*) AS size FROM f WHERE e GROUP BY run HAVING count(*) >= 3""")(lambda df: as_day(W.null_blocks(df, "ts", ["y"]), "block_start", "block_end"))
_LERP2 = """, j AS (SELECT ts, y, n, row_number() OVER (ORDER BY ts) AS i FROM base),
k AS (SELECT ts, y, n, i, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS ia, last_value(y IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS ya,
 first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib, first_value(y IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS yb FROM j)"""
register("interpolate_linear", _HOLES, _LERP2 + f" SELECT {stamp('ts')} AS ts, round(coalesce(y, ya + (yb - ya) * (i - ia) / nullif(ib - ia, 0), ya, yb), 4) AS y FROM k")(lambda df: as_day(rounded(W.interpolate_linear(df.select("ts", "y"), "ts", ["y"]), 4), "ts"))
register("fill_series_nulls", _HOLES, _LERP2 + f" SELECT {stamp('ts')} AS ts, round(coalesce(y, ya + (yb - ya) * (i - ia) / nullif(ib - ia, 0), ya, yb), 4) AS y, CAST(n AS DOUBLE) AS n FROM k")(lambda df: as_day(rounded(W.fill_series_nulls(df, "ts", "auto"), 4), "ts"))
_H = "PARTITION BY kind ORDER BY ts"
register("lag_features", HOURLY, f"SELECT kind, {stamp('ts')} AS ts, round(lag(y, 1) OVER ({_H}), 6) AS y_lag_1, round(lag(y, 7) OVER ({_H}), 6) AS y_lag_7 FROM base")(lambda df: as_day(rounded(W.lag_features(df, "ts", "y", (1, 7), ["kind"]).drop("y")), "ts"))
_R = lambda k: f"CASE WHEN count(y) OVER w{k} = {k} THEN round(avg(y) OVER w{k}, 6) END AS y_rolling_mean_{k}, CASE WHEN count(y) OVER w{k} = {k} THEN round(stddev_samp(y) OVER w{k}, 6) END AS y_rolling_std_{k}, CASE WHEN count(y) OVER w{k} = {k} THEN round(min(y) OVER w{k}, 6) END AS y_rolling_min_{k}, CASE WHEN count(y) OVER w{k} = {k} THEN round(max(y) OVER w{k}, 6) END AS y_rolling_max_{k}"
register("rolling_features", HOURLY, f"SELECT kind, {stamp('ts')} AS ts, {_R(7)}, {_R(14)} FROM base WINDOW w7 AS ({_H} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w14 AS ({_H} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)")(lambda df: as_day(rounded(W.rolling_features(df, "ts", "y", (7, 14), ["kind"]).drop("y")), "ts"))
register("rolling_bands", HOURLY, f"SELECT kind, {stamp('ts')} AS ts, CASE WHEN count(y) OVER w = 7 THEN round(avg(y) OVER w, 6) END AS mean_7, CASE WHEN count(y) OVER w = 7 THEN round(avg(y) OVER w + stddev_samp(y) OVER w, 6) END AS upper_7, CASE WHEN count(y) OVER w = 7 THEN round(avg(y) OVER w - stddev_samp(y) OVER w, 6) END AS lower_7 FROM base WINDOW w AS ({_H} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")(lambda df: as_day(rounded(W.rolling_bands(df, "ts", "y", (7,), ["kind"]).drop("y")), "ts"))
register("calendar_features", DAILY, f"""SELECT {stamp('ts')} AS ts, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(dayofyear(ts) AS INTEGER) AS dayofyear, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(weekofyear(ts) AS INTEGER) AS week,
CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN day(ts) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN CAST(ts AS DATE) = last_day(ts) THEN 1 ELSE 0 END AS is_month_end,
CASE WHEN day(ts) = 1 AND month(ts) IN (1, 4, 7, 10) THEN 1 ELSE 0 END AS is_quarter_start, CASE WHEN CAST(ts AS DATE) = last_day(ts) AND month(ts) IN (3, 6, 9, 12) THEN 1 ELSE 0 END AS is_quarter_end FROM base""")(lambda df: as_day(W.calendar_features(df.select("ts"), "ts"), "ts"))
register("difference_features", HOURLY, f"SELECT kind, {stamp('ts')} AS ts, round(y - lag(y, 1) OVER ({_H}), 6) AS y_diff_1, round(y / nullif(lag(y, 1) OVER ({_H}), 0) - 1, 6) AS y_pct_change_1 FROM base")(lambda df: as_day(rounded(W.difference_features(df, "ts", "y", (1,), ["kind"]).drop("y")), "ts"))
register("ewm_mean", HOURLY, f""", r AS (SELECT kind, ts, y, row_number() OVER ({_H}) AS i FROM base)
SELECT a.kind, {stamp('a.ts')} AS ts, round(sum(b.y * pow(0.75, a.i - b.i)) / sum(pow(0.75, a.i - b.i)), 6) AS y_ewm_mean_7 FROM r a JOIN r b ON a.kind = b.kind AND b.i <= a.i AND b.i > a.i - 400 GROUP BY a.kind, a.ts""")(lambda df: as_day(rounded(W.ewm_features(df, "ts", "y", (7,), ["kind"]).select("kind", "ts", "y_ewm_mean_7")), "ts"))
register("lag_correlation", DAILY, "SELECT k AS lag, round(r, 6) AS r FROM (SELECT 1 AS k, corr(y, a) AS r FROM (SELECT y, lag(y, 1) OVER (ORDER BY ts) AS a FROM base) UNION ALL SELECT 7, corr(y, a) FROM (SELECT y, lag(y, 7) OVER (ORDER BY ts) AS a FROM base))")(lambda df: rounded(WA.lag_correlation(df, "ts", "y", (1, 7))))
register("acf", DAILY, """, c AS (SELECT y - (SELECT avg(y) FROM base) AS y, row_number() OVER (ORDER BY ts) AS i FROM base)
SELECT CAST(k AS INTEGER) AS lag, round((SELECT sum(a.y * b.y) FROM c a JOIN c b ON a.i = b.i + k) / (SELECT sum(y * y) FROM c), 6) AS acf FROM (SELECT unnest([0,1,2,3,4,5]) AS k)""")(lambda df: rounded(WA.acf(df, "ts", "y", 5)))
register("seasonal_decompose", DAILY, f""", r AS (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS i FROM base), t AS (SELECT ts, y, i, CASE WHEN count(y) OVER w = 7 THEN avg(y) OVER w END AS trend FROM r WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT i % 7 AS p, avg(y - trend) AS m FROM t GROUP BY 1)
SELECT {stamp('ts')} AS ts, round(trend, 4) AS trend, round(m - (SELECT avg(m) FROM s), 4) AS seasonal FROM t JOIN s ON t.i % 7 = s.p""")(lambda df: as_day(rounded(WA.seasonal_decompose(df, "ts", "y", 7, extrapolate=False).select("ts", "trend", "seasonal"), 4), "ts"))
register("adf_test", DAILY)(lambda df: WA.adf_test(df, "ts", "y", 10))
register("chronological_split", DAILY, f"SELECT {stamp('ts')} AS ts, row_number() OVER (ORDER BY ts) <= CAST(floor((SELECT count(*) FROM base) * 0.8 + 1e-9) AS BIGINT) AS train FROM base")(lambda df: as_day((lambda s: s[0].select("ts", F.lit(True).alias("train")).union(s[1].select("ts", F.lit(False).alias("train"))))(WA.chronological_split(df, "ts")), "ts"))
register("time_series_folds", DAILY, f"SELECT {stamp('ts')} AS ts, CAST(CASE WHEN r <= n - 4 * (n // 5) THEN 0 ELSE 1 + (r - 1 - (n - 4 * (n // 5))) // (n // 5) END AS INTEGER) AS fold FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS r, (SELECT count(*) FROM base) AS n FROM base)")(lambda df: as_day(WA.time_series_folds(df.select("ts"), "ts", 4), "ts"))

# --- transforms ----------------------------------------------------------------------------------
register("drop_duplicate_rows", "SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c FROM {lineitem}", "SELECT DISTINCT * FROM base")(T.drop_duplicate_rows)
_Q = "(SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM base)"
register("clip_outliers", LINES, f"SELECT l_orderkey, l_linenumber, round(least(greatest(price, a - 0.2 * (b - a)), b + 0.2 * (b - a)), 4) AS price FROM base, {_Q}")(lambda df: rounded(T.clip_outliers(df, k=0.2, cols=["price"]).select("l_orderkey", "l_linenumber", "price"), 4))
register("clip_zscore", LINES, "SELECT l_orderkey, l_linenumber, round(least(greatest(price, m - s), m + s), 4) AS price FROM base, (SELECT avg(price) AS m, stddev_samp(price) AS s FROM base)")(lambda df: rounded(T.clip_zscore(df, 1.0, ["price"]).select("l_orderkey", "l_linenumber", "price"), 4))
register("log_transform", LINES, "SELECT l_orderkey, l_linenumber, round(ln(1 + price), 8) AS price, disc FROM base")(lambda df: rounded(T.log_transform(df, cols=["price", "disc"]).select("l_orderkey", "l_linenumber", "price", "disc"), 8))
register("transform_skewness", "SELECT o_orderkey, o_totalprice * o_totalprice AS y2 FROM {orders}", "SELECT o_orderkey, round(CASE WHEN abs((SELECT skewness(y2) FROM base)) > 0.5 THEN ln(1 + y2) ELSE y2 END, 6) AS y2 FROM base")(lambda df: rounded(T.transform_skewness(df, cols=["y2"])))
register("label_encode", "SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s FROM {orders}", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY p) - 1 AS INTEGER) AS p, CAST(dense_rank() OVER (ORDER BY s) - 1 AS INTEGER) AS s FROM base")(lambda df: T.label_encode(df, ["p", "s"]))
register("label_encode_unseen", "SELECT o_orderkey, o_orderpriority AS p FROM {orders}", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(dense_rank() OVER (ORDER BY p) - 1 AS INTEGER) END AS p FROM base")(lambda df: T.fit_label_encoder(df, ["p"]).apply(df.withColumn("p", F.when(F.col("o_orderkey") % 3 == 0, "never seen").otherwise(F.col("p")))))
register("scale_standard", LINES, "SELECT l_orderkey, l_linenumber, round((price - (SELECT avg(price) FROM base)) / (SELECT stddev_pop(price) FROM base), 6) AS price FROM base")(lambda df: rounded(T.scale(df, ["price"], "standard").select("l_orderkey", "l_linenumber", "price")))
register("scale_minmax", LINES, "SELECT l_orderkey, l_linenumber, round((price - lo) / (hi - lo), 6) AS price FROM base, (SELECT min(price) AS lo, max(price) AS hi FROM base)")(lambda df: rounded(T.scale(df, ["price"], "minmax").select("l_orderkey", "l_linenumber", "price")))
register("scale_robust", LINES, "SELECT l_orderkey, l_linenumber, round((price - m) / (b - a), 6) AS price FROM base, (SELECT quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM base)")(lambda df: rounded(T.scale(df, ["price"], "robust").select("l_orderkey", "l_linenumber", "price")))
_RANK = "row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id)"
register("random_undersample", DOCS, f"SELECT doc_id, quality FROM (SELECT doc_id, quality, {_RANK} AS r FROM base) WHERE r <= (SELECT min(k) FROM (SELECT count(*) AS k FROM base GROUP BY quality))")(lambda df: T.random_undersample(df, "quality", ["doc_id"]).select("doc_id", "quality"))
register("random_oversample", DOCS, f""", r AS (SELECT doc_id, quality, {_RANK} AS r, count(*) OVER (PARTITION BY quality) AS n, (SELECT max(k) FROM (SELECT count(*) AS k FROM base GROUP BY quality)) AS m FROM base)
SELECT doc_id, quality FROM (SELECT doc_id, quality, unnest(generate_series(1, m // n + CASE WHEN r <= m % n THEN 1 ELSE 0 END)) AS c FROM r)""")(lambda df: T.random_oversample(df, "quality", ["doc_id"]).select("doc_id", "quality"))
register("random_split", DOCS, "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM base) WHERE r <= ceil(0.2 * (SELECT count(*) FROM base) - 1e-9)")(lambda df: T.random_split(df, ["doc_id"])[1].select("doc_id"))
register("random_split_stratified", DOCS, f"SELECT doc_id, quality FROM (SELECT doc_id, quality, {_RANK} AS r, count(*) OVER (PARTITION BY quality) AS n FROM base) WHERE r <= ceil(0.2 * n - 1e-9)")(lambda df: T.random_split(df, ["doc_id"], stratify="quality")[1].select("doc_id", "quality"))
register("f_scores", LINES, """SELECT 'qty' AS "column", round(corr(qty, price) ** 2 / (1 - corr(qty, price) ** 2) * (count(*) - 2), 2) AS score FROM base UNION ALL SELECT 'tax', round(corr(tax, price) ** 2 / (1 - corr(tax, price) ** 2) * (count(tax) - 2), 2) FROM base""")(lambda df: rounded(T.f_scores(df, ["qty", "tax"], "price"), 2))
register("mutual_information", DOCS, """, e AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM base), b AS (SELECT CAST(n_chars > q[1] AS INT) + CAST(n_chars > q[2] AS INT) + CAST(n_chars > q[3] AS INT) AS bin, quality AS y FROM base, e),
j AS (SELECT bin, y, count(*) AS k FROM b GROUP BY 1, 2), w AS (SELECT k, sum(k) OVER () AS n, sum(k) OVER (PARTITION BY bin) AS kb, sum(k) OVER (PARTITION BY y) AS ky FROM j)
SELECT 'n_chars' AS "column", round(sum(k / n * ln(k * n / (kb * ky))), 6) AS score FROM w""")(lambda df: rounded(T.mutual_information(df, ["n_chars"], "quality", 4)))
register("smote", DOCS)(lambda df: T.smote(df.withColumn("len2", F.sqrt("n_chars")), "quality", ["n_chars", "len2"], "doc_id"))

# --- metrics and models --------------------------------------------------------------------------
register("regression_metrics", PRICES, "SELECT round(avg((label - prediction) ** 2) / 1e6, 4) AS mse, round(sqrt(avg((label - prediction) ** 2)), 4) AS rmse, round(avg(abs(label - prediction)), 4) AS mae, round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(label)), 6) AS r2, round(avg(abs((label - prediction) / (label + 1e-10))) * 100, 4) AS mape FROM base")(
    lambda df: MM.regression_metrics(df).select(F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.round("mape", 4).alias("mape"))
)
register("confusion_matrix", GUESSES, "SELECT label, prediction, count(*) AS n FROM base GROUP BY 1, 2")(MM.confusion_matrix)
register("classification_metrics", GUESSES, """, k AS (SELECT c, sum(CASE WHEN label = c AND prediction = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS s, sum(CASE WHEN prediction = c THEN 1 ELSE 0 END) AS p FROM base, (SELECT unnest([0, 1]) AS c) GROUP BY c),
m AS (SELECT s, tp, coalesce(tp / nullif(p, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r FROM k)
SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * s) / sum(s), 6) AS f1 FROM m""")(lambda df: rounded(MM.classification_metrics(df)))
register("roc_curve", GUESSES, """, c AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM base GROUP BY 1)
SELECT CAST(threshold AS BIGINT) AS threshold, round(sum(p) OVER w / (SELECT sum(p) FROM c), 6) AS tpr, round(sum(n) OVER w / (SELECT sum(n) FROM c), 6) AS fpr FROM c WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""")(lambda df: rounded(MM.roc_curve(df).withColumn("threshold", F.col("threshold").cast("long"))))
register("auc", GUESSES, """, c AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM base GROUP BY 1), d AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
SELECT round(sum(p * (b + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM d""")(lambda df: rounded(MM.auc(df)))
register("best_model", "SELECT n_nationkey AS pos, n_name AS model, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE CAST(n_nationkey % 5 AS DOUBLE) END AS score FROM {nation}", "SELECT * FROM base WHERE score IS NOT NULL ORDER BY score DESC, pos LIMIT 1")(lambda df: MM.best_model(df, "score", "pos"))
register("leaderboard_sort", "SELECT s_name AS Model, s_acctbal AS Test_RMSE FROM {supplier}", "SELECT *, row_number() OVER (ORDER BY Test_RMSE, Model) AS position FROM base")(lambda df: as_ordered(MM.leaderboard_sort(df, "regression")))
register("head", "SELECT o_orderkey, o_totalprice FROM {orders}", "SELECT * FROM base ORDER BY o_orderkey LIMIT 5")(lambda df: MM.head(df, ["o_orderkey"]))
_LR = "SELECT l_quantity AS x, l_extendedprice AS y FROM {lineitem}"


def _coefficients(df: DataFrame, estimator) -> DataFrame:
    rows = M.prepared(df, ["x"], "y")
    model = (estimator(rows) if callable(estimator) else estimator).fit(rows)
    return df.sparkSession.createDataFrame([(round(float(model.coefficients[0]), 4), round(float(model.intercept), 2))], "slope double, intercept double")


register("linear_regression", _LR, "SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept FROM base")(lambda df: _coefficients(df, lambda _: M.linear_regression()))
register("ridge_regression", _LR, "SELECT round(b, 4) AS slope, round(my - b * mx, 2) AS intercept FROM (SELECT covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 1.0) AS b, avg(y) AS my, avg(x) AS mx FROM base)")(lambda df: _coefficients(df, M.ridge))
_VEC = "SELECT vec_id AS id, embedding AS v, label FROM {embeddings}"
register("knn_classify", _VEC, """, t AS (SELECT id, CAST(v AS DOUBLE[]) AS v, label FROM base WHERE id % 5 <> 0), s AS (SELECT id, CAST(v AS DOUBLE[]) AS v FROM base WHERE id % 5 = 0),
d AS (SELECT s.id, t.label, row_number() OVER (PARTITION BY s.id ORDER BY list_distance(s.v, t.v), t.id) AS r FROM s, t), c AS (SELECT id, label, count(*) AS k FROM d WHERE r <= 5 GROUP BY 1, 2)
SELECT id, label AS prediction FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY k DESC, label) AS r FROM c) WHERE r = 1""")(lambda df: M.knn_predict(df.filter("id % 5 <> 0").select("id", F.col("v").cast("array<double>").alias("v"), "label"), df.filter("id % 5 = 0").select("id", F.col("v").cast("array<double>").alias("v")), 5, "classification"))
_SMALL = "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_extendedprice AS price, l_returnflag AS flag FROM {lineitem}"


register("feature_importance", _SMALL)(lambda df: M.feature_importance(M.regressors(M.prepared(df, ["qty", "disc", "tax"], "price"), ["DecisionTree5"])["DecisionTree5"].fit(M.prepared(df, ["qty", "disc", "tax"], "price")), ["qty", "disc", "tax"]))

# --- jobs ----------------------------------------------------------------------------------------
_JOB = "SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS flag, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS price FROM {lineitem}"
_NULLS = """SELECT k, n, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM base WHERE price IS NOT NULL)) AS qty, coalesce(flag, (SELECT flag FROM base WHERE price IS NOT NULL AND flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag, price FROM base WHERE price IS NOT NULL"""
register("handle_supervised_nulls", _JOB, _NULLS)(lambda df: E.handle_supervised_nulls(df, "price"))
_RAW = _JOB.replace("l_orderkey AS k, l_linenumber AS n", "l_orderkey AS `k `, l_linenumber AS n, 'same' AS constant, l_comment_id AS wide").replace("l_comment_id", "'row ' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING)")
register("preprocess_tabular", _RAW)(lambda df: E.preprocess_tabular(df, "price"))
_SQL["preprocess_tabular"] = f"WITH raw AS ({plain(_JOB)}), base AS (SELECT DISTINCT * FROM raw) {_NULLS}"
register("eda_tabular_train", DOCS)(lambda df: E.eda_tabular(df, "quality", "classification", ["doc_id"]).train)

# --- more of the same families ---------------------------------------------------------------------
_NAMES = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders}"
register("normalize_names", _NAMES, "SELECT o_orderkey AS order_key, o_orderstatus AS Status FROM base")(lambda df: P.normalize_names(df.select(F.col("o_orderkey").alias("  order \t key "), F.col("o_orderstatus").alias(" Status"))))
register("snake_case_names", _NAMES, "SELECT o_orderkey AS order_key, o_totalprice AS total_price FROM base")(lambda df: P.snake_case_names(df.select(F.col("o_orderkey").alias(" Order-Key"), F.col("o_totalprice").alias("Total Price "))))
register("name_blank_columns", _NAMES, "SELECT o_orderkey AS no_name_1, o_orderstatus AS status, o_totalprice AS no_name_2 FROM base")(lambda df: P.name_blank_columns(df.toDF(" ", "status", "  ")))
register("split_target", _NAMES, "SELECT o_totalprice FROM base")(lambda df: P.split_target(df, "o_totalprice")[1])
register("fill_gaps_by_key", HOURLY, f""", g AS (SELECT kind, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT kind, min(ts) AS lo, max(ts) AS hi FROM base GROUP BY kind))
SELECT g.kind, {stamp('g.ts')} AS ts, round(coalesce(y, 0), 6) AS y FROM g LEFT JOIN base ON g.kind = base.kind AND g.ts = base.ts""")(lambda df: as_day(rounded(W.fill_gaps(df, "ts", "H", "zero", ["kind"])), "ts"))
register("find_gaps_by_key", HOURLY, f"SELECT kind, {stamp('ts + INTERVAL 1 HOUR')} AS gap_start, {stamp('nx - INTERVAL 1 HOUR')} AS gap_end, date_diff('hour', ts, nx) - 1 AS missing FROM (SELECT kind, ts, lead(ts) OVER (PARTITION BY kind ORDER BY ts) AS nx FROM base) WHERE date_diff('hour', ts, nx) > 1")(lambda df: as_day(W.find_gaps(df, "ts", "H", ["kind"]), "gap_start", "gap_end"))
register("knn_regress", _VEC, """, t AS (SELECT id, CAST(v AS DOUBLE[]) AS v, label FROM base WHERE id % 5 <> 0), s AS (SELECT id, CAST(v AS DOUBLE[]) AS v FROM base WHERE id % 5 = 0),
d AS (SELECT s.id, t.label, row_number() OVER (PARTITION BY s.id ORDER BY list_distance(s.v, t.v), t.id) AS r FROM s, t) SELECT id, round(avg(label), 6) AS prediction FROM d WHERE r <= 5 GROUP BY id""")(lambda df: rounded(M.knn_predict(df.filter("id % 5 <> 0").select("id", F.col("v").cast("array<double>").alias("v"), "label"), df.filter("id % 5 = 0").select("id", F.col("v").cast("array<double>").alias("v")))))
register("cluster_sizes", "SELECT label FROM {embeddings}", "SELECT label AS cluster, count(*) AS n, round(count(*) / (SELECT count(*) FROM base), 8) AS share FROM base GROUP BY label")(lambda df: rounded(U.cluster_sizes(df, "label"), 8))
register("classification_metrics_binary", GUESSES, """SELECT round(avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy, round(sum(label * prediction) / sum(prediction), 6) AS precision, round(sum(label * prediction) / sum(label), 6) AS recall,
round(2 * sum(label * prediction) / (sum(label) + sum(prediction)), 6) AS f1 FROM base""")(lambda df: rounded(MM.classification_metrics(df, average="binary")))


def _tuned(df: DataFrame) -> DataFrame:
    rows = M.prepared(WA.time_series_folds(W.lag_features(df.select("ts", "y"), "ts", "y", (1, 7)).dropna(), "ts", 2), ["y_lag_1", "y_lag_7"], "y").persist()
    best, scores = M.grid_search(M.regressors(rows, ["DecisionTree"])["DecisionTree"], {"maxDepth": [2, 5]}, rows, "regression", 2)
    return df.sparkSession.createDataFrame([(best.getMaxDepth(), *[float(scores[k]) for k in ("CV_RMSE", "CV_MAE", "CV_R2")])], "max_depth int, cv_rmse double, cv_mae double, cv_r2 double")


register("grid_search", DAILY)(_tuned)


def queries() -> dict[str, Query]:
    from . import queries_composed  # noqa: F401 registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_composed  # noqa: F401

    return dict(_SQL)
