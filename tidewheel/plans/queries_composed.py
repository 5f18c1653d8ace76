"""Queries of operators that combine others: engineered features, cleaning jobs, models and clusters.

They run with the operators' own defaults over whole tables; what SQL can express has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import fresh_path
from ..functions.summaries import clustering_features
from ..operators import cluster as U
from ..operators import estimators as M
from ..operators import profile as A
from ..operators import series as W
from ..operators import series_analysis as WA
from ..operators import transforms as T
from ..sources.tables import read_table, write_table
from . import jobs as E
from . import queries
from .catalog import plain
from .queries import DAILY, DOCS, HOURLY, LINES, as_day, register, rounded, scaled_round, stamp

# --- series --------------------------------------------------------------------------------------
#: Weighted sums of the last 400 rows (0.75**400 is nothing) for a span of 7.
EWM = """
  SELECT {keys} a.ts,
    sum(b.y * pow(0.75, a.i - b.i)) / sum(pow(0.75, a.i - b.i)) AS mean,
    sqrt(
      (sum(b.y * b.y * pow(0.75, a.i - b.i)) / sum(pow(0.75, a.i - b.i))
        - pow(sum(b.y * pow(0.75, a.i - b.i)) / sum(pow(0.75, a.i - b.i)), 2))
      * pow(sum(pow(0.75, a.i - b.i)), 2)
      / nullif(pow(sum(pow(0.75, a.i - b.i)), 2) - sum(pow(0.75, 2 * (a.i - b.i))), 0)) AS std
  FROM r a JOIN r b ON {on} b.i <= a.i AND b.i > a.i - 400
  GROUP BY {keys} a.ts
"""

register(
    "ewm_std",
    HOURLY,
    f""", c AS (SELECT kind, ts, y - avg(y) OVER (PARTITION BY kind) AS y FROM base),
r AS (SELECT kind, ts, y, row_number() OVER (PARTITION BY kind ORDER BY ts) AS i FROM c),
e AS ({EWM.format(keys="a.kind,", on="a.kind = b.kind AND")})
SELECT kind, {stamp("ts")} AS ts, round(std, 4) AS y_ewm_std_7 FROM e""",
)(lambda df: as_day(rounded(W.ewm_features(df, "ts", "y", (7,), ["kind"]).select("kind", "ts", F.nanvl("y_ewm_std_7", F.lit(None)).alias("y_ewm_std_7")), 4), "ts"))

register(
    "engineer_features",
    DAILY,
    f""", r AS (SELECT ts, y, row_number() OVER (ORDER BY ts) AS i FROM base),
m AS (SELECT avg(y) AS centre FROM base),
e AS ({EWM.format(keys="", on="").replace("b.y", "(b.y - (SELECT centre FROM m))")}),
w AS (
  SELECT ts, y, i, lag(y, 1) OVER o AS lag1, lag(y, 7) OVER o AS lag7,
    avg(y) OVER s AS mean, stddev_samp(y) OVER s AS std, min(y) OVER s AS least, max(y) OVER s AS most
  FROM r WINDOW o AS (ORDER BY ts), s AS (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
)
SELECT {stamp("w.ts")} AS ts, round(y, 4) AS y, round(lag1, 4) AS y_lag_1, round(lag7, 4) AS y_lag_7,
  round(w.mean, 4) AS y_rolling_mean_7, round(w.std, 4) AS y_rolling_std_7, round(least, 4) AS y_rolling_min_7, round(most, 4) AS y_rolling_max_7,
  round(y - lag1, 4) AS y_diff_1, round(y / lag1 - 1, 4) AS y_pct_change_1,
  CAST(year(w.ts) AS INTEGER) AS year, CAST(month(w.ts) AS INTEGER) AS month, CAST(day(w.ts) AS INTEGER) AS day,
  CAST(isodow(w.ts) - 1 AS INTEGER) AS dayofweek, CAST(dayofyear(w.ts) AS INTEGER) AS dayofyear,
  CAST(quarter(w.ts) AS INTEGER) AS quarter, CAST(weekofyear(w.ts) AS INTEGER) AS week,
  CAST(isodow(w.ts) >= 6 AS INTEGER) AS is_weekend, CAST(day(w.ts) = 1 AS INTEGER) AS is_month_start,
  CAST(month(w.ts + INTERVAL 1 DAY) <> month(w.ts) AS INTEGER) AS is_month_end,
  CAST(day(w.ts) = 1 AND month(w.ts) % 3 = 1 AS INTEGER) AS is_quarter_start,
  CAST(quarter(w.ts + INTERVAL 1 DAY) <> quarter(w.ts) AS INTEGER) AS is_quarter_end,
  round(e.mean + (SELECT centre FROM m), 4) AS y_ewm_mean_7, round(e.std, 4) AS y_ewm_std_7
FROM w JOIN e ON w.ts = e.ts WHERE i >= 8""",
)(lambda df: as_day(scaled_round(W.engineer_features(df.select("ts", "y"), "ts", "y", W.FeaturePlan((1, 7), (7,), (1,), (7,))), 4), "ts"))

queries._SQL["pacf"] = (
    f"WITH RECURSIVE base AS ({plain(DAILY)}), "
    """c AS (SELECT y - (SELECT avg(y) FROM base) AS y, row_number() OVER (ORDER BY ts) AS i FROM base),
s AS (SELECT k, (SELECT sum(a.y * b.y) FROM c a JOIN c b ON a.i = b.i + k) / (SELECT sum(y * y) FROM c) AS rho FROM (SELECT unnest(range(11)) AS k)),
rho AS (SELECT list(rho ORDER BY k) AS r FROM s),
dl(k, phi, a) AS (
  SELECT 1, [r[2]], r[2] FROM rho
  UNION ALL
  SELECT CAST(k + 1 AS INTEGER), list_append(list_transform(range(1, k + 1), lambda j: phi[j] - n * phi[k + 1 - j]), n), n
  FROM (
    SELECT k, phi, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
      / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS n
    FROM dl, rho WHERE k < 10)
)
SELECT 0 AS lag, 1.0::DOUBLE AS pacf UNION ALL SELECT CAST(k AS INTEGER), round(a, 6) FROM dl"""
)
register("pacf", DAILY)(lambda df: rounded(WA.pacf(df, "ts", "y", 10)))

_GRID = "g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM base))"
register("fill_gaps_mean", DAILY, f", {_GRID} SELECT {stamp('g.ts')} AS ts, round(coalesce(y, (SELECT avg(y) FROM base)), 4) AS y FROM g LEFT JOIN base ON g.ts = base.ts")(
    lambda df: as_day(rounded(W.fill_gaps(df.select("ts", "y"), "ts", "D", "mean"), 4), "ts")
)

_EVENTS = "SELECT event_type AS kind, date_trunc('day', CAST(ts AS TIMESTAMP)) AS ts, event_id, value FROM {events}"
register("resolve_duplicates_sum", _EVENTS, f"SELECT kind, {stamp('ts')} AS ts, round(sum(value), 4) AS value FROM base GROUP BY kind, ts")(
    lambda df: as_day(rounded(W.resolve_duplicate_timestamps(df, "ts", "sum", "event_id", ["kind"]).select("kind", "ts", "value"), 4), "ts")
)

register(
    "preprocess_series",
    HOURLY,
    f""", g AS (SELECT kind, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT kind, min(ts) AS lo, max(ts) AS hi FROM base GROUP BY kind)),
j AS (SELECT g.kind, g.ts, y, row_number() OVER (PARTITION BY g.kind ORDER BY g.ts) AS i FROM g LEFT JOIN base ON g.kind = base.kind AND g.ts = base.ts),
k AS (
  SELECT kind, ts, y, i,
    last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, last_value(y IGNORE NULLS) OVER b AS ya,
    first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ib, first_value(y IGNORE NULLS) OVER a AS yb
  FROM j WINDOW b AS (PARTITION BY kind ORDER BY i ROWS UNBOUNDED PRECEDING),
    a AS (PARTITION BY kind ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)
SELECT kind, {stamp("ts")} AS ts, round(coalesce(y, ya + (yb - ya) * (i - ia) / nullif(ib - ia, 0), ya, yb), 6) AS y FROM k""",
)(lambda df: as_day(rounded(E.preprocess_series(df, "ts", "y", "H", "first", ["kind"])[0]), "ts"))

#: Two raw series named alike, of texts: every 15 minutes and every two days, with repeated stamps, in the order of their events.
RAW_SERIES = """SELECT event_id AS n, CASE WHEN event_id % 2 = 0 THEN '001' ELSE '1' END AS series,
  CASE WHEN event_id % 2 = 0 THEN substr(CAST(CAST(ts AS TIMESTAMP) AS STRING), 1, 14) || lpad(CAST(CAST(floor(minute(ts) / 15) * 15 AS INT) AS STRING), 2, '0') || ':00'
    ELSE substr(CAST(CAST(ts AS TIMESTAMP) AS STRING), 1, 8) || lpad(CAST(day(ts) - (day(ts) - 1) % 2 AS STRING), 2, '0') || ' 00:00:00' END AS moment,
  'same' AS constant, ' ' || CAST(user_id AS STRING) || ' ' AS who, value AS y FROM {events}"""
_RAW_GRID = """, p AS (SELECT DISTINCT series, CAST(moment AS TIMESTAMP) AS ts, moment, who, y FROM base),
m AS (SELECT series, ts, avg(y) AS y, avg(CAST(trim(who) AS DOUBLE)) AS who, count(*) AS k FROM p GROUP BY series, ts),
e AS (SELECT series, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM m GROUP BY series),
g AS (SELECT series, unnest(generate_series(lo, hi, CASE WHEN series = '1' THEN INTERVAL 2 DAY ELSE INTERVAL 15 MINUTE END)) AS ts FROM e)"""
register(
    "preprocess_series_raw",
    RAW_SERIES,
    _RAW_GRID
    + f""", j AS (SELECT g.series, g.ts, y, who, row_number() OVER (PARTITION BY g.series ORDER BY g.ts) AS i FROM g LEFT JOIN m ON g.series = m.series AND g.ts = m.ts),
k AS (
  SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, last_value(y IGNORE NULLS) OVER b AS ya, last_value(who IGNORE NULLS) OVER b AS wa,
    first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ib, first_value(y IGNORE NULLS) OVER a AS yb, first_value(who IGNORE NULLS) OVER a AS wb
  FROM j WINDOW b AS (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING),
    a AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)
SELECT series, {stamp("ts")} AS moment, round(coalesce(who, wa + (wb - wa) * (i - ia) / nullif(ib - ia, 0)), 6) AS who, round(coalesce(y, ya + (yb - ya) * (i - ia) / nullif(ib - ia, 0)), 6) AS y FROM k""",
)(lambda df: as_day(rounded(E.preprocess_series(df, "moment", "y", None, "mean", ["series"], "n")[0]), "moment"))


def _series_report(df: DataFrame) -> DataFrame:
    """Steps by series, with the counts of what the job merged and of steps back in input order."""
    _, r = E.preprocess_series(df, "moment", "y", None, "mean", ["series"], "n")
    return r.steps.select("*", F.lit(r.merged_rows).alias("merged"), F.lit(r.unparsed_stamps).alias("unparsed"), F.lit(r.negative_steps).alias("negative_steps"))


register(
    "preprocess_series_report",
    RAW_SERIES,
    _RAW_GRID
    + """, b AS (SELECT *, lag(ts) OVER (PARTITION BY series ORDER BY n) AS before FROM (SELECT series, CAST(moment AS TIMESTAMP) AS ts, min(n) AS n FROM base GROUP BY series, moment, who, y))
SELECT e.series, CASE WHEN e.series = '1' THEN '2D' ELSE '900s' END AS frequency, n AS rows, points, CAST(0 AS BIGINT) AS off_grid, (SELECT CAST(sum(k - 1) AS BIGINT) FROM m) AS merged,
  CAST(0 AS BIGINT) AS unparsed, (SELECT count(*) FROM b WHERE ts < before) AS negative_steps
FROM e JOIN (SELECT series, count(*) AS points FROM g GROUP BY series) x ON e.series = x.series""",
)(_series_report)

_PATTERNS = [("month", "month(ts)"), ("weekday", "isodow(ts) - 1"), ("quarter", "quarter(ts)"), ("weekend", "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END"), ("year", "year(ts)"), ("hour", "hour(ts)")]
register("eda_series_patterns", DAILY, " UNION ALL ".join(f"SELECT '{n}' AS pattern, CAST({e} AS INTEGER) AS bucket, round(avg(y), 4) AS mean, count(y) AS n FROM base GROUP BY 2" for n, e in _PATTERNS))(
    lambda df: rounded(E.eda_series(df.select("ts", "y"), "ts", "y", "D", 5).reports["patterns"], 4)
)

# --- cleaning and profiles -----------------------------------------------------------------------
register("table_round_trip_csv", "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM {customer}", "SELECT * FROM base")(lambda df: _through_file(df, "csv"))
register("table_round_trip_parquet", "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total FROM {orders}", "SELECT * FROM base")(lambda df: _through_file(df, "parquet"))


def _through_file(df: DataFrame, kind: str) -> DataFrame:
    path = f"{fresh_path(df.sparkSession, 'table')}.{kind}"
    write_table(df, path, kind)
    return read_table(df.sparkSession, path, df.schema)


register(
    "drop_multicollinear",
    "SELECT l_quantity AS a, l_quantity + l_tax * 500 + l_discount * 20 AS b, l_tax * 500 AS c, l_extendedprice AS y FROM {lineitem}",
    "SELECT a, c, y FROM base",  # b is nearly a + c and has the largest inflation; without it the others have none
)(lambda df: A.drop_multicollinear(df, "y"))

register(
    "auto_preprocessor",
    LINES,
    """, d AS (SELECT DISTINCT qty, price, disc, flag FROM base),
f AS (SELECT avg(qty) AS q, avg(price) AS p, avg(disc) AS s FROM d),
g AS (SELECT flag FROM d WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1),
x AS (SELECT coalesce(qty, q) AS qty, coalesce(price, p) AS price, coalesce(disc, s) AS disc FROM d, f),
b AS (SELECT quantile_cont(qty, 0.25) AS q1, quantile_cont(qty, 0.75) AS q3, quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3, quantile_cont(disc, 0.25) AS s1, quantile_cont(disc, 0.75) AS s3 FROM x),
l AS (SELECT q1 - 1.5 * (q3 - q1) AS ql, q3 + 1.5 * (q3 - q1) AS qh, p1 - 1.5 * (p3 - p1) AS pl, p3 + 1.5 * (p3 - p1) AS ph, s1 - 1.5 * (s3 - s1) AS sl, s3 + 1.5 * (s3 - s1) AS sh FROM b),
c AS (SELECT least(greatest(qty, ql), qh) AS qty, least(greatest(price, pl), ph) AS price, least(greatest(disc, sl), sh) AS disc FROM x, l),
z AS (SELECT avg(qty) AS qm, stddev_pop(qty) AS qs, avg(price) AS pm, stddev_pop(price) AS ps, avg(disc) AS sm, stddev_pop(disc) AS ss FROM c),
codes AS (SELECT flag AS v, CAST(row_number() OVER (ORDER BY flag) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT coalesce(flag, (SELECT flag FROM g)) AS flag FROM d))
SELECT round((least(greatest(coalesce(qty, q), ql), qh) - qm) / qs, 6) AS qty, round((least(greatest(coalesce(price, p), pl), ph) - pm) / ps, 6) AS price,
  round((least(greatest(coalesce(disc, s), sl), sh) - sm) / ss, 6) AS disc, code AS flag
FROM base CROSS JOIN f CROSS JOIN l CROSS JOIN z JOIN codes ON codes.v = coalesce(base.flag, (SELECT flag FROM g))""",
)(lambda df: scaled_round(E.AutoPreprocessor().fit_transform(df.select("qty", "price", "disc", "flag")), 6))

register(
    "eda_unsupervised_variance",
    LINES,
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(var_samp({c}), 3) AS variance, round(count(*) / (count(*) - 1), 10) AS standardised, var_samp({c}) < 0.01 AS low FROM base""" for c in ("qty", "price", "disc")),
)(lambda df: E.eda_unsupervised(df.select("l_orderkey", "l_linenumber", "qty", "price", "disc", "flag"), ["l_orderkey", "l_linenumber"]).reports["variance"].select("column", F.round("variance", 3).alias("variance"), F.round("standardised", 10).alias("standardised"), "low"))

# --- models --------------------------------------------------------------------------------------
_SMALL = "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_extendedprice AS price, l_returnflag AS flag FROM {lineitem}"


def _board(df: DataFrame, task: str, key: str, inputs: list[str], target: str) -> DataFrame:
    train, test = T.random_split(df, [key])
    train, test = M.prepared(train, inputs, target).persist(), M.prepared(test, inputs, target).persist()
    make = M.regressors if task == "regression" else M.classifiers
    return M.train_and_rank(make(train), train, test, task).board


register("train_and_rank_regression", _SMALL)(lambda df: _board(df, "regression", "id", ["qty", "disc", "tax"], "price"))
register("train_and_rank_classification", DOCS)(lambda df: _board(df, "classification", "doc_id", ["n_chars", "toxic"], "quality"))
register("train_series", DAILY)(lambda df: E.train_series(df.select("ts", "y"), "ts", "y", models=["LinearRegression", "Ridge", "DecisionTree5"]).board)
register("train_tabular", _SMALL)(lambda df: E.train_tabular(df, "price", "regression", ["id"], ["LinearRegression", "Ridge", "DecisionTree5"]).board)

#: What each way of balancing leaves of every class of the training rows.
register(
    "eda_tabular_balance",
    "SELECT d.doc_id, d.n_chars, l.toxic, l.quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
    """, c AS (SELECT quality, count(*) - CAST(ceil(0.2 * count(*) - 1e-9) AS BIGINT) AS n FROM base GROUP BY quality),
w AS (SELECT unnest(['smote', 'oversample', 'undersample']) AS way)
SELECT way, quality, CASE WHEN way = 'undersample' THEN (SELECT min(n) FROM c) ELSE (SELECT max(n) FROM c) END AS n FROM c, w""",
)(lambda df: _balanced(df))


def _balanced(df: DataFrame) -> DataFrame:
    parts = []
    for way in ("smote", "oversample", "undersample"):
        found = E.eda_tabular(df, "quality", "classification", ["doc_id"], balance=way)
        parts.append(found.train.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).select(F.lit(found.balanced).alias("way"), F.col("quality").cast("int").alias("quality"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# the whole run's cleaned table is what the cleaning job's SQL gives; exploring and training have run on it
register("run_regression", queries._RAW)(lambda df: E.run(df, "regression", "price", models=["LinearRegression", "Ridge"]).clean)
queries._SQL["run_regression"] = queries._SQL["preprocess_tabular"]

# --- penalties on time folds: every grid value from one pass -------------------------------------
#: Daily totals in thousands, so that penalties of 0.1 to 100 tell.
_THOUSANDS = f"SELECT ts, y / 1000.0 AS y FROM ({DAILY})"


def _ridge_folds(df: DataFrame) -> DataFrame:
    rows = WA.time_series_folds(W.lag_features(df.select("ts", "y"), "ts", "y", (1, 7)).dropna(), "ts", 3)
    folds = M.prepared(rows, ["y_lag_1", "y_lag_7"], "y")
    tried = M.choices(M.LINEAR_GRIDS["Ridge"])
    grams = M.fold_grams(folds)
    best, rmse = M.tune_linear(grams, "Ridge")
    measured = M.measure_linear(folds, grams, [("Ridge", v) for v in tried])
    table = [(v["alpha"], r, m["CV_MAE"], m["CV_R2"], v == best) for v, r, m in zip(tried, rmse, measured, strict=True)]
    return rounded(df.sparkSession.createDataFrame(table, "alpha double, cv_rmse double, cv_mae double, cv_r2 double, best boolean"))


register(
    "tune_ridge",
    _THOUSANDS,
    """, r AS (SELECT y, lag(y, 1) OVER o AS a, lag(y, 7) OVER o AS b, row_number() OVER o AS i FROM base WINDOW o AS (ORDER BY ts)),
w AS (SELECT y, a, b, row_number() OVER (ORDER BY i) AS r, count(*) OVER () AS n FROM r WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
f AS (SELECT y, a, b, CASE WHEN r <= n - 3 * (n // 4) THEN 0 ELSE 1 + (r - 1 - (n - 3 * (n // 4))) // (n // 4) END AS fold FROM w),
m AS (
  SELECT k, avg(y) AS my, avg(a) AS ma, avg(b) AS mb,
    var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab,
    covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS cy
  FROM f JOIN (SELECT unnest([1, 2, 3]) AS k) ON fold < k GROUP BY k
),
p AS (SELECT m.*, alpha, (aa + alpha) * (bb + alpha) - ab * ab AS det FROM m, (SELECT CAST(unnest([0.1, 1.0, 10.0, 100.0]) AS DOUBLE) AS alpha)),
c AS (SELECT k, alpha, my, ma, mb, (ay * (bb + alpha) - cy * ab) / det AS wa, (cy * (aa + alpha) - ay * ab) / det AS wb FROM p),
e AS (
  SELECT alpha, k, sqrt(avg(pow(y - my - wa * (a - ma) - wb * (b - mb), 2))) AS rmse,
    avg(abs(y - my - wa * (a - ma) - wb * (b - mb))) AS mae,
    1 - avg(pow(y - my - wa * (a - ma) - wb * (b - mb), 2)) / var_pop(y) AS r2
  FROM f JOIN c ON fold = k GROUP BY 1, 2
),
s AS (SELECT alpha, avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2 FROM e GROUP BY 1)
SELECT alpha, round(rmse, 6) AS cv_rmse, round(mae, 6) AS cv_mae, round(r2, 6) AS cv_r2, row_number() OVER (ORDER BY rmse, alpha) = 1 AS best FROM s""",
)(_ridge_folds)

# --- clustering: the whole embedding -------------------------------------------------------------
_DIMS = 64
_COLUMNS = [f"e{i}" for i in range(_DIMS)]
_EMBEDDED = "SELECT vec_id AS id, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(_DIMS)) + ", label FROM {embeddings}"
#: One row a vector and component, for SQL.
_LONG = "x AS (SELECT vec_id AS id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_Z = "z AS (SELECT id, x.i, (v - m) / s AS v FROM x JOIN (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY i) t ON x.i = t.i)"


def _with_sql(name: str, sql: str, f) -> None:
    register(name, _EMBEDDED)(f)
    queries._SQL[name] = sql


def _scores(df: DataFrame) -> DataFrame:
    s = U.scatter_scores(df, _COLUMNS, "label")
    return df.sparkSession.createDataFrame([(round(s["calinski_harabasz"], 6), round(s["davies_bouldin"], 6))], "calinski_harabasz double, davies_bouldin double")


_with_sql(
    "cluster_scores",
    f"""WITH {_LONG},
c AS (SELECT label AS c, i, avg(v) AS m FROM x GROUP BY 1, 2),
k AS (SELECT label AS c, count(*) AS n FROM embeddings GROUP BY 1),
d AS (SELECT id, c, sum((v - m) ** 2) AS d2 FROM x JOIN c ON label = c AND x.i = c.i GROUP BY 1, 2),
s AS (SELECT c, sum(d2) AS ss, avg(sqrt(d2)) AS s FROM d GROUP BY 1),
g AS (SELECT i, avg(v) AS m FROM x GROUP BY 1),
b AS (SELECT sum(n * (c.m - g.m) ** 2) AS ss FROM c JOIN k ON c.c = k.c JOIN g ON c.i = g.i),
p AS (SELECT a.c, b.c AS other, sqrt(sum((a.m - b.m) ** 2)) AS apart FROM c a JOIN c b ON a.i = b.i AND a.c <> b.c GROUP BY 1, 2),
r AS (SELECT p.c, max((sa.s + sb.s) / apart) AS x FROM p JOIN s sa ON sa.c = p.c JOIN s sb ON sb.c = p.other GROUP BY 1)
SELECT round((SELECT ss FROM b) / ((SELECT count(*) FROM k) - 1) / ((SELECT sum(ss) FROM s) / ((SELECT sum(n) FROM k) - (SELECT count(*) FROM k))), 6) AS calinski_harabasz,
  round((SELECT avg(x) FROM r), 6) AS davies_bouldin""",
    _scores,
)
_with_sql(
    "silhouette_rows",
    """WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
k AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS s FROM e a JOIN e b ON a.id <> b.id GROUP BY 1, 2, 3),
m AS (
  SELECT id, d.label AS cluster, max(CASE WHEN other = d.label THEN s / (n - 1) END) AS a, min(CASE WHEN other <> d.label THEN s / n END) AS b
  FROM d JOIN k ON k.label = other GROUP BY 1, 2
)
SELECT id, CAST(cluster AS BIGINT) AS cluster, round(a, 6) AS "inner", round(b, 6) AS "outer",
  round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) AS silhouette FROM m""",
    lambda df: rounded(U.silhouette_rows(df.select("id", F.array(*_COLUMNS).alias("v"), F.col("label").alias("cluster")))),
)
_with_sql("prepare_matrix", f"WITH {_LONG}, {_Z} SELECT id, CAST(i AS INTEGER) AS component, round(v, 6) AS value FROM z", lambda df: _unpacked(U.prepare_matrix(df, _COLUMNS)[0]))
_with_sql(
    "pca_moments",  # the sum of all variances and of their squares, which need no eigenvalue
    f"""WITH {_LONG}, {_Z}, n AS (SELECT count(*) AS n FROM embeddings),
g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / (SELECT n - 1 FROM n) AS r FROM z a JOIN z b ON a.id = b.id GROUP BY 1, 2)
SELECT round(sum(CASE WHEN i = j THEN r END), 5) AS total, round(sum(r * r), 5) AS squares FROM g""",
    lambda df: U.pca_report(df, _COLUMNS, _DIMS).agg(F.round(F.sum("variance"), 5).alias("total"), F.round(F.sum(F.col("variance") * F.col("variance")), 5).alias("squares")),
)


def _feature_moments(features: DataFrame) -> DataFrame:
    long = features.select("n", "ss", F.posexplode("mean").alias("component", "m"))
    inner = F.sum(F.when(F.col("component") == 0, F.col("ss")))
    means = long.groupBy("component").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), inner.alias("ss")
    )
    squares = F.coalesce("ss", F.lit(0.0)) + F.col("q") - F.col("n") * F.col("mean") * F.col("mean")
    return means.agg(F.max("n").alias("n"), F.round(F.sum(F.col("mean") * (F.col("component") + 1)), 6).alias("weighted_means"), F.round(F.sum(squares), 5).alias("squares"))


def _unpacked(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode(F.array(*_COLUMNS)).alias("component", "value")).select("id", "component", F.round("value", 6).alias("value"))


register("kmeans_sweep", _EMBEDDED)(lambda df: U.kmeans_sweep(U.prepare_matrix(df, _COLUMNS)[0], _COLUMNS)[0])
register("kmeans_sizes", _EMBEDDED)(lambda df: U.kmeans_fit(U.prepare_matrix(df, _COLUMNS)[0], 3)[1])
_with_sql("kmeans_rows", "SELECT count(*) AS n FROM embeddings", lambda df: U.kmeans_fit(U.prepare_matrix(df, _COLUMNS)[0], 3)[1].agg(F.sum("n").alias("n")))
register("dbscan", _EMBEDDED)(lambda df: U.dbscan(df.select("id", F.array(*_COLUMNS).alias("v"))))
_with_sql(
    "clustering_features",  # features of far fewer leaves than points still hold all counts, means and squares
    f"""WITH {_LONG}, m AS (SELECT i, count(*) AS n, avg(v) AS m, sum((v - a) ** 2) AS s FROM x JOIN (SELECT i AS j, avg(v) AS a FROM x GROUP BY 1) t ON i = j GROUP BY 1)
SELECT max(n) AS n, round(sum(m * (i + 1)), 6) AS weighted_means, round(sum(s), 5) AS squares FROM m""",
    lambda df: _feature_moments(clustering_features(df.select(F.array(*_COLUMNS).alias("v")), 64)),
)
register("hierarchical_sizes", _EMBEDDED)(lambda df: U.cluster_sizes(U.hierarchical(U.prepare_matrix(df, _COLUMNS)[0], 4), "prediction"))
register("pca_report", _EMBEDDED)(lambda df: U.pca_report(df, _COLUMNS))
register("pca_project", _EMBEDDED)(lambda df: U.pca_project(df, _COLUMNS).select("id", "pc1", "pc2"))
register("cluster_job", _EMBEDDED)(lambda df: E.cluster(df.select(*_COLUMNS), _COLUMNS).comparison)
