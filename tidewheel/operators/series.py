"""Time series: order, duplicate stamps, steps, gaps, filling and window features.

Every operator takes ``keys`` (may be empty), and none has a window over a whole series: features that look back a
bounded number of rows are made by ``chunked``, which cuts each key's series into chunks of rows with the rows before that the
windows need; steps between neighbours, carried values and positions come through ``functions.ranges``, which hands
summaries from range to range. A key that holds most rows is in many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.graph import materialise
from ..functions.ranges import edged, micros, positions, ranged, sums_before
from ..plans.workers import ship
from .calendars import fixed_steps, grid, join_by_key, on_grid, steps_between
from .columns import column_groups, one_row, q
from .nulls import drop_all_null_rows, drop_high_null_columns

#: Seconds of the regular steps.
STEPS = {"H": 3600, "D": 86400, "W": 604800}


def frame(keys: list[str], order: str | Column) -> Window:
    return Window.partitionBy(*[q(k) for k in keys]).orderBy(q(order) if isinstance(order, str) else order)


def distributed_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with its 1-based position in ``order``: row numbers within ranges of the first column, and offsets from the ranges' counts."""
    rows = ranged(df, order[0])
    local = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*[q(c) for c in order])))
    before = sums_before(rows.groupBy("__b").agg(F.count(F.lit(1)).alias("n")), ["n"])
    out = local.join(F.broadcast(before), F.col("__b") == F.col("__q"))  # a row a range
    return out.withColumn(name, (F.col("__r") + F.col("__before_n")).cast("long")).drop("__r", "__b", "__q", "__before_n")


def running_sums(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """``df`` with sum_c, the sum of c over all rows up to this one in ``order`` (unique), for each of ``cols``; range by range."""
    rows = ranged(df, order)
    w = Window.partitionBy("__b").orderBy(q(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = sums_before(rows.groupBy("__b").agg(*[F.sum(q(c)).alias(c) for c in cols]), cols)
    out = rows.withColumns({f"__s_{c}": F.sum(q(c)).over(w) for c in cols}).join(F.broadcast(before), F.col("__b") == F.col("__q"))  # a row a range
    return out.select(*[q(c) for c in df.columns], *[(F.col(f"__s_{c}") + F.col(f"__before_{c}")).alias(f"sum_{c}") for c in cols])


#: Rows of a chunk of a long series.
CHUNK_ROWS = 1_000_000


def chunked(df: DataFrame, order: str, halo: int, features, chunk_rows: int | None = None, keys: list[str] = (), ahead: int = 0, rank: str | None = None) -> DataFrame:
    """``features(df, keys)`` of long series, chunk by chunk.

    Chunk c of a key holds its ranks from c * chunk_rows on and, as a halo, the last ``halo`` rows before them and the first
    ``ahead`` rows after them, whose results are dropped. Equal to the plain window when it looks no further.
    rank: a column that has the rows' positions already.
    """
    chunk_rows = chunk_rows or CHUNK_ROWS
    if max(halo, ahead) > chunk_rows:
        raise ValueError(f"windows of {max(halo, ahead)} rows need chunks of as many rows at least, not {chunk_rows}")
    ranked = df.withColumn("__rank", q(rank)) if rank else positions(df, list(keys), [order], "__rank")
    ranked = ranked.withColumn("__c", F.floor((F.col("__rank") - 1) / chunk_rows))
    at = (F.col("__rank") - 1) % chunk_rows
    near = [F.when(at >= chunk_rows - halo, F.col("__c") + 1), F.when(at < ahead, F.col("__c") - 1)]
    spread = ranked.withColumn("__chunk", F.explode(F.array_compact(F.array(F.col("__c"), *near))))
    done = features(spread, [*keys, "__chunk"])
    return done.filter("__chunk = __c").drop("__chunk", "__c", "__rank")


def check_monotonic(df: DataFrame, ts: str, order_col: str, keys: list[str] = ()) -> DataFrame:
    """One row: steps back in input order, and rows whose stamp another row has."""
    e = edged(df, keys, [order_col], {"__t": ("last", F.struct(q(ts).alias("t")))})
    steps = e.done(e.rows.withColumn("__before", F.lag("__t").over(e.rowwise))).agg(F.count_if(F.col("__t.t") < F.col("__before.t")).alias("negative_steps"))
    same = df.groupBy(*[q(k) for k in keys], q(ts).alias("t")).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("duplicated_rows"))
    return steps.crossJoin(same).withColumn("monotonic", F.col("negative_steps") == 0)  # one row each


def sort_series(df: DataFrame, ts: str, keys: list[str] = ()) -> DataFrame:
    order = [q(k) for k in keys] + [q(ts)]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def duplicate_timestamps(df: DataFrame, ts: str, keys: list[str] = ()) -> DataFrame:
    """All rows of a repeated stamp; the stamps are found by a pre-aggregated count."""
    on = [*keys, ts]
    hot = df.groupBy(*[q(c) for c in on]).agg(F.count(F.lit(1)).alias("__k")).filter("__k > 1").drop("__k")
    return df.join(hot, on, "left_semi")


def resolve_duplicate_timestamps(df: DataFrame, ts: str, how: str = "first", order_col: str | None = None, keys: list[str] = ()) -> DataFrame:
    """One row for each stamp: first or last by ``order_col`` (without one, the least or greatest row), or mean or sum of numbers with the first non-null of the rest."""
    by = [*keys, ts]
    rest = [c for c in df.columns if c not in by]
    row = F.struct(*[q(c) for c in rest])
    # rows of equal order are told apart by their values, so every run picks the same one
    place = F.struct(q(order_col), row) if order_col else row
    if how in ("first", "last"):
        pick = (F.min_by if how == "first" else F.max_by)(row, place)
        return df.groupBy(*[q(c) for c in by]).agg(pick.alias("__s")).select(*[q(c) if c in by else F.col(f"__s.`{c}`").alias(c) for c in df.columns])
    numbers = set(column_groups(df).numeric)
    total = F.avg if how == "mean" else F.sum
    agg = [(total(q(c)) if c in numbers else F.min_by(q(c), F.when(q(c).isNotNull(), place))).alias(c) for c in rest]
    return df.groupBy(*[q(c) for c in by]).agg(*agg).select(*[q(c) for c in df.columns])


def infer_frequency(df: DataFrame, ts: str, keys: list[str] = ()) -> DataFrame:
    """(keys, frequency, step_seconds): the common step if all are equal, else by the median step H, D, W, MS or YS."""
    g = steps_between(df, ts, keys).select(*[q(k) for k in keys], (F.col("step") / 1_000_000.0).alias("step")).groupBy(*[q(k) for k in keys]).agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.percentile("step", F.lit(0.5)).alias("mid"))
    m = F.col("mid")
    by_median = F.when(m <= 3600, "H").when(m <= 86400, "D").when(m <= 7 * 86400, "W").when(m <= 31 * 86400, "MS").otherwise("YS")
    return g.select(*[q(k) for k in keys], F.when(F.col("lo") == F.col("hi"), F.concat(F.col("lo").cast("long").cast("string"), F.lit("s"))).otherwise(by_median).alias("frequency"), m.alias("step_seconds"))


def calendar(df: DataFrame, ts: str, freq: str | DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, ts): the regular grid from first to last stamp. ``freq`` names one step for all keys, or is a table of steps by key."""
    return grid(fixed_steps(df, ts, freq, keys) if isinstance(freq, str) else freq, ts, keys)


def calendar_left_join(df: DataFrame, ts: str, freq: str | DataFrame, keys: list[str] = ()) -> DataFrame:
    """The grid with the data on it; rows off the grid fall away (``calendars.grid_report`` counts them)."""
    return on_grid(df, ts, calendar(df, ts, freq, keys), keys)


def missing_timestamps(df: DataFrame, ts: str, freq: str | DataFrame, keys: list[str] = ()) -> DataFrame:
    return on_grid(calendar(df, ts, freq, keys), ts, df.select(*[q(k) for k in keys], q(ts).cast("timestamp").alias(ts)), keys, "anti")


def find_gaps(df: DataFrame, ts: str, freq: str = "D", keys: list[str] = ()) -> DataFrame:
    """(keys, gap_start, gap_end, missing): runs of missing stamps, from neighbouring stamps alone, without the grid."""
    step = STEPS[freq] * 1_000_000
    stamps = df.select(*[q(k) for k in keys], micros(q(ts)).alias("t")).distinct()
    e = edged(stamps, keys, ["t"], {"__t": ("first", F.col("t"))})
    after = e.done(e.rows.withColumn("n", F.lead("__t").over(e.rowwise)))
    k = F.ceil((F.col("n") - F.col("t")) / F.lit(step)).cast("long") - 1
    return after.withColumn("missing", k).filter("missing > 0").select(*[q(c) for c in keys], F.timestamp_micros(F.col("t") + step).alias("gap_start"), F.timestamp_micros(F.col("t") + F.col("missing") * step).alias("gap_end"), "missing")


def fill_columns(df: DataFrame, ts: str, plan: dict[str, str], keys: list[str] = (), edges: bool = True) -> DataFrame:
    """Nulls filled along each key, all columns of ``plan`` in one pass: column -> ``line``, ``ffill`` or ``bfill``.

    line: on the line between the neighbours by row position; ends take the nearest value (edges). ffill and bfill: the value
    before, or after; where there is none, the one on the other side.
    """
    if not plan:
        return df
    at = {c: n for n, c in enumerate(plan)}
    value = {c: q(c).cast("double") if how == "line" else q(c) for c, how in plan.items()}
    carry = {f"__p{at[c]}": ("last_at", v) for c, v in value.items()} | {f"__n{at[c]}": ("first_at", v) for c, v in value.items()}
    e = edged(df, keys, [ts], carry, numbered=True)
    out = e.rows.withColumns({f"__p{n}": e.last(f"__p{n}") for n in at.values()} | {f"__n{n}": e.first(f"__n{n}") for n in at.values()})

    def filled(c: str) -> Column:
        a, b = F.col(f"__p{at[c]}"), F.col(f"__n{at[c]}")
        if plan[c] != "line":
            return F.coalesce(q(c), *[a["v"], b["v"]][:: 1 if plan[c] == "ffill" else -1])
        line = a["v"] + (b["v"] - a["v"]) * (F.col("__i") - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0))
        got = F.coalesce(value[c], line)
        return F.coalesce(got, a["v"], b["v"]) if edges else got

    done = out.filter("__role = 0")
    return done.select(*[filled(c).alias(c) if c in at else q(c) for c in df.columns])


def carry_values(df: DataFrame, ts: str, cols: list[str], how: str = "ffill", keys: list[str] = ()) -> DataFrame:
    """Nulls of ``cols`` filled with the value before (ffill) or after (bfill) in the key, where there is none with the one on the other side."""
    return fill_columns(df, ts, dict.fromkeys(cols, how), keys)


def interpolate_linear(df: DataFrame, ts: str, cols: list[str], keys: list[str] = (), edges: bool = True) -> DataFrame:
    """Nulls of ``cols`` on the line between their neighbours by row position; ends take the nearest value (edges)."""
    return fill_columns(df, ts, dict.fromkeys(cols, "line"), keys, edges)


def fill_gaps(df: DataFrame, ts: str, freq: str | DataFrame, how: str = "interpolate", keys: list[str] = ()) -> DataFrame:
    """The data on the regular grid, numbers filled by ``how`` (interpolate, ffill, bfill, zero, mean), the rest forward then back."""
    keys = list(keys)
    done = materialise(calendar_left_join(df, ts, freq, keys), "grid")
    numbers = [c for c in column_groups(df).numeric if c not in keys]
    others = [c for c in df.columns if c not in [*numbers, *keys, ts]]
    plan = dict.fromkeys(others, "ffill")
    if how == "interpolate":
        plan |= dict.fromkeys(numbers, "line")
    elif how in ("ffill", "bfill"):
        plan |= dict.fromkeys(numbers, how)
    elif how == "zero":
        done = done.fillna(0, numbers)
    else:
        means = done.groupBy(*[q(k) for k in keys]).agg(*[F.avg(q(c)).alias(f"__m{n}") for n, c in enumerate(numbers)])
        done = join_by_key(done, means, keys).withColumns({c: F.coalesce(q(c).cast("double"), F.col(f"__m{n}")) for n, c in enumerate(numbers)}).select(*[q(c) for c in df.columns])
    return fill_columns(done, ts, plan, keys)


def null_blocks(df: DataFrame, ts: str, cols: list[str], min_block: int = 3, keys: list[str] = ()) -> DataFrame:
    """(keys, column, block_start, block_end, size): runs of at least ``min_block`` nulls by column."""
    keys = list(keys)
    # a run of nulls is named by the position of the last value before it, so its rows of several ranges come together
    e = edged(df.select(*[q(c) for c in dict.fromkeys([*keys, ts, *cols])]), keys, [ts], {f"__a{n}": ("last_at", F.when(q(c).isNotNull(), 1)) for n, c in enumerate(cols)}, numbered=True)
    cells = [F.when(q(c).isNull(), F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"__a{n}")["i"], F.lit(0)).alias("run"))) for n, c in enumerate(cols)]
    empty = e.done(e.rows.withColumns({f"__a{n}": e.last(f"__a{n}") for n in range(len(cols))})).select(*[q(k) for k in keys], q(ts).alias("t"), F.explode(F.array_compact(F.array(*cells))).alias("p"))
    runs = empty.select(*[q(k) for k in keys], "t", "p.*").groupBy(*[q(k) for k in keys], "column", "run")
    return runs.agg(F.min("t").alias("block_start"), F.max("t").alias("block_end"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_block).drop("run")


def fill_series_nulls(df: DataFrame, ts: str, how: str = "auto", keys: list[str] = ()) -> DataFrame:
    """Without all-null rows; then auto, interpolate, ffill, bfill, drop_rows or drop_cols."""
    keys = list(keys)
    data = [c for c in df.columns if c not in [*keys, ts]]
    df = drop_all_null_rows(df, data)
    if how in ("auto", "drop_cols"):
        df = drop_high_null_columns(df, 0.5, inclusive=False, keep=[*keys, ts])
        data = [c for c in df.columns if c not in [*keys, ts]]
    if how == "drop_cols":
        return df
    if how == "drop_rows":
        return df.dropna("any", subset=data)
    numbers = [c for c in column_groups(df).numeric if c in data]
    others = [c for c in data if c not in numbers]
    if how in ("auto", "interpolate"):
        return fill_columns(df, ts, dict.fromkeys(numbers, "line") | dict.fromkeys(others, "ffill"), keys)
    return carry_values(df, ts, data, how, keys)


@dataclass(frozen=True)
class FeaturePlan:
    """Windows of the engineered features."""

    lags: tuple[int, ...] = (1, 2, 3, 7, 14, 30)
    rolling: tuple[int, ...] = (7, 14, 30)
    differences: tuple[int, ...] = (1, 7, 30)
    spans: tuple[int, ...] = (7, 14, 30)


def lag_features(df: DataFrame, ts: str, target: str, lags=(1, 2, 3, 7, 14, 30), keys: list[str] = ()) -> DataFrame:
    if "__chunk" not in keys:
        return chunked(df, ts, max([*lags, 1]), lambda d, by: lag_features(d, ts, target, lags, by), keys=keys)
    w = frame(list(keys), ts)
    return df.withColumns({f"{target}_lag_{k}": F.lag(q(target), k).over(w) for k in lags})


def rolling_features(df: DataFrame, ts: str, target: str, windows=(7, 14, 30), keys: list[str] = ()) -> DataFrame:
    """Mean, std (n-1), min and max over full windows without nulls, else null."""
    if "__chunk" not in keys:
        return chunked(df, ts, max([*windows, 1]), lambda d, by: rolling_features(d, ts, target, windows, by), keys=keys)
    w = frame(list(keys), ts)
    new: dict[str, Column] = {}
    for k in windows:
        over = w.rowsBetween(-(k - 1), 0)
        full = F.count(q(target)).over(over) == k
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            new[f"{target}_rolling_{name}_{k}"] = F.when(full, f(q(target)).over(over))
    return df.withColumns(new)


def rolling_bands(df: DataFrame, ts: str, target: str, windows=(7, 30), keys: list[str] = ()) -> DataFrame:
    """Rolling mean and the band of one std on both sides."""
    if "__chunk" not in keys:
        return chunked(df, ts, max([*windows, 1]), lambda d, by: rolling_bands(d, ts, target, windows, by), keys=keys)
    w = frame(list(keys), ts)
    new: dict[str, Column] = {}
    for k in windows:
        over = w.rowsBetween(-(k - 1), 0)
        full = F.count(q(target)).over(over) == k
        mean, std = F.avg(q(target)).over(over), F.stddev_samp(q(target)).over(over)
        new |= {f"mean_{k}": F.when(full, mean), f"upper_{k}": F.when(full, mean + std), f"lower_{k}": F.when(full, mean - std)}
    return df.withColumns(new)


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    t = q(ts)
    day = F.to_date(t)
    quarter = F.to_date(F.date_trunc("quarter", t))
    return df.withColumns(
        {
            "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t), "dayofyear": F.dayofyear(t), "quarter": F.quarter(t), "week": F.weekofyear(t),
            "is_weekend": (F.weekday(t) >= 5).cast("int"), "is_month_start": (F.dayofmonth(t) == 1).cast("int"), "is_month_end": (day == F.last_day(t)).cast("int"),
            "is_quarter_start": (day == quarter).cast("int"), "is_quarter_end": (day == F.date_sub(F.add_months(quarter, 3), 1)).cast("int"),
        }
    )


def difference_features(df: DataFrame, ts: str, target: str, lags=(1, 7, 30), keys: list[str] = ()) -> DataFrame:
    if "__chunk" not in keys:
        return chunked(df, ts, max([*lags, 1]), lambda d, by: difference_features(d, ts, target, lags, by), keys=keys)
    w = frame(list(keys), ts)
    new: dict[str, Column] = {}
    for k in lags:
        before = F.lag(q(target), k).over(w)
        new |= {f"{target}_diff_{k}": q(target) - before, f"{target}_pct_change_{k}": F.try_divide(q(target), before) - 1}
    return df.withColumns(new)


#: Sums that the exponential features need: of weights, of their squares, and of weighted values and squares.
_SUMS = 4


def _decayed(state: np.ndarray, terms: np.ndarray, keep: float) -> np.ndarray:
    """s_i = keep * s_(i-1) + term_i for every row, from the state before the first."""
    a = 1.0 - keep
    return pd.Series(np.concatenate([[a * state], terms])).ewm(alpha=a, adjust=False).mean().to_numpy()[1:] / a


def _ewm_sums(x: np.ndarray, keep: float, state: np.ndarray) -> np.ndarray:
    """The four sums at every row of a chunk, given those before it; a null adds nothing but ages the weights."""
    have = ~np.isnan(x)
    v = np.where(have, x, 0.0)
    terms = [have.astype(float), have.astype(float), v, v * v]
    return np.stack([_decayed(state[k], terms[k], keep**2 if k == 1 else keep) for k in range(_SUMS)])


def ewm_features(df: DataFrame, ts: str, target: str, spans=(7, 14, 30), keys: list[str] = (), rank: str | None = None) -> DataFrame:
    """Adjusted exponentially weighted mean and bias-corrected std by series.

    With b = 1 - alpha the weight of row j at row i is b**(i-j), so the sums of w, w*w, w*x and w*x*x follow s_i = b * s_(i-1)
    + term_i. The sums of a chunk and its number of rows are all that later chunks need: first every chunk gives its
    own, then these few rows are folded along each key, then every chunk starts from the sums before it. So a series is
    in many tasks and no row sees less than all rows before it. rank: a column that has the rows' positions already.
    """
    ship(df.sparkSession)
    keys = list(keys)
    names = [f"{target}_ewm_{n}_{s}" for s in spans for n in ("mean", "std")]
    decay = [1.0 - 2.0 / (s + 1.0) for s in spans]
    centre = one_row(df, {"m": F.avg(q(target))})["m"] or 0.0  # the std does not move with the level, and its sums stay well scaled
    ranked = df.withColumn("__rank", q(rank)) if rank else materialise(positions(df, keys, [ts], "__rank"), "ranked")  # read three times
    ranked = ranked.withColumn("__c", F.floor((F.col("__rank") - 1) / CHUNK_ROWS))
    by = [*keys, "__c"]

    def values(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[target].to_numpy(dtype="float64", na_value=np.nan) - centre

    def chunk_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        x = values(pdf.sort_values("__rank"))
        last = [_ewm_sums(x, b, np.zeros(_SUMS))[:, -1] for b in decay]
        return pd.DataFrame([[*pdf.iloc[0][by], len(x), np.concatenate(last).tolist() if last else []]], columns=[*by, "__n", "__state"])

    small = ranked.select(*[q(k) for k in by], "__rank", q(target).cast("double").alias(target))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.select(*[q(k) for k in by]).schema)
    sums = small.groupBy(*[q(k) for k in by]).applyInPandas(chunk_sums, f"{kinds}, __n long, __state array<double>")

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__c")
        state, before = np.zeros(_SUMS * len(decay)), []
        for n, own in zip(pdf["__n"], pdf["__state"], strict=True):
            before.append(state.tolist())
            fade = np.concatenate([[b**n, b ** (2 * n), b**n, b**n] for b in decay])
            state = state * fade + np.asarray(own)
        return pdf.assign(__state=before)[[*by, "__state"]]

    # a row a chunk: what one key's task folds is its number of chunks
    starts = sums.groupBy(*[q(k) for k in keys]).applyInPandas(folded, f"{kinds}, __state array<double>")
    wide = ranked.withColumns({"__state": F.lit(None).cast("array<double>"), "__role": F.lit(0)})
    marked = wide.unionByName(starts.withColumn("__role", F.lit(-1)), allowMissingColumns=True)
    schema = df.select("*", *[F.lit(0.0).cast("double").alias(n) for n in names]).schema
    for f in schema:
        f.nullable = True

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edge = pdf["__role"] == -1
        state = np.asarray(pdf.loc[edge, "__state"].iloc[0])
        pdf = pdf[~edge].sort_values("__rank")
        x = values(pdf)
        for k, b in enumerate(decay):
            w, ww, wx, wxx = _ewm_sums(x, b, state[k * _SUMS : (k + 1) * _SUMS])
            with np.errstate(all="ignore"):
                seen = w > 0
                mean = np.where(seen, wx / w, np.nan)
                free = w * w - ww
                variance = np.where(seen & (free > 1e-12 * w * w), np.maximum(wxx / w - mean**2, 0) * w * w / free, np.nan)
            pdf[names[2 * k]], pdf[names[2 * k + 1]] = mean + centre, np.sqrt(variance)
        return pdf[[f.name for f in schema]]

    return marked.groupBy(*[q(k) for k in by]).applyInPandas(run, schema)


def engineer_features(df: DataFrame, ts: str, target: str, plan: FeaturePlan = FeaturePlan(), keys: list[str] = ()) -> DataFrame:
    """Lags, rolling, calendar, difference and exponential features of complete rows. Rows are ranked once for all of them."""

    def windows(d: DataFrame, by: list[str]) -> DataFrame:
        d = lag_features(d, ts, target, plan.lags, by)
        return difference_features(rolling_features(d, ts, target, plan.rolling, by), ts, target, plan.differences, by)

    ranked = materialise(positions(df, list(keys), [ts], "__position"), "ranked")
    rows = ewm_features(ranked, ts, target, plan.spans, keys, "__position") if plan.spans else ranked
    faded = rows.columns[len(ranked.columns) :]
    out = chunked(rows, ts, max([*plan.lags, *plan.rolling, *plan.differences, 1]), windows, keys=keys, rank="__position").drop("__position")
    out = calendar_features(out, ts)
    return out.select(*[q(c) for c in out.columns if c not in faded], *[q(c) for c in faded]).dropna("any")


def parse_dates(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, S.to_date(q(ts)))
