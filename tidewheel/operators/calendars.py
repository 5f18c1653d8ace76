"""Steps of series and the regular grids that they span; every key may have a step of its own.

A step is a row (keys, unit, every, anchor, hi, frequency): ``every`` microseconds, days, months, month ends or business
days from the first grid point ``anchor`` up to ``hi``. Days and months follow the session's calendar, microseconds do not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import edged, micros, q

DAY = 86_400_000_000
#: Grid points that one row is spread to at once.
GRID_ROWS = 100_000
#: Unit and number of what a frequency's name says.
UNITS = {"us": ("micros", 1), "ms": ("micros", 1000), "s": ("micros", 1_000_000), "min": ("micros", 60_000_000), "H": ("micros", 3_600_000_000), "D": ("days", 1), "W": ("days", 7), "B": ("business", 1), "MS": ("months", 1), "ME": ("month_end", 1), "YS": ("months", 12)}


def step_of(freq: str) -> tuple[str, int]:
    """(unit, number) of a frequency such as ``15min``, ``2D``, ``B`` or ``MS``."""
    found = re.fullmatch(r"(\d*)([A-Za-z]+)", freq)
    if not found or found[2] not in UNITS:
        raise ValueError(f"unknown frequency {freq!r}")
    unit, n = UNITS[found[2]]
    if unit == "business" and found[1] not in ("", "1"):
        raise ValueError("business days come one by one")
    return unit, n * int(found[1] or 1)


def steps_between(df: DataFrame, ts: str, keys: list[str] = ()) -> DataFrame:
    """(keys, t, step): every row's stamp, and the microseconds since the one before it in its key, null for the first; null stamps left out."""
    stamps = df.filter(q(ts).isNotNull()).select(*[q(k) for k in keys], q(ts).cast("timestamp").alias("t"))
    e = edged(stamps, keys, ["t"], {"__t": ("last", F.col("t"))})
    before = F.lag("__t").over(e.rowwise)
    return e.done(e.rows.withColumn("step", micros(F.col("t")) - micros(before))).drop("__t")


def _same(names: list[str]) -> Column:
    """Each column equal to the one that is named ``__k_`` before it; null equals null."""
    on = F.lit(True)
    for k in names:
        on = on & q(k).eqNullSafe(q(f"__k_{k}"))
    return on


def join_by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys that may be null; without keys ``right`` has one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    return left.join(named, _same(keys), how).drop(*[f"__k_{k}" for k in keys])


def _ends(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    t = q(ts).cast("timestamp")
    return df.groupBy(*[q(k) for k in keys]).agg(F.min(t).alias("anchor"), F.max(t).alias("hi")).filter("anchor is not null")


def fixed_steps(df: DataFrame, ts: str, freq: str, keys: list[str] = ()) -> DataFrame:
    """The step ``freq`` for all keys; months and years start on their first day."""
    unit, every = step_of(freq)
    start = {"months": F.date_trunc("year" if every % 12 == 0 else "month", "anchor")}.get(unit, F.col("anchor"))
    ends = _ends(df, ts, list(keys)).withColumn("anchor", start)
    return ends.select(*[q(k) for k in keys], F.lit(unit).alias("unit"), F.lit(every).cast("long").alias("every"), "anchor", "hi", F.lit(freq).alias("frequency"))


def infer_steps(df: DataFrame, ts: str, keys: list[str] = ()) -> DataFrame:
    """Every key's step, from its distinct stamps.

    Month starts (or one day of the month up to the 28th), month ends and business days, if all stamps keep to them; else the
    commonest difference, if all are its multiples (missing stamps leave multiples); else, by the median difference, an hour,
    a day, a week, a month or a year, and stamps may lie off the grid (``off_grid`` counts them). One stamp alone has a
    step of a day.
    """
    keys = list(keys)
    by = [q(k) for k in keys]
    stamps = df.filter(q(ts).isNotNull()).select(*by, q(ts).cast("timestamp").alias(ts)).distinct()
    t = F.col("t")
    at_day = micros(t) - micros(F.date_trunc("day", t))
    month = F.year(t) * 12 + F.month(t)
    before = F.timestamp_micros(micros(t) - F.col("step"))
    rows = steps_between(stamps, ts, keys).withColumns({"months": month - (F.year(before) * 12 + F.month(before)), "at_day": at_day})
    business = (F.col("step") == DAY) | (F.col("step") == 3 * DAY) & (F.weekday(t) == 0)
    whole = rows.groupBy(*by).agg(
        F.min(t).alias("anchor"), F.max(t).alias("hi"), F.count(F.lit(1)).alias("stamps"), (F.min("at_day") == F.max("at_day")).alias("same_time"),
        ((F.min(F.dayofmonth(t)) == F.max(F.dayofmonth(t))) & (F.max(F.dayofmonth(t)) <= 28)).alias("same_day"), F.bool_and(F.to_date(t) == F.last_day(t)).alias("at_end"),
        (F.bool_and(F.coalesce(business, F.lit(True))) & (F.max(F.weekday(t)) < 5) & (F.max("step") == 3 * DAY)).alias("business"), F.min("months").alias("least_months"),
    )
    counted = rows.filter("step is not null").groupBy(*by, "step", "months").agg(F.count(F.lit(1)).alias("k"))
    commonest = lambda c: counted.groupBy(*by, c).agg(F.sum("k").alias("k")).groupBy(*by).agg(F.min(F.struct((-F.col("k")).alias("k"), F.col(c).alias("v"))).alias("m")).select(*by, F.col("m.v").alias(f"base_{c}"))
    told = join_by_key(join_by_key(counted, commonest("step"), keys), commonest("months"), keys)
    multiple = lambda c: F.bool_and(F.coalesce(F.try_mod(F.col(c), F.col(f"base_{c}")) == 0, F.lit(False)))
    told = told.groupBy(*by).agg(
        F.first("base_step").alias("base"), F.first("base_months").alias("base_months"), multiple("step").alias("regular"), multiple("months").alias("monthly"),
        F.percentile("step", F.lit(0.5), F.col("k")).alias("mid"),
    )
    both = join_by_key(whole.filter("stamps > 1"), told, keys)
    c = F.col
    monthly = c("monthly") & (c("least_months") > 0) & c("same_time")
    day_base = (c("base") % DAY == 0) & c("same_time")
    m = c("mid")
    choice = lambda u, e, f, a=c("anchor"): F.struct(F.lit(u).alias("unit"), e.cast("long").alias("every"), f.alias("frequency"), a.alias("anchor"))
    n = lambda e, unit: F.concat(F.when(e == 1, "").otherwise(e.cast("long").cast("string")), F.lit(unit))
    seconds = F.concat((c("base") / 1_000_000).cast("double").cast("string"), F.lit("s"))
    seconds = F.when(c("base") % 1_000_000 == 0, F.concat((c("base") / 1_000_000).cast("long").cast("string"), F.lit("s"))).otherwise(seconds)
    step = (
        F.when(monthly & c("same_day"), choice("months", c("base_months"), n(c("base_months"), "MS")))
        .when(monthly & c("at_end"), choice("month_end", c("base_months"), n(c("base_months"), "ME")))
        .when(c("business") & c("same_time"), choice("business", F.lit(1), F.lit("B")))
        .when(c("regular") & day_base, choice("days", c("base") / DAY, n(c("base") / DAY, "D")))
        .when(c("regular"), choice("micros", c("base"), F.when(c("base") == 3_600_000_000, "H").otherwise(seconds)))
        .when(m <= 3_600_000_000, choice("micros", F.lit(3_600_000_000), F.lit("H")))
        .when(m <= DAY, choice("days", F.lit(1), F.lit("D")))
        .when(m <= 7 * DAY, choice("days", F.lit(7), F.lit("W")))
        .when(m <= 31 * DAY, choice("months", F.lit(1), F.lit("MS"), F.date_trunc("month", "anchor")))
        .otherwise(choice("months", F.lit(12), F.lit("YS"), F.date_trunc("year", "anchor")))
    )
    many = both.withColumn("s", step).select(*by, "s.unit", "s.every", "s.anchor", "hi", "s.frequency")
    single = whole.filter("stamps = 1").select(*by, F.lit("days").alias("unit"), F.lit(1).cast("long").alias("every"), "anchor", "hi", F.lit("D").alias("frequency"))
    return many.unionByName(single)


def _point(i: Column) -> Column:
    """Grid point number ``i`` of a step; null for a weekend of business days."""
    anchor, shift = F.col("anchor"), i * F.col("every")
    at_day = micros(anchor) - micros(F.date_trunc("day", anchor))
    days = anchor + F.make_interval(days=shift.cast("int"))
    end = F.timestamp_micros(micros(F.last_day(F.add_months(F.to_date(F.date_trunc("month", anchor)), shift.cast("int"))).cast("timestamp")) + at_day)
    return (
        F.when(F.col("unit") == "micros", F.timestamp_micros(micros(anchor) + shift))
        .when(F.col("unit") == "days", days)
        .when(F.col("unit") == "business", F.when(F.weekday(days) < 5, days))
        .when(F.col("unit") == "month_end", end)
        .otherwise(anchor + F.make_interval(months=shift.cast("int")))
    )


def grid(steps: DataFrame, ts: str, keys: list[str] = ()) -> DataFrame:
    """(keys, ts): all grid points of ``steps``. A long grid is first cut into pieces, which are dealt to tasks, then spread."""
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = micros(F.col("hi")) - micros(F.col("anchor"))
    months = (F.year("hi") - F.year("anchor")) * 12 + F.month("hi") - F.month("anchor")
    most = F.when(F.col("unit") == "micros", F.floor(span / F.col("every"))).when(F.col("unit").isin("days", "business"), F.floor(span / (F.col("every") * DAY)) + 1).otherwise(F.floor(months / F.col("every")))
    pieces = steps.withColumn("most", most.cast("long")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("most") / GRID_ROWS))))
    dealt = pieces.repartition(parts, *[q(k) for k in keys], "piece")
    first = F.col("piece") * GRID_ROWS
    points = dealt.withColumn("i", F.explode(F.sequence(first, F.least(F.col("most"), first + GRID_ROWS - 1))))
    return points.withColumn("__t", _point(F.col("i"))).filter("__t <= hi").select(*[q(k) for k in keys], F.col("__t").alias(ts))


def on_grid(df: DataFrame, ts: str, points: DataFrame, keys: list[str] = (), how: str = "left") -> DataFrame:
    """``points`` with the data on them (left), or the data's rows that lie on points (semi) or off them (anti)."""
    named = points.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, ts]})
    data = df.withColumn(ts, q(ts).cast("timestamp"))
    on = _same([*keys, ts])
    if how == "left":
        return named.join(data, on, "left").select(*[q(f"__k_{c}").alias(c) if c in [*keys, ts] else q(c) for c in df.columns])
    return data.join(named, on, {"semi": "left_semi", "anti": "left_anti"}[how])


def grid_report(df: DataFrame, ts: str, steps: DataFrame, points: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, frequency, rows, points, off_grid): for each key its rows, its grid points, and how many rows lie off the grid."""
    by = [q(k) for k in keys]
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    off = on_grid(df, ts, points, keys, "anti").groupBy(*by).agg(F.count(F.lit(1)).alias("off_grid"))
    out = join_by_key(join_by_key(rows, steps.select(*by, "frequency"), list(keys)), points.groupBy(*by).agg(F.count(F.lit(1)).alias("points")), list(keys))
    out = join_by_key(out, off, list(keys), "left") if keys else out.crossJoin(F.broadcast(off))  # one row each
    return out.select(*by, "frequency", "rows", "points", F.coalesce("off_grid", F.lit(0)).alias("off_grid"))
