"""Column names, missing-value words, types hidden in text, and columns not worth keeping."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def q(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(quoted(name))


def one_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """All aggregates of one pass over ``df``; keys may be any strings."""
    if not exprs:
        return {}
    names = list(exprs)
    row = df.agg(*[exprs[n].alias(f"a{i}") for i, n in enumerate(names)]).first()
    return dict(zip(names, row, strict=True))


@dataclass(frozen=True)
class Groups:
    """Column names by bucket."""

    string: list[str]
    numeric: list[str]
    datetime: list[str]
    boolean: list[str]


def column_groups(df: DataFrame) -> Groups:
    of = lambda *kinds: [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    return Groups(of(T.StringType, T.CharType, T.VarcharType), of(T.NumericType), of(T.TimestampType, T.TimestampNTZType, T.DateType), of(T.BooleanType))


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    if len(set(names)) < len(names):
        clash = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"renaming gives the same name twice: {clash}")
    return df.toDF(*names)


def plain_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip())


def normalize_names(df: DataFrame) -> DataFrame:
    """Names trimmed, runs of white space as ``_``; equal results are an error."""
    return _renamed(df, [plain_name(c) for c in df.columns])


def snake_case_names(df: DataFrame) -> DataFrame:
    """Names lower-cased and trimmed, spaces and hyphens as ``_``."""
    return _renamed(df, [c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def name_blank_columns(df: DataFrame) -> DataFrame:
    """Empty names become no_name_1, no_name_2 and so on."""
    names, n = [], 0
    for c in df.columns:
        n += not c.strip()
        names.append(c if c.strip() else f"no_name_{n}")
    return _renamed(df, names)


def _map_strings(df: DataFrame, change, keep: list[str] = ()) -> DataFrame:
    strings = set(column_groups(df).string) - set(keep)
    return df.select(*[change(q(c)).alias(c) if c in strings else q(c) for c in df.columns])


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN as null in float columns, as every operator here expects."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[S.not_nan(q(c)).alias(c) if c in floats else q(c) for c in df.columns])


def clean_strings(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """String columns but ``keep`` squeezed; whole values that spell NaN or null become null."""

    def change(c: Column) -> Column:
        text = S.squeeze(c)
        return F.when(~text.isin(S.NULL_WORDS), text)

    return _map_strings(df, change, keep)


def recognize_missing(df: DataFrame, tokens: list[str] = S.MISSING_TOKENS) -> DataFrame:
    """String values among ``tokens`` become null before trimming; blank ones after it."""

    def change(c: Column) -> Column:
        text = F.trim(F.when(~c.isin(tokens), c))
        return F.when(text != "", text)

    return _map_strings(df, change)


def _without_null_words(c: Column) -> Column:
    return F.when(~c.isin(S.INFERENCE_NULLS), c)


def infer_datetime_columns(df: DataFrame, min_parse_ratio: float = 0.6, min_pattern_ratio: float = 0.3, keep: list[str] = ()) -> DataFrame:
    """String columns but ``keep`` that look like dates and mostly parse become timestamps.

    A first pass counts what looks like a date; only columns with enough of it are parsed, in a second.
    """
    strings = [c for c in column_groups(df).string if c not in keep]
    value = lambda c: _without_null_words(q(c))
    looks = one_row(df, {f"{k} {c}": f for c in strings for k, f in (("n", F.count(value(c))), ("p", F.count_if(value(c).rlike(S.DATE))))})
    likely = [c for c in strings if looks[f"n {c}"] and looks[f"p {c}"] > min_pattern_ratio * looks[f"n {c}"]]
    parsed = one_row(df, {c: F.count(S.to_date(value(c))) for c in likely})
    dates = {c for c in likely if parsed[c] >= min_parse_ratio * looks[f"n {c}"]}
    return df.select(*[S.to_date(_without_null_words(q(c))).alias(c) if c in dates else q(c) for c in df.columns])


def infer_numeric_columns(df: DataFrame, min_ratio: float = 0.5, mode: str = "tabular", keep: list[str] = ()) -> DataFrame:
    """String columns but ``keep`` that mostly spell numbers become numbers, what does not parse null.

    tabular: numbers / non-null values at least ``min_ratio``; DOUBLE.
    ts: numbers / all rows above 0.6 (or ``min_ratio`` if given higher); LONG when all are whole, else DOUBLE.
    """
    strings = [c for c in column_groups(df).string if c not in keep]
    stats: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for c in strings:
        v = _without_null_words(q(c))
        x = S.to_number(v)
        stats |= {f"n {c}": F.count(v), f"x {c}": F.count(x), f"w {c}": F.bool_and(x % 1 == 0)}
    got = one_row(df, stats)
    change: dict[str, str] = {}
    for c in strings:
        n, x = got[f"n {c}"], got[f"x {c}"]
        if mode == "tabular":
            if x and x >= min_ratio * n:
                change[c] = "double"
        elif x > max(0.6, min_ratio) * got["rows"]:
            change[c] = "long" if got[f"w {c}"] else "double"
    return df.select(*[S.to_number(_without_null_words(q(c))).cast(change[c]).alias(c) if c in change else q(c) for c in df.columns])


def drop_duplicate_columns(df: DataFrame, row_id: list[str] | None = None) -> DataFrame:
    """Without columns whose values equal an earlier column's row for row (null = null, 1 = 1.0).

    Order-free fingerprints of all columns in one pass find candidates, a second pass compares them.
    row_id: columns that are not judged.
    """
    names = [c for c in df.columns if c not in (row_id or [])]
    kind = {f.name: f.dataType for f in df.schema}
    as_number = lambda c: isinstance(kind[c], T.NumericType)
    value = lambda c: q(c).cast("double") if as_number(c) else q(c).cast("string")
    family = lambda c: "number" if as_number(c) else kind[c].simpleString()
    prints = one_row(df, {c: F.struct(F.sum(F.xxhash64(value(c)).cast("decimal(38,0)")), F.count(q(c))) for c in names})
    groups: dict[tuple, list[str]] = {}
    for c in names:
        groups.setdefault((family(c), tuple(prints[c])), []).append(c)
    gone: set[str] = set()
    alike = [g for g in groups.values() if len(g) > 1]
    while alike:  # all against the first of their group; those that differ (the same values in other rows) form the next round's groups
        pairs = [(g[0], b) for g in alike for b in g[1:]]
        same = one_row(df, {f"{i}": F.bool_and(value(a).eqNullSafe(value(b))) for i, (a, b) in enumerate(pairs)})
        equal = {b for i, (_, b) in enumerate(pairs) if same[f"{i}"] in (True, None)}
        gone |= equal
        alike = [rest for g in alike if len(rest := [b for b in g[1:] if b not in equal]) > 1]
    return df.select(*[q(c) for c in df.columns if c not in gone])


@dataclass
class ColumnReport:
    """Dropped columns by reason."""

    dropped: dict[str, str] = field(default_factory=dict)


def _unpivoted(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null")


def dominance(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, distinct, top, n) of the non-null values; partial aggregation carries hot values."""
    counts = _unpivoted(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.max("k").alias("top"), F.sum("k").alias("n"))


#: Items that a sketch of frequent values tracks: a value with more than some thousandths of the rows is always among them.
TRACKED = 1024


def dominant_values(df: DataFrame, cols: list[str], share: float = 0.95) -> dict[str, tuple[int, int, bool]]:
    """For each column: non-null rows, rows of its commonest value if that has ``share`` of them (else 0), and whether all are one value.

    A mergeable sketch of frequent values names the candidates of every column in one pass; a second one counts them.
    Cells are never shuffled. ``share`` must be at least a hundredth, far above what the sketch may miss.
    """
    if share < 0.01:
        raise ValueError("a share below a hundredth needs dominance()")
    text = {c: q(c).cast("string") for c in cols}
    # nulls would be items, too, and hide values of columns that are mostly null
    top = lambda c: F.expr(f"approx_top_k(CAST({quoted(c)} AS STRING), {int(1 / share)}, {TRACKED}) FILTER (WHERE {quoted(c)} IS NOT NULL)")
    got = one_row(df, {f"{k} {c}": e for c, v in text.items() for k, e in (("n", F.count(v)), ("one", F.min(v) == F.max(v)), ("top", top(c)))})
    likely = {c: [r["item"] for r in got[f"top {c}"] or []] for c in cols}
    counts = one_row(df, {f"{i} {c}": F.count_if(text[c] == F.lit(v)) for c in cols if not got[f"one {c}"] for i, v in enumerate(likely[c])})
    out = {}
    for c in cols:
        n = got[f"n {c}"]
        most = n if got[f"one {c}"] else max((counts[f"{i} {c}"] for i in range(len(likely[c]))), default=0)
        out[c] = (n, most if most >= share * n else 0, bool(got[f"one {c}"]))
    return out


def drop_constant_columns(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.95) -> tuple[DataFrame, ColumnReport]:
    """Without columns of one value, or whose commonest has ``threshold`` of the non-null rows; all-null columns stay."""
    cols = cols if cols is not None else df.columns
    report = ColumnReport()
    for c, (n, top, single) in dominant_values(df, cols, threshold).items() if cols else []:
        if n and (single or top):
            report.dropped[c] = "constant" if single else "near-constant"
    return df.select(*[q(c) for c in df.columns if c not in report.dropped]), report


def drop_high_cardinality(df: DataFrame, ratio: float = 0.7, absolute: int | None = None, cols: list[str] | None = None) -> tuple[DataFrame, ColumnReport]:
    """Without string columns of ``absolute`` distinct values, or of ``ratio`` distinct per non-null value.

    A cheap estimate settles columns far from the limits; only the others are counted exactly.
    """
    strings = [c for c in column_groups(df).string if cols is None or c in cols]
    about = one_row(df, {f"{k} {c}": f for c in strings for k, f in (("d", F.approx_count_distinct(q(c), 0.02)), ("n", F.count(q(c))))})
    near = []
    report = ColumnReport()

    def judge(c: str, distinct: float, n: int, slack: float) -> bool | None:
        limits = [x for x in (ratio * n, absolute) if x is not None]
        if not n:
            return False
        if any(distinct * (1 - slack) >= x for x in limits):
            return True
        return None if any(distinct * (1 + slack) >= x for x in limits) else False

    for c in strings:
        verdict = judge(c, about[f"d {c}"], about[f"n {c}"], 0.1)
        if verdict is None:
            near.append(c)
        elif verdict:
            report.dropped[c] = "high cardinality"
    exact = one_row(df, {c: F.count_distinct(q(c)) for c in near})
    for c in near:
        if judge(c, exact[c], about[f"n {c}"], 0.0):
            report.dropped[c] = "high cardinality"
    return df.select(*[q(c) for c in df.columns if c not in report.dropped]), report


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(q(target))


#: Name pattern, test on the column's maximum, factor (fixed values of the conversion table).
UNIT_RULES = [
    ("mpg|mileage", lambda top: top < 50, 2.352),
    ("weight|curb", lambda top: top > 10000, 0.453592),
    ("engine|displacement", lambda top: top > 100, 0.001),
]


def standardize_units(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Numeric columns converted by name and size, and numbers taken from texts on power; with a report by column."""
    groups = column_groups(df)
    rule = {c: next(((p, t, f) for p, t, f in UNIT_RULES if re.search(p, c.lower())), None) for c in groups.numeric}
    top = one_row(df, {c: F.max(q(c)) for c, r in rule.items() if r})
    change: dict[str, Column] = {}
    report: dict[str, str] = {}
    for c, r in rule.items():
        if r and top[c] is not None and r[1](float(top[c])):
            change[c] = q(c) * F.lit(r[2])
            report[c] = f"times {r[2]}"
    for c in groups.string:
        if re.search("horse|power|hp", c.lower()):
            number = F.regexp_extract(q(c), r"(\d+\.?\d*)", 1)
            change[c] = F.when(number != "", number.cast("double"))
            report[c] = "number from text"
    return df.select(*[change[c].alias(c) if c in change else q(c) for c in df.columns]), report
