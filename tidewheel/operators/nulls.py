"""Row filters on nulls, and imputation from statistics of one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.quantiles import exact_quantiles
from .columns import column_groups, one_row, q


def _null_count(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [q(c).isNull().cast("int") for c in cols], F.lit(0))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(q(target).isNotNull())


def drop_all_null_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Without rows in which all of ``cols`` are null."""
    cols = cols if cols is not None else df.columns
    return df.filter(_null_count(cols) < len(cols)) if cols else df


def drop_corrupted_rows(df: DataFrame, share: float = 0.8, cols: list[str] | None = None) -> DataFrame:
    """Without rows in which at least ``share`` of ``cols`` are null."""
    cols = cols if cols is not None else df.columns
    return df.filter(_null_count(cols) < share * len(cols)) if cols else df


def drop_any_null_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.filter(_null_count(cols if cols is not None else df.columns) == 0)


def null_shares(df: DataFrame, cols: list[str]) -> dict[str, float]:
    got = one_row(df, {"rows": F.count(F.lit(1))} | {f"n {c}": F.count(q(c)) for c in cols})
    return {c: 1 - got[f"n {c}"] / got["rows"] if got["rows"] else 0.0 for c in cols}


def drop_high_null_columns(df: DataFrame, share: float = 0.6, inclusive: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Without columns whose null share reaches (inclusive) or exceeds ``share``."""
    shares = null_shares(df, [c for c in df.columns if c not in (keep or [])])
    gone = {c for c, s in shares.items() if (s >= share if inclusive else s > share)}
    return df.select(*[q(c) for c in df.columns if c not in gone])


def parse_and_require_date(df: DataFrame, col: str) -> DataFrame:
    """``col`` as a timestamp, without the rows that do not parse."""
    kind = dict(df.dtypes)[col]
    parsed = S.to_date(q(col)) if kind == "string" else q(col).cast("timestamp")
    return df.withColumn(col, parsed).filter(q(col).isNotNull())


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}

    def filled(c: str) -> Column:
        kind = kinds[c].simpleString()
        # a mean or median of whole numbers need not be whole
        target = "double" if kind in ("tinyint", "smallint", "int", "bigint") and isinstance(values[c], float) and values[c] % 1 else kind
        return F.coalesce(q(c).cast(target), F.lit(values[c]).cast(target)).alias(c)

    return df.select(*[filled(c) if values.get(c) is not None else q(c) for c in df.columns])


def impute_numeric(df: DataFrame, how: str = "median", cols: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Nulls of numeric columns filled with their mean, median or zero; ``accuracy`` asks for approximate medians."""
    cols = cols if cols is not None else column_groups(df).numeric
    if how == "zero":
        return _fill(df, dict.fromkeys(cols, 0))
    holes = one_row(df, {c: F.count_if(q(c).isNull()) for c in cols})
    cols = [c for c in cols if holes[c]]
    if how == "median" and not accuracy:
        found = exact_quantiles(df, {c: q(c) for c in cols}, [0.5])
        return _fill(df, {c: v[0] if v else None for c, v in found.items()})
    return _fill(df, one_row(df, {c: F.avg(q(c)) if how == "mean" else F.percentile_approx(q(c), 0.5, accuracy).cast("double") for c in cols}))


def impute_categorical(df: DataFrame, how: str = "mode", cols: list[str] | None = None, default: str = "missing") -> DataFrame:
    """Nulls of non-numeric columns filled with the mode (of ties the least), or with ``default``."""
    numeric = set(column_groups(df).numeric)
    cols = cols if cols is not None else [c for c in df.columns if c not in numeric]
    modes = one_row(df, {c: F.mode(q(c), deterministic=True) for c in cols}) if how == "mode" else {}
    strings = set(column_groups(df).string)
    return _fill(df, {c: modes.get(c) if modes.get(c) is not None else (default if c in strings else None) for c in cols})


def impute_auto(df: DataFrame, strategy: str = "auto") -> DataFrame:
    """Numeric columns by mean (auto, under 30 % null: what one-column nearest neighbours amount to), median or dropping rows; text by mode."""
    groups = column_groups(df)
    if strategy == "drop":
        df = drop_any_null_rows(df, groups.numeric)
    elif strategy == "auto":
        shares = null_shares(df, groups.numeric)
        df = impute_numeric(df, "mean", [c for c in groups.numeric if shares[c] < 0.3])
        df = impute_numeric(df, "median", [c for c in groups.numeric if shares[c] >= 0.3])
    else:
        df = impute_numeric(df, strategy, groups.numeric)
    return impute_categorical(df, "mode", groups.string, "Unknown")


def null_report(df: DataFrame) -> DataFrame:
    """(column, nulls, share) for every column, and rows ``*`` cells, ``*partial`` and ``*full`` rows with nulls."""
    cols = df.columns
    count = _null_count(cols)
    exprs = [F.count(F.lit(1)).alias("rows"), F.sum(((count > 0) & (count < len(cols))).cast("long")).alias("partial"), F.sum((count == len(cols)).cast("long")).alias("full")]
    one = df.agg(*exprs, *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    by = [F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"c{i}")).alias("nulls"), F.try_divide(F.col("rows") - F.col(f"c{i}"), F.col("rows")).alias("share")) for i, c in enumerate(cols)]
    cells = reduce(lambda a, b: a + b, [F.col("rows") - F.col(f"c{i}") for i in range(len(cols))])
    total = [
        F.struct(F.lit("*").alias("column"), cells.alias("nulls"), F.try_divide(cells, F.col("rows") * len(cols)).alias("share")),
        F.struct(F.lit("*partial").alias("column"), F.coalesce("partial", F.lit(0)).alias("nulls"), F.try_divide("partial", "rows").alias("share")),
        F.struct(F.lit("*full").alias("column"), F.coalesce("full", F.lit(0)).alias("nulls"), F.try_divide("full", "rows").alias("share")),
    ]
    return one.select(F.explode(F.array(*by, *total)).alias("r")).select("r.*")
