"""Distinct values of all columns, and distinct rows, from one pass over hash pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import q



def hashable(df: DataFrame, c: str) -> Column:
    """The column, nested ones as JSON: a hash leaves nulls out, so that nested ones would not show."""
    nested = isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(F.struct(q(c))) if nested else q(c)


def hash_pair(*values: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the values, of which either may be null: (null, "a") is not ("a", null)."""
    gaps = [v.isNull() for v in values]
    given = [*([F.array(*gaps)] if len(values) > 1 else []), *values]
    return F.xxhash64(*given), F.xxhash64(F.lit(1), *given)


def distinct_counts(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """One row: ``rows``, ``distinct_rows`` and for the i-th of ``cols`` ``n{i}`` (not null) and ``d{i}`` (distinct of these).

    Exact: every row gives a hash pair a column and one of the row, which partial aggregation merges before the shuffle,
    so a frequent value is one row a task and no value itself is shuffled. Values count as different by 128 bits (two of
    10^12 share them with a chance of 10^-15; numbers, dates and stamps never do). -0.0 is 0.0 and all NaN are one value.
    Not exact: sketches of two per cent, one pass and no shuffle but of sketches. An empty table has zeros.
    """
    whole = hash_pair(*[hashable(df, c) for c in df.columns])
    if not exact:
        near = lambda e: F.approx_count_distinct(e, 0.02)
        by = [e for i, c in enumerate(cols) for e in (F.count(q(c)).alias(f"n{i}"), near(hashable(df, c)).alias(f"d{i}"))]
        return df.agg(F.count(F.lit(1)).alias("rows"), near(whole[0]).alias("distinct_rows"), *by)
    cell = lambda i, pair: F.struct(F.lit(i).cast("int").alias("i"), pair[0].alias("h"), pair[1].alias("g"))
    cells = [cell(-1, whole), *[F.when(q(c).isNotNull(), cell(i, hash_pair(hashable(df, c)))) for i, c in enumerate(cols)]]
    held = df.select(F.explode(F.array(*cells)).alias("cell")).filter("cell is not null").select("cell.*")
    by = held.groupBy("i", "h", "g").agg(F.count(F.lit(1)).alias("k")).groupBy("i").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("d"))
    at = lambda i, c: F.coalesce(F.max(F.when(F.col("i") == i, F.col(c))), F.lit(0))
    each = [e for i in range(len(cols)) for e in (at(i, "n").alias(f"n{i}"), at(i, "d").alias(f"d{i}"))]
    return by.agg(at(-1, "n").alias("rows"), at(-1, "d").alias("distinct_rows"), *each)
