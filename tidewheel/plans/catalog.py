"""Tables of a folder as DataFrames, and relations given in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def relation(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """``sql`` over tables in braces, as in ``SELECT 1 FROM {orders}``."""
    names = {f for _, f, _, _ in string.Formatter().parse(sql) if f}
    return spark.sql(sql, **{n: load(spark, folder, n) for n in names})


def plain(sql: str) -> str:
    """The same SQL for an engine that has the tables as views."""
    return sql.format(**{n: n for n in TABLES})
