"""Reading and writing tables, leaderboards and fitted pipelines."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SEPARATORS = {".csv": ",", ".txt": "\t", ".tsv": "\t"}


def _ending(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table by its extension: .csv, .txt and .tsv (tab), .parquet; with ``schema`` text files are read in one pass.

    Another extension is a ValueError; a missing path is Spark's own AnalysisException.
    """
    ending = _ending(path)
    if ending == ".parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if ending in SEPARATORS:
        reader = spark.read.option("header", True).option("sep", SEPARATORS[ending])
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"cannot read {path!r}: use one of {sorted([*SEPARATORS, '.parquet'])}")


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    if format not in ("parquet", "csv"):
        raise ValueError(f"cannot write {format!r}: use parquet or csv")
    writer = df.write.mode("overwrite").partitionBy(*partition_by or [])
    (writer.option("header", True).csv if format == "csv" else writer.parquet)(path)


def write_leaderboard(df: DataFrame, path: str) -> None:
    """One CSV file; a leaderboard has a row a model."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
