"""The batch operators that also run on streams: cleaning and scoring are row by row."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.columns import clean_strings, normalize_names


def score_stream(spark: SparkSession, folder: str, schema: StructType, model: PipelineModel, sink: str, checkpoint: str) -> StreamingQuery:
    """Scores Parquet files as they arrive in ``folder`` into ``sink``, exactly once by its checkpoint."""
    rows = clean_strings(normalize_names(spark.readStream.schema(schema).parquet(folder)))
    scored = model.transform(rows)
    plain = [c for c, kind in scored.dtypes if not kind.startswith("vector") and kind != "udt"]
    return scored.select(*plain).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means by window and key of a stream, closed once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(key)).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
