"""Materialised intermediates and connected components, both safe against lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workers import map_arrow

_own_folder: list[str] = []
#: Makes Spark delete a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = {"threads": 0, "before": None}
_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session (tests) names none, a folder of our own.

    On a cluster executors do not share local folders, so there the setting must be made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-shared-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return "file://" + _own_folder[0]


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidewheel/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application; ``clear`` deletes them all."""
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. Results that were not written out before are lost."""
    _delete(spark, _tables(spark))


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession):
    """While it is open, queries that begin delete their shuffle files when they end; threads may overlap."""
    with _lock:
        if not _writing["threads"]:
            _writing["before"] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writing["threads"] += 1
    try:
        yield
    finally:
        with _lock:
            _writing["threads"] -= 1
            if not _writing["threads"]:
                spark.conf.unset(_CLEANUP) if _writing["before"] is None else spark.conf.set(_CLEANUP, _writing["before"])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and so do its shuffle files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _shuffles_end(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """One table of frames (at least one, of one schema) that are written one after the other: at any time there are
    only the shuffle files of one of them."""
    path = ""
    for part in parts:
        path = path or fresh_path(part.sparkSession, name)
        with _shuffles_end(part.sparkSession):
            part.write.mode("append").parquet(path)
    table = part.sparkSession.read.schema(part.schema).parquet(path)
    table._written_to = path
    return table


def rounds_for(copies: float, rows: float, least: int = 200_000) -> int:
    """Rounds that deal ``copies`` of ``rows`` rows so that one shuffles about two of each, or ``least`` rows."""
    return max(1, int(-(-copies // max(2 * rows, least))))


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables of ``materialise`` that nothing reads any more; other frames are left alone."""
    for table in tables:
        if path := getattr(table, "__dict__", {}).pop("_written_to", None):
            _delete(table.sparkSession, path)


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), sorted, and for each the smallest node of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    left, right = flat[: len(a)].tolist(), flat[len(a) :].tolist()
    for x, y in zip(left, right, strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i in range(len(parent)):
        parent[i] = parent[parent[i]]
    return nodes, nodes[np.asarray(parent, dtype=np.int64)] if len(nodes) else nodes


def _local_forest(batches):
    """Each batch of edges becomes stars of its own components: never more edges than it had."""
    for batch in batches:
        if batch.num_rows:
            nodes, roots = union_find(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
            keep = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(roots[keep]), pa.array(nodes[keep])], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); root is the smallest node reachable.

    Alternating large-star and small-star rounds over DataFrames (Kiveris et al. 2014), after
    each task has contracted its own edges. Neighbour minima are pre-aggregated map-side.
    Empty edges give an empty result; if the edges still change after ``rounds`` it raises.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    now = materialise(
        map_arrow(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v"), _local_forest, "u long, v long").distinct(),
        "edges",
    )
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # now every edge is (smaller, larger); small star: the larger end gathers its smaller neighbours
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        last, now = now, materialise(small, "edges")
        discard(last)
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
