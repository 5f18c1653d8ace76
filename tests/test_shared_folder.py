"""Where intermediate tables go, and how they are deleted."""

from __future__ import annotations

import time
from pathlib import Path

import pytest

from tidewheel.functions import graph


def test_a_cluster_must_name_the_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        graph.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert graph.shared_folder(Session()) == "hdfs://x/y"


def test_intermediate_tables_are_deleted_together(spark):
    table = graph.materialise(spark.range(5), "five")
    assert table.count() == 5 and table.inputFiles()
    graph.clear(spark)
    spark.catalog.clearCache()
    with pytest.raises(Exception):  # noqa: B017 whatever the file system says
        graph.materialise(spark.range(3), "other").unionByName(table).count()


def test_a_written_table_leaves_no_shuffle_files_and_can_be_discarded(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in local for f in Path(d.getPath()).rglob("shuffle_*")}
    before, was = files(), spark.conf.get(graph._CLEANUP, None)
    table = graph.materialise(spark.range(5000).groupBy((graph.F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):  # they are deleted in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(graph._CLEANUP, None) == was
    path = Path(table.inputFiles()[0].removeprefix("file:")).parent
    assert table.count() == 7 and path.exists()
    graph.discard(table, spark.range(3))
    assert not path.exists()
