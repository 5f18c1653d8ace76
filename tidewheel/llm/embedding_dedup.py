"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per group.

1. Equal vectors are one point with a count. Null, zero and broken vectors (null or non-finite
   components) link with nothing.
2. Spherical k-means is fitted on a bounded, hash-chosen sample of SAMPLE points; its cells grow in number
   with the corpus up to MOST_CELLS. Every point has a home cell and visits all cells whose
   centroid is at most ``slack`` less similar than its home. A pair is compared in the home of
   one where the other is at home or visits. With cosine c the difference of two points is at
   most sqrt(2 - 2c) long, so slack = 2 * sqrt(2 - 2c) would be exact; the default is a quarter of that, at which
   a pair is missed only when noise pulls both points' homes apart by over ``slack``.
   Recall is measured in the tests against brute force.
3. A cell's points at home and all its points are cut by hash into tiles of at most about TILE numbers (points times
   dimensions: 16 MB), so a hot cell becomes many tile pairs and a usual cell is one. They are compared in double precision and give link counts for each point and a forest of links, never pairs.

Defined results: rows with the same vec_id stay apart unless their vectors are equal; a null
vec_id takes part and never names a component unless alone; vectors of different lengths are
compared only within one length, each length with a k-means of its own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workers import map_arrow, ship
from .shared import components, materialise, union_find

SAMPLE, MOST_CELLS, CELL_POINTS, TILE, STEPS = 20_000, 1024, 4096, 2_097_152, 8
BLOCK = 128  # points of one tile multiplied with the other at a time
LONG = np.int64


def _points(column: pa.Array) -> np.ndarray:
    """The unit vectors of a column of valid vectors of one length."""
    matrix = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def spherical_kmeans(points: np.ndarray, k: int, seed: int = 7, steps: int = STEPS) -> np.ndarray:
    """k unit centroids of unit points, by Lloyd rounds of cosine; empty cells are seeded anew."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), size=k, replace=len(points) < k)].copy()
    for _ in range(steps):
        home = np.concatenate([np.argmax(points[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        size = np.linalg.norm(sums, axis=1)
        empty = size < 1e-9
        sums[empty] = points[rng.choice(len(points), size=int(empty.sum()))]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def _assign(centres, slack: float):
    def run(batches):
        c = centres.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _points(batch.column(1))
            for i in range(0, len(x), 2048):
                near = x[i : i + 2048] @ c.T
                home = near.argmax(1)
                row, cell = np.nonzero(near >= near.max(1)[:, None] - slack)
                ids = batch.column(0).slice(i, 2048)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), ids.take(take), pa.array(home[row].astype(np.int32))], names=["cell", "point", "home"])

    return run


def _compare(centres, least: float, slack: float):
    """Link counts of points and a forest of links from one tile pair of a cell."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c = centres.value
        cell, point, home, side, many = (table.column(n).to_numpy() for n in ("cell", "point", "home", "side", "many"))
        x = _points(table.column("v").combine_chunks())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, a_, b_ = np.zeros(len(point), LONG), [], []
        here = int(cell[0]) if len(cell) else 0
        near = x @ c.T
        floor = near.max(1) - slack
        others = x[right].T
        for s in range(0, len(left), BLOCK):
            rows = left[s : s + BLOCK]
            a, b = np.nonzero(x[rows] @ others >= least)
            a, b = rows[a], right[b]
            # of points at home together this cell decides; otherwise the home of one, of both the lower cell
            # a is at home here. A pair at home together is met twice, as is one whose a visits b's home, too: keep one.
            together = home[b] == here
            again = ~together & (near[a, home[b]] >= floor[a])
            keep = np.where(together, point[a] < point[b], ~again | (here < home[b]))
            a, b = a[keep], b[keep]
            np.add.at(links, a, many[b])
            np.add.at(links, b, many[a])
            a_.append(point[a])
            b_.append(point[b])
        nodes, roots = union_find(np.concatenate(a_), np.concatenate(b_)) if a_ else (np.zeros(0, LONG),) * 2
        got = np.flatnonzero(links)
        edge = nodes != roots
        none = pa.nulls(len(got), pa.int64())
        return pa.table({"point": pa.concat_arrays([pa.array(point[got]), pa.array(nodes[edge], pa.int64())]), "links": pa.concat_arrays([pa.array(links[got]), pa.nulls(int(edge.sum()), pa.int64())]), "root": pa.concat_arrays([none, pa.array(roots[edge], pa.int64())])})

    return run


def link_vectors(vectors: DataFrame, least: float = 0.9, slack: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    slack = np.sqrt(2 - 2 * least) / 2 if slack is None else slack
    v = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    # scaled by its largest component first, so that the square sum neither overflows nor vanishes
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)) & (F.size("v") > 0))
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.when(F.col("ok"), F.transform("v", lambda e: e / top + F.lit(0.0)))
    rows = rows.select("vec_id", "ok", scaled.alias("v"))
    rows = materialise(rows.withColumn("point", F.when(F.col("ok"), F.xxhash64("v"))), "vectors")
    points = rows.filter("ok").groupBy("point").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    points = materialise(points, "points")
    found = None
    for size in [r[0] for r in points.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]:
        some = points.filter(F.size("v") == size)
        one = _links_of_size(some, size, least, slack)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "point long, links long, root long")
    found = materialise(found, "links")
    counts = found.filter("links is not null").groupBy("point").agg(F.sum("links").alias("links"))
    joined = components(found.filter("root is not null").select("root", "point"))
    groups = points.select("point", "many", "least").join(joined, F.col("point") == F.col("node"), "left").withColumn("root", F.coalesce("root", "point"))
    ids = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = groups.join(ids, "root").join(counts, "point", "left").select("point", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    linked = rows.filter("ok").join(of_point, "point").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def _links_of_size(points: DataFrame, size: int, least: float, slack: float) -> DataFrame:
    spark = points.sparkSession
    n = points.count()
    chosen = points.orderBy(F.xxhash64("point")).limit(SAMPLE).select("v").toPandas()
    sample = np.array(chosen["v"].tolist(), dtype=np.float64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    cells = int(min(MOST_CELLS, max(1, n // CELL_POINTS)))
    centres = spark.sparkContext.broadcast(spherical_kmeans(sample, cells))
    places = map_arrow(points.select("point", "v"), _assign(centres, slack), "cell int, point long, home int")
    places = materialise(places, "cells")
    at_home = F.col("home") == F.col("cell")
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n * size / TILE)).cast("int")
    sizes = places.groupBy("cell").agg(tiles(F.count_if(at_home)).alias("kp"), tiles(F.count(F.lit(1))).alias("kq"))
    tiled = places.join(sizes, "cell").withColumn("h", F.xxhash64("point", F.lit(1)))
    own = F.when(at_home, F.transform(F.sequence(F.lit(0), F.col("kq") - 1), lambda j: F.struct(F.pmod("h", F.col("kp")).cast("int").alias("p"), j.alias("q"), F.lit(0).alias("side"))))
    all_ = F.transform(F.sequence(F.lit(0), F.col("kp") - 1), lambda i: F.struct(i.alias("p"), F.pmod("h", F.col("kq")).cast("int").alias("q"), F.lit(1).alias("side")))
    none = F.expr("cast(array() as array<struct<p:int,q:int,side:int>>)")
    dealt = tiled.select("cell", "point", "home", F.explode(F.concat(F.coalesce(own, none), all_)).alias("t")).select("cell", "t.*", "point", "home").join(points.select("point", "many", "v"), "point")
    ship(spark)
    return dealt.groupBy("cell", "p", "q").applyInArrow(_compare(centres, least, slack), "point long, links long, root long")


def recall(vectors: pd.DataFrame, found: pd.DataFrame, least: float) -> float:
    """Share of the brute-force links that ``found`` (vec_id, n_links) counts; for tests on small inputs."""
    x = np.array(vectors["embedding"].tolist(), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= least).sum() - len(x)
    return float(found["n_links"].sum() / want) if want else 1.0
