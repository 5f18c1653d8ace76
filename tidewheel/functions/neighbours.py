"""Nearest neighbours: points in rings around pivots, of which a query visits those its bounds cannot rule out."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workers import map_arrow, ship
from .graph import gathered, materialise, rounds_for

#: Rows of a block on either side.
BLOCK = 2048
#: Pivots at most, rings of a pivot, and points that pivots are chosen from, about: they bound what the driver holds.
PIVOTS, RINGS, SAMPLE = 256, 16, 4096


def _k_best(x: np.ndarray, ids: np.ndarray, y: np.ndarray, names: np.ndarray, k: int, skip_same: bool):
    """(query rows, point rows, distances) of the k nearest x of each y by (distance, id). Sums of squares only choose
    candidates; distances are of differences, so that any two blocks give a pair the same."""
    middle = x.mean(0)
    x0, y0 = x - middle, y - middle
    nx, ny = (x0**2).sum(1), (y0**2).sum(1)
    for i in range(0, len(y), 256):
        size = ny[i : i + 256, None] + nx[None]
        d = size - 2 * y0[i : i + 256] @ x0.T
        if skip_same:
            d[names[i : i + 256, None] == ids[None]] = np.inf
        least = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        r, c = np.nonzero(np.isfinite(d) & (d <= least[:, None] + 2e-12 * size + 2e-12 * size.max(1, keepdims=True)))
        far = np.concatenate([np.sqrt(((y[i + r[j : j + 65536]] - x[c[j : j + 65536]]) ** 2).sum(1)) for j in range(0, len(r), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[c], far, r))
        r, c, far = r[order], c[order], far[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield i + r[keep], c[keep], far[keep]


def _compared(blocks: DataFrame, keys: list[str], k: int, skip_same: bool) -> DataFrame:
    """(query, point, distance) of the k best of each block of (keys, side, id, v): points are side 0, queries side 1."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(a) and len(b):
            ids, names = a.id.to_numpy(), b.id.to_numpy()
            best = _k_best(np.array(a.v.tolist(), float), ids, np.array(b.v.tolist(), float), names, k, skip_same)
            found += [(names[r], ids[c], far) for r, c, far in best]
        query, point, distance = (np.concatenate(s) for s in zip(*found, strict=True))
        return pd.DataFrame({"query": query, "point": point, "distance": distance})

    return blocks.groupBy(*keys).applyInPandas(compare, "query long, point long, distance double")


def _part(k: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), k).cast("int")


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([np.sqrt(((x[i : i + 64, None] - pivots[None]) ** 2).sum(2)) for i in range(0, len(x), 64)] or [np.zeros((0, len(pivots)))])


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pivots(points: DataFrame, n: int) -> np.ndarray:
    """Centres that spread over a bounded sample: they decide how much is compared, never what is found."""
    some = points.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, n // SAMPLE))) == 0).select("v").limit(2 * SAMPLE).collect()
    x = np.array([r[0] for r in some] or [points.first()["v"]], float)
    rng = np.random.default_rng(5)
    chosen = [x[rng.integers(len(x))]]
    apart = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, 4 * -(-n // BLOCK)) and apart.max() > 0:
        chosen.append(x[rng.choice(len(x), p=apart / apart.sum())])
        apart = np.minimum(apart, ((x - chosen[-1]) ** 2).sum(1))
    pivots = np.array(chosen)
    for _ in range(5):
        home = _distances(x, pivots).argmin(1)
        pivots = np.array([x[home == p].mean(0) if (home == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def _ringed(points: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Points (id, v, cell), and by cell their number and least and largest distance from its pivot. A cell is a ring:
    the points of a pivot between two of its distances' quantiles."""
    dims = pivots.shape[1]

    def homes(batches):
        for batch in batches:
            d = _distances(_vectors(batch.column(1), dims), pivots)
            home = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], names=["id", "v", "pivot", "r"])

    housed = materialise(map_arrow(points, homes, "id long, v array<double>, pivot int, r double"), "housed")
    shares = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    bounds = housed.groupBy("pivot").agg(F.percentile_approx("r", shares, 1000).alias("bounds"))
    ring = F.size(F.filter("bounds", lambda b: b < F.col("r")))
    rows = housed.join(F.broadcast(bounds), "pivot").select("id", "v", (F.col("pivot") * RINGS + ring).cast("int").alias("cell"), "r")  # a row a pivot
    count, low, high = np.zeros(len(pivots) * RINGS, np.int64), np.full(len(pivots) * RINGS, np.inf), np.full(len(pivots) * RINGS, np.inf)
    for c in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect():
        count[c["cell"]], low[c["cell"]], high[c["cell"]] = c["n"], c["low"], c["high"]
    return materialise(rows.drop("r"), "ringed"), count, low, high


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "point"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _visited(rows: DataFrame, asks: DataFrame, count: np.ndarray, k: int, skip_same: bool, pairs: list[int] | None) -> DataFrame:
    """The k best of each query of ``asks`` (id, v, cells) in the cells it visits; both sides of a cell are cut by counts.
    Queries take turns, so that what is shuffled at a time does not grow with the cells a query visits."""
    spark = rows.sparkSession
    held = {r["cell"]: r["n"] for r in asks.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if pairs is not None:
        pairs.append(int(sum(n * count[c] for c, n in held.items())))
    blocks = {c: (-(-int(count[c]) // BLOCK), -(-n // BLOCK)) for c, n in held.items()}
    rounds = rounds_for(sum(int(count[c]) * nq + held[c] * np_ for c, (np_, nq) in blocks.items()), int(count.sum()) + asks.count())
    parts = F.broadcast(spark.createDataFrame([(int(c), np_, -(-held[c] // (BLOCK * rounds))) for c, (np_, _) in blocks.items()], "cell int, np int, nq int"))  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def best(turn: int) -> DataFrame:
        visits = asks.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(rounds)) == turn).select("id", "v", F.explode("cells").alias("cell"))
        p = rows.join(parts, "cell").select("cell", _part(F.col("np"), 1).alias("pb"), every("nq").alias("qb"), F.lit(0).alias("side"), "id", "v")
        s = visits.join(parts, "cell").select("cell", every("np").alias("pb"), _part(F.col("nq"), 2).alias("qb"), F.lit(1).alias("side"), "id", "v")
        return _ranked(_compared(p.unionByName(s), ["cell", "pb", "qb"], k, skip_same), k).drop("rank")

    return gathered((best(turn) for turn in range(rounds)), "near")


def nearest(points: DataFrame, queries: DataFrame, k: int, skip_same: bool = False, pairs: list[int] | None = None) -> DataFrame:
    """(query, point, distance, rank) of the k nearest ``points`` (id, v) of each of ``queries`` (id, v), ties by id.

    Exact. Points lie in rings around pivots. A query first visits the nearest rings that hold enough points; the k-th
    distance found there rules out, by the triangle inequality, the rings that lie further off, and it visits all others.
    Vectors with missing or non-finite components are neighbours of nothing. Where nothing can be ruled out (no
    structure, many dimensions) all blocks are compared. ``pairs`` gets the number of pairs compared in either round.
    """
    ship(points.sparkSession)
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    points, queries = (d.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter(finite) for d in (points, queries))
    ranked = lambda found: _ranked(found, k)
    n = points.count()
    if n <= BLOCK:  # one block of points
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // BLOCK)))).cast("int")
        asked = queries.withColumn("qb", block)
        some = points.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-queries.count() // BLOCK) - 1)))))
        return ranked(_compared(some.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1))), ["qb"], k, skip_same))
    pivots = _pivots(points, n)
    rows, count, low, high = _ringed(points, pivots)
    full = np.nonzero(count)[0]
    of, sizes, low, high = full // RINGS, count[full], low[full], high[full]
    dims = pivots.shape[1]

    def least(x: np.ndarray) -> np.ndarray:
        d = _distances(x, pivots)[:, of]
        return np.maximum(np.maximum(d - high, low - d), 0)

    def first(batches):
        for batch in batches:
            lower = least(_vectors(batch.column(1), dims))
            order = np.argsort(lower, axis=1, kind="stable")
            enough = 1 + (np.cumsum(sizes[order], axis=1) < k + int(skip_same)).sum(1)
            cells = pa.array([full[o[:e]].astype(np.int32) for o, e in zip(order, enough, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], names=["id", "v", "cells"])

    def others(batches):
        for batch in batches:
            lower = least(_vectors(batch.column(1), dims))
            reach = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
            near = lower <= (reach * (1 + 1e-9) + 1e-9 * np.abs(lower).max(initial=0) + 1e-12)[:, None]
            cells = []
            for seen, at in zip(batch.column(2).to_pylist(), near, strict=True):
                cells.append(np.setdiff1d(full[at], seen).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32()))], names=["id", "v", "cells"])

    asked = materialise(map_arrow(queries, first, "id long, v array<double>, cells array<int>"), "asked")
    found = _visited(rows, asked, count, k, skip_same, pairs)
    reach = ranked(found).filter(F.col("rank") == k).select(F.col("query").alias("id"), F.col("distance").alias("reach"))
    again = materialise(map_arrow(asked.join(reach, "id", "left").select("id", "v", "cells", "reach"), others, "id long, v array<double>, cells array<int>"), "again")
    return ranked(found.unionByName(_visited(rows, again, count, k, skip_same, pairs)))
