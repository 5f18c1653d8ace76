"""Clustering, cluster scores and principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components, discard, gathered, materialise, rounds_for, union_find
from ..functions.linear import gram_of
from ..functions.neighbours import nearest
from ..functions.quantiles import exact_quantiles
from ..functions.summaries import clustering_features, squares, ward_labels
from ..plans.workers import ship
from .columns import column_groups, q
from .transforms import fit_scaler

#: Points on either side of a tile, about.
TILE = 2048


def prepare_matrix(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Complete rows of numeric columns, standardised, with a vector column ``features``."""
    cols = cols if cols is not None else column_groups(df).numeric
    rows = df.dropna("any", subset=cols)
    scaled = fit_scaler(rows, cols, "standard").apply(rows)
    return VectorAssembler(inputCols=cols, outputCol="features").transform(scaled), cols


def _fit(df: DataFrame, k: int, seeds: list[int]):
    models = [KMeans(k=k, seed=s, maxIter=50).fit(df) for s in seeds]
    return min(models, key=lambda m: m.summary.trainingCost)


def silhouette(df: DataFrame, prediction: str = "prediction") -> float:
    """Mean squared-Euclidean silhouette, linear in rows; 0 below two clusters."""
    if df.select(prediction).distinct().count() < 2:
        return 0.0
    return ClusteringEvaluator(predictionCol=prediction).evaluate(df.withColumn(prediction, q(prediction).cast("double")))


def silhouette_rows(points: DataFrame) -> DataFrame:
    """(id, cluster, inner, outer, silhouette) of points (id, v, cluster), ids distinct, with Euclidean distances.

    ``inner`` is the mean distance to the others of a point's cluster, ``outer`` the least mean distance to another
    cluster. A cluster of one point has no ``inner`` and silhouette 0; so has every point (without ``outer``) where
    there is one cluster only. Points without a cluster or with missing or non-finite components are left out.

    Exact, so every pair is compared from either side, block by block: work is the square of the points. A tile
    returns one sum for each point and cluster it meets, which Spark adds up by point. Blocks take turns, so that about
    two copies of the points are shuffled at a time, however many blocks there are.
    """
    ship(points.sparkSession)
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    named = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.col("cluster").cast("long").alias("cluster"))
    rows = materialise(named.filter(F.col("cluster").isNotNull() & finite), "points")
    held = rows.count()
    blocks = max(1, -(-held // TILE))
    rounds = min(blocks, rounds_for(2 * held * blocks, held))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    def sides(turn: int) -> DataFrame:
        mine, every = F.explode(F.sequence(F.lit(turn), F.lit(blocks - 1), F.lit(rounds))), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        asked = rows.filter(part % rounds == turn).select(part.alias("i"), every.alias("j"), F.lit(0).alias("side"), "*")
        return asked.unionByName(rows.select(mine.alias("i"), part.alias("j"), F.lit(1).alias("side"), "*"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y = _sides(pdf)
        if not len(a) or not len(b):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "cluster": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "s": np.zeros(0)})
        others, of = np.unique(b.cluster.to_numpy(), return_inverse=True)
        member = np.eye(len(others))[of]
        total = np.zeros((len(a), len(others)))
        step = max(1, 2**22 // (len(y) * x.shape[1]))  # differences, as sums of squares lose near points
        for i in range(0, len(x), step):
            total[i : i + step] = np.sqrt(((x[i : i + step, None] - y[None]) ** 2).sum(2)) @ member
        k = len(others)
        return pd.DataFrame({"id": a.id.to_numpy().repeat(k), "cluster": a.cluster.to_numpy().repeat(k), "other": np.tile(others, len(a)), "s": total.ravel()})

    sizes = materialise(rows.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    own = F.col("other") == F.col("cluster")

    def means_of(turn: int) -> DataFrame:
        found = sides(turn).groupBy("i", "j").applyInPandas(sums, "id long, cluster long, other long, s double").groupBy("id", "cluster", "other").agg(F.sum("s").alias("s"))
        return found.join(sizes, "other").groupBy("id", "cluster").agg(
            F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("inner"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("outer")
        )

    means = gathered((means_of(turn) for turn in range(rounds)), "means")
    discard(rows)
    most = F.greatest("inner", "outer")
    known = F.col("inner").isNotNull() & F.col("outer").isNotNull() & (most > 0)
    return means.withColumn("silhouette", F.when(known, (F.col("outer") - F.col("inner")) / F.when(most > 0, most)).otherwise(0.0))


def scatter_scores(df: DataFrame, cols: list[str], cluster: str = "prediction") -> dict[str, float]:
    """Calinski-Harabasz and Davies-Bouldin from centroids and dispersions by cluster; two aggregations."""
    points = df.select(q(cluster).alias("c"), *[q(c).alias(f"x{i}") for i, c in enumerate(cols)])  # own names, whatever the table's are
    cent = points.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(cols))])
    d2 = sum(((F.col(f"x{i}") - F.col(f"m{i}")) ** 2 for i in range(len(cols))), F.lit(0.0))
    spread = points.join(F.broadcast(cent), "c").groupBy("c").agg(F.sum(d2).alias("ss"), F.avg(F.sqrt(d2)).alias("s"))  # a row a cluster
    rows = cent.join(spread, "c").orderBy("c").collect()
    k, n = len(rows), sum(r["n"] for r in rows)
    if k < 2:
        return {"calinski_harabasz": 0.0, "davies_bouldin": 0.0}
    m = np.array([[r[f"m{i}"] for i in range(len(cols))] for r in rows])
    size, s, ss = (np.array([r[x] for r in rows], float) for x in ("n", "s", "ss"))
    mean = (m * size[:, None]).sum(0) / n
    between = float((size * ((m - mean) ** 2).sum(1)).sum())
    ch = between / (k - 1) / (ss.sum() / (n - k)) if ss.sum() and n > k else 0.0
    dist = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    ratio = np.where(dist > 0, (s[:, None] + s[None]) / np.where(dist > 0, dist, 1), 0)
    return {"calinski_harabasz": float(ch), "davies_bouldin": float(ratio.max(1).mean())}


def kmeans_sweep(df: DataFrame, cols: list[str], ks: range = range(2, 9), seeds: list[int] | None = None) -> tuple[DataFrame, int]:
    """(k, inertia, silhouette, calinski_harabasz, davies_bouldin) and the k of the best silhouette."""
    df = df.persist()
    rows = []
    for k in ks:
        model = _fit(df, k, seeds or [42, 43, 44])
        got = model.transform(df)
        rows.append((k, float(model.summary.trainingCost), float(silhouette(got)), *scatter_scores(got, cols).values()))
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"), best


def kmeans_fit(df: DataFrame, k: int, seeds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with prediction, and (cluster, n, share)."""
    got = _fit(df, k, seeds or [42, 43, 44]).transform(df)
    return got, cluster_sizes(got, "prediction")


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    total = df.count()
    return df.groupBy(q(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.lit(total))


def _projection(dims: int, size: int = 3, seed: int = 9) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, min(size, dims))))[0]


def _tiles(points: DataFrame, reach: float, asks: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Points (id, v, ...) dealt as candidates: (keys, side, id, v, ...), and the keys. Of any two points within ``reach``
    the one meets the other in just one tile as side 0, and the reverse in just one. Only points for which ``asks`` is
    true (all, if not given) are side 0; cells without any are not dealt.

    Cells of side ``reach`` cut an orthonormal projection of at most 3 dimensions. A projection never lengthens
    distances, so neighbours lie in the same or an adjacent cell; both sides of a cell are cut by its counted size.
    """
    dims = points.select(F.size("v")).first()[0]
    p = _projection(dims)
    here = [f"c{a}" for a in range(p.shape[1])]
    axes = [sum((F.get("v", F.lit(i)) * F.lit(float(p[i, a])) for i in range(dims)), F.lit(0.0)) for a in range(p.shape[1])]
    cut = points.select(
        *points.columns,
        (asks if asks is not None else F.lit(True)).alias("asks"),
        *[F.floor(x / F.lit(float(reach) * (1 + 1e-9))).cast("long").alias(c) for c, x in zip(here, axes, strict=True)],
    )
    cells = materialise(cut, "cells")  # projected once, for the counts and both sides

    def around(df: DataFrame) -> DataFrame:
        for c in here:
            df = df.withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("o")).drop("o")
        return df

    count = cells.groupBy(*here).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("h"))
    visits = around(count.drop("h")).groupBy(*here).agg(F.sum("n").alias("n"), F.ceil(F.sum("n") / TILE).cast("int").alias("kv"))
    sizes = count.drop("n").filter("h > 0").withColumn("kh", F.ceil(F.col("h") / TILE).cast("int")).join(visits, here)
    sizes = materialise(sizes, "sizes")
    copies = sizes.agg(F.sum(F.col("h") * F.col("kv").cast("double") + F.col("n") * F.col("kh"))).first()[0] or 0.0
    rounds = rounds_for(copies, cells.count())
    sizes = sizes.drop("n", "h")
    part = lambda k, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    home = cells.filter("asks").join(sizes, here).select(*here, part("kh", 1).alias("i"), every("kv").alias("j"), F.lit(0).alias("side"), *points.columns)
    visit = around(cells).join(sizes, here).select(*here, every("kh").alias("i"), part("kv", 2).alias("j"), F.lit(1).alias("side"), *points.columns)
    tiles = home.unionByName(visit)
    tiles._rounds = rounds
    return tiles, [*here, "i", "j"]


def _over_tiles(tiles: DataFrame, keys: list[str], work, schema: str, name: str, then=lambda found: found, but: list[str] = ()) -> DataFrame:
    """A table of what ``work`` makes of each tile (without columns ``but``) and ``then`` of a round's rows. Rounds shuffle
    about two copies of the points each. All tiles of a part of a cell (the points that ask) are of one round, so rows of a
    point that asked are complete there."""
    rounds = tiles._rounds
    tiles = tiles.drop(*but)
    turn = F.pmod(F.xxhash64(*keys[:-1]), F.lit(rounds))
    return gathered((then(tiles.filter(turn == r).groupBy(*keys).applyInPandas(work, schema)) for r in range(rounds)), name)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def _inside(x: np.ndarray, y: np.ndarray, limit: float):
    """(start, which rows of y lie within ``limit`` of the 512 rows of x from there on). Sums of squares decide
    where they are beyond doubt, differences of the points elsewhere."""
    middle = y.mean(0)
    x0, y0 = x - middle, y - middle
    nx, ny = (x0**2).sum(1), (y0**2).sum(1)
    for i in range(0, len(x), 512):
        size = nx[i : i + 512, None] + ny[None]
        over = size - 2 * x0[i : i + 512] @ y0.T - limit**2
        doubt = 1e-12 * (size + limit**2)
        inside = over < -doubt
        r, c = np.nonzero(np.abs(over) <= doubt)
        for j in range(0, len(r), 65536):
            a, b = r[j : j + 65536], c[j : j + 65536]
            inside[a, b] = np.sqrt(((x[i + a] - y[b]) ** 2).sum(1)) <= limit
        yield i, inside


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
    return a, b, np.array(a.v.tolist(), float), np.array(b.v.tolist(), float)


def _dense_cells(points: DataFrame, limit: float, min_samples: int) -> tuple[DataFrame, DataFrame, float]:
    """Points (id, v, node), dense cells (id, v, cell), and the side of a cell.

    Cells of all dimensions, so small that any two points of one lie within ``limit``: where one holds ``min_samples``
    points all are core and of one cluster, whose node is the least id there. Other points have no node.
    """
    side = limit / float(np.sqrt(points.select(F.size("v")).first()[0])) * (1 - 1e-6)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    gridded = points.withColumn("cell", F.when(finite, F.transform("v", lambda x: F.floor(x / F.lit(side)))))
    held = gridded.filter("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min_by("v", "id").alias("v"), F.min("id").alias("node"))
    exact = F.forall("cell", lambda c: F.abs(c) < 10**9)  # further out the quotient is rounded by too much of a cell
    dense = materialise(held.filter((F.col("n") >= min_samples) & exact).select(F.col("node").alias("id"), "v", "cell"), "dense")
    node = dense.select("cell", F.col("id").alias("node"))
    return materialise(gridded.join(node, "cell", "left").select("id", "v", "node"), "gridded"), dense, side


def _links_of_cells(dense: DataFrame, limit: float, side: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between dense cells whose first points reach each other, and the cells (id) that may reach
    a cell which those links do not join to theirs: only they have to be compared point by point."""

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y = _sides(pdf)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(a) and len(b):
            for i, inside in _inside(x, y, limit):
                r, c = np.nonzero(inside)
                nodes, roots = union_find(a.id.to_numpy()[i + r], b.id.to_numpy()[c])
                left.append(roots)
                right.append(nodes)
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    def open_cells(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y = _sides(pdf)
        found = np.zeros(len(a), bool)
        if len(a) and len(b):
            g, h = np.array(a.cell.tolist(), float), np.array(b.cell.tolist(), float)
            root_a, root_b = a.root.to_numpy(), b.root.to_numpy()
            for i, near in _inside(x, y, 3 * limit):
                r, c = np.nonzero(near & (root_a[i : i + 512, None] != root_b[None]))
                for j in range(0, len(r), 65536):
                    p, o = i + r[j : j + 65536], c[j : j + 65536]
                    gap = np.maximum(np.abs(g[p] - h[o]) - 1, 0) * side
                    found[p[np.sqrt((gap**2).sum(1)) <= limit * (1 + 1e-6)]] = True
        return pd.DataFrame({"id": a.id.to_numpy()[found]})

    if dense.isEmpty():
        none = dense.sparkSession.range(0)
        return none.select(F.col("id").alias("a"), F.col("id").alias("b")), none
    links = _over_tiles(*_tiles(dense.select("id", "v"), limit), linked, "a long, b long", "links", lambda found: found.filter("a <> b").distinct())
    root = components(links).withColumnRenamed("node", "id")
    rooted = dense.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    tiles = _tiles(materialise(rooted, "rooted"), 3 * limit)  # first points of cells that reach each other are at most so far apart
    return links, _over_tiles(*tiles, open_cells, "id long", "open", lambda found: found.distinct())


def dbscan(points: DataFrame, eps: float | None = None, min_samples: int = 5) -> DataFrame:
    """(id, cluster) of points (id, v), ids distinct: -1 is noise; a border point joins the least core cluster within reach.

    No pairs are written. Points of dense cells (``_dense_cells``) are core without being compared. The others count
    their neighbours tile by tile (``_tiles``, a row a point), then each tile returns the forest of its core links
    and, for points that are not core, the fewer than ``min_samples`` core points they reach. Of dense cells only those
    are compared point by point that their first points do not settle. Clusters are components, run until nothing changes.
    """
    ship(points.sparkSession)
    points = points.select(F.col("id").cast("long").alias("id"), "v")
    if points.isEmpty():
        return points.select("id", F.lit(-1).cast("long").alias("cluster"))
    limit = float(eps if eps is not None else auto_eps(points, min_samples))
    if not limit > 0:
        raise ValueError("eps must be above 0")

    def tally(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y = _sides(pdf)
        n = np.zeros(len(a), np.int64)
        if len(a) and len(b):
            for i, inside in _inside(x, y, limit):
                n[i : i + 512] = inside.sum(1)
        return pd.DataFrame({"id": a.id.to_numpy(), "n": n})

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y = _sides(pdf[(pdf.side == 0) | pdf.core])
        empty = np.zeros(0, np.int64)
        links, border = [(empty, empty)], [(empty, empty)]
        if len(a) and len(b):
            core, ids, own, reached = a.core.to_numpy(), a.id.to_numpy(), a.node.to_numpy(), b.node.to_numpy()
            for i, inside in _inside(x, y, limit):
                r, c = np.nonzero(inside)
                of_core = core[i + r]
                links.append(union_find(own[i + r[of_core]], reached[c[of_core]])[::-1])
                border.append((ids[i + r[~of_core]], reached[c[~of_core]]))
        nodes, roots = union_find(*(np.concatenate(s) for s in zip(*links, strict=True)))
        at, to = (np.concatenate(s) for s in zip(*border, strict=True))
        joined = nodes != roots
        return pd.DataFrame({"a": np.concatenate([roots[joined], at]), "b": np.concatenate([nodes[joined], to]), "border": np.arange(joined.sum() + len(at)) >= joined.sum()})

    gridded, dense, side = _dense_cells(points, limit, min_samples)
    summed = lambda found: found.groupBy("id").agg(F.sum("n").alias("n"))
    counts = _over_tiles(*_tiles(gridded, limit, F.col("node").isNull()), tally, "id long, n long", "counts", summed, ["node"])
    core = materialise(counts.filter(F.col("n") >= min_samples).select("id", F.lit(True).alias("counted")), "core")
    links, unsettled = _links_of_cells(dense, limit, side)
    state = gridded.join(core, "id", "left").join(unsettled.select(F.col("id").alias("node"), F.lit(True).alias("again")), "node", "left")
    state = state.select("id", "v", F.coalesce("node", "id").alias("node"), (F.col("node").isNotNull() | F.col("counted").isNotNull()).alias("core"), (F.col("node").isNull() | F.col("again").isNotNull()).alias("ask"))
    state = materialise(state, "state")
    found = _over_tiles(*_tiles(state, limit, F.col("ask")), forest, "a long, b long, border boolean", "forest", lambda found: found.distinct(), ["ask"])
    root = components(links.unionByName(found.filter("not border").select("a", "b")))
    label = root.select("node", F.col("root").alias("label"))
    inner = state.filter("core").select("id", "node").join(label, "node", "left").select("id", F.coalesce("label", "node").alias("cluster"))
    reached = found.filter("border").select(F.col("a").alias("id"), F.col("b").alias("node")).join(label, "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("label"))
    return inner.unionByName(state.filter("not core").select("id").join(reached, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("cluster")))


def auto_eps(points: DataFrame, min_samples: int = 5, sample: int = 2000) -> float:
    """90th percentile of the distance of every point to its (min_samples - 1)-th neighbour.

    The sample only guesses a reach: distances within it are found exactly by the tiles of ``_tiles``, the others
    are larger. The reach doubles until the percentile is among the distances found.
    """
    k, n = min_samples - 1, points.count()
    if k < 1 or n <= k:
        return 1.0
    some = points.orderBy(F.xxhash64("id")).limit(sample)
    near = nearest(points.select("id", "v"), some.select("id", "v"), k, skip_same=True)
    reach = 1.05 * float((exact_quantiles(near.filter(F.col("rank") == k), {"d": F.col("distance")}, [0.9])["d"] or [0.0])[0] or 1.0)
    at = 0.9 * (n - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    for _ in range(64):
        known = _within(points, reach, k)
        if known.count() > high:
            a, b = (order_statistic(known, "d", r) for r in (low, high))
            return a + (b - a) * (at - low) or 1.0
        reach *= 2
    raise ValueError("too few points have as many neighbours of another id")


def _within(points: DataFrame, reach: float, k: int) -> DataFrame:
    """(id, d) of the points whose k-th neighbour lies within ``reach``, at distance d."""

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out = []
        if len(a) and len(b):
            x, y, names, ids = np.array(a.v.tolist(), float), np.array(b.v.tolist(), float), a.id.to_numpy(), b.id.to_numpy()
            for i in range(0, len(x), 512):
                d = _squares(x[i : i + 512], y)
                d[names[i : i + 512, None] == ids[None]] = np.inf
                # some more than k, as sums of squares may misplace those next to each other
                pick = np.argpartition(d, k + 7, axis=1)[:, : k + 8] if d.shape[1] > k + 8 else np.tile(np.arange(d.shape[1]), (len(d), 1))
                exact = np.sqrt(((x[i : i + 512, None] - y[pick]) ** 2).sum(2))
                exact[np.isinf(np.take_along_axis(d, pick, 1))] = np.inf
                out += [r[r <= reach] for r in np.sort(exact, axis=1)[:, :k]]
        return pd.DataFrame({"id": a.id.to_numpy() if out else np.zeros(0, np.int64), "d": pd.Series(out, dtype=object)})

    kth = F.get(F.sort_array(F.flatten(F.collect_list("d"))), F.lit(k - 1))
    return _over_tiles(*_tiles(points, reach), least, "id long, d array<double>", "near", lambda found: found.groupBy("id").agg(kth.alias("d")).filter("d is not null"))


def order_statistic(df: DataFrame, c: str, rank: int, most: int = 10_000) -> float:
    """The value of ``rank`` (from 0) of a column without nulls: counts by bins narrow the range until its values are few."""
    while True:
        n, low, high = df.agg(F.count(c), F.min(c), F.max(c)).first()
        if low == high:
            return float(low)
        if n <= most:
            return float(sorted(r[0] for r in df.select(c).collect())[rank])
        of = F.least(F.floor((q(c) - F.lit(low)) / F.lit((high - low) / 1000)), F.lit(999)).cast("int")
        before = 0
        for b, held in sorted(df.groupBy(of.alias("bin")).count().collect()):
            if before + held > rank:
                break
            before += held
        df, rank = df.filter(of == b), rank - before


def hierarchical(df: DataFrame, k: int, leaves: int = 1000) -> DataFrame:
    """``df`` with prediction, a cluster of Ward's merges down to ``k``, the largest first.

    The merges are those of all points where at most ``leaves`` of them are distinct, else those of clustering features
    (``clustering_features``), which Spark folds; the driver holds the features only. Every row takes the cluster of its
    nearest feature. Rows whose vector is null or has missing or non-finite components have no prediction; with fewer
    distinct points than ``k`` each is a cluster.
    """
    held = clustering_features(df.select(vector_to_array("features").alias("v")), leaves).collect()  # at most ``leaves`` rows
    if not held:
        return df.withColumn("prediction", F.lit(None).cast("int"))
    sizes, centres = np.array([r["n"] for r in held]), np.array([r["mean"] for r in held])
    found = ward_labels(centres, sizes, k)
    rows_of = np.bincount(found, sizes)
    first = np.array([min(map(tuple, centres[found == c])) for c in range(len(rows_of))])
    order = np.lexsort([*first.T[::-1], -rows_of])  # the last key counts first
    label = np.argsort(order)[found]

    @F.pandas_udf("int")
    def nearest_leaf(v: pd.Series) -> pd.Series:
        out = np.full(len(v), -1)
        there = np.array([x is not None and len(x) == centres.shape[1] and np.isfinite(np.asarray(x, float)).all() for x in v], bool)
        at = np.flatnonzero(there)
        for i in range(0, len(at), 4096):
            x = np.stack(v.iloc[at[i : i + 4096]].to_list()).astype(float)
            out[at[i : i + 4096]] = label[squares(x, centres).argmin(1)]
        return pd.Series(out)

    return df.withColumn("prediction", nearest_leaf(vector_to_array("features"))).withColumn("prediction", F.expr("nullif(prediction, -1)"))


def bisecting(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return BisectingKMeans(k=k, seed=seed).fit(df).transform(df)


def pca(df: DataFrame, cols: list[str], most: int = 10) -> tuple[DataFrame, np.ndarray, dict[str, float], dict[str, float]]:
    """(component, variance, ratio, cumulative) of standardised columns (nulls as 0), loadings, and the scaling used."""
    filled = df.select(*[F.coalesce(q(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    s = fit_scaler(filled, cols, "standard")
    x = s.apply(filled)
    d = len(cols)
    g, n = gram_of(x, [q(c) for c in cols])
    g = g / max(n - 1, 1)
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(d)] < 0, -1, 1)
    total = values.sum() or 1.0
    rows = [(i + 1, float(values[i]), float(values[i] / total), float(values[: i + 1].sum() / total)) for i in range(min(most, d))]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, ratio double, cumulative double"), vectors, s.centre, s.spread


def pca_report(df: DataFrame, cols: list[str], most: int = 10) -> DataFrame:
    return pca(df, cols, most)[0]


def pca_project(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """``df`` with pc1..pck, centred first."""
    _, v, centre, spread = pca(df, cols, k)
    z = [(F.coalesce(q(c).cast("double"), F.lit(0.0)) - F.lit(centre[c])) / F.lit(spread[c]) for c in cols]
    return df.withColumns({f"pc{a + 1}": sum((z[i] * F.lit(float(v[i, a])) for i in range(len(cols))), F.lit(0.0)) for a in range(min(k, len(cols)))})


def compare_clusterings(df: DataFrame, cols: list[str], predictions: dict[str, str]) -> DataFrame:
    """(algorithm, clusters, silhouette, calinski_harabasz, davies_bouldin); noise (-1) is left out, below two clusters -1."""
    rows = []
    for name, c in predictions.items():
        some = df.filter(q(c) >= 0)
        k = some.select(c).distinct().count()
        s = (silhouette(some, c), *scatter_scores(some, cols, c).values()) if k > 1 else (-1.0, -1.0, -1.0)
        rows.append((name, k, *map(float, s)))
    return df.sparkSession.createDataFrame(rows, "algorithm string, clusters int, silhouette double, calinski_harabasz double, davies_bouldin double")
