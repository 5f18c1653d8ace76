"""Clustering features: sums of points that merge, folded over partitions, and Ward's tree over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workers import ship
from .graph import materialise

#: Tables of features that one task merges.
FAN = 8
_SCHEMA = "part long, pos int, n long, mean array<double>, ss double, reach double"


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows; both sides are centred first, as large means cost digits."""
    middle = y.mean(0)
    x, y = x - middle, y - middle
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def ward_tree(centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, gone, cost) of all merges: ``gone`` joins the cluster named ``kept`` and raises the sum of squares by cost.

    A nearest-neighbour chain over a matrix of costs: of two clusters that are each other's nearest no later merge can
    part, so they merge at once. Time and memory grow with the square of the centres. Costs never fall from a cluster to
    the one it becomes part of, so those below any limit are a clustering.
    """
    n = np.asarray(sizes, float).copy()
    m = len(n)
    d = squares(centres, centres) * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(d, np.inf)
    there, cost = np.ones(m, bool), np.zeros(m)
    chain: list[int] = []
    merges: list[tuple[int, int, float]] = []
    while len(merges) < m - 1:
        if not chain:
            chain.append(int(there.argmax()))
        a = chain[-1]
        b = int(d[a].argmin())
        if len(chain) < 2 or d[a, chain[-2]] > d[a, b]:
            chain.append(b)
            continue
        b = chain[-2]
        del chain[-2:]
        kept, gone = min(a, b), max(a, b)
        cost[kept] = max(d[a, b], cost[a], cost[b])
        merges.append((kept, gone, cost[kept]))
        both = ((n + n[kept]) * d[kept] + (n + n[gone]) * d[gone] - n * d[a, b]) / (n + n[kept] + n[gone])
        d[kept] = d[:, kept] = both
        d[gone] = d[:, gone] = np.inf
        n[kept] += n[gone]
        there[gone] = False
    kept, gone, costs = zip(*merges, strict=True) if merges else ((), (), ())
    return np.array(kept, int), np.array(gone, int), np.array(costs, float)


def ward_labels(centres: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each weighted centre after Ward's merges down to ``k``, numbered by their first centre."""
    kept, gone, cost = ward_tree(centres, sizes)
    root = np.arange(len(sizes))
    for i in np.argsort(cost, kind="stable")[: max(len(sizes) - max(k, 1), 0)]:
        root[root == root[gone[i]]] = root[kept[i]]
    return np.unique(root, return_inverse=True)[1].reshape(-1)


class Features:
    """At most ``leaves`` features (n, mean, ss), ss the sum of squared distances from the mean.

    While all distinct points fit they stay apart. When they do not, Ward's merges halve the leaves; the median distance
    of the centres merged becomes ``reach``, within which the nearest leaf takes new features in from then on. Sums of
    all leaves are those of all points at any time.
    """

    def __init__(self, leaves: int):
        self.leaves, self.reach = max(leaves, 2), 0.0
        self.n, self.mean, self.ss = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, n: np.ndarray, mean: np.ndarray, ss: np.ndarray, reach: float = 0.0) -> None:
        self.reach = max(self.reach, reach)
        for i in range(0, len(n), self.leaves):
            self._add(n[i : i + self.leaves], mean[i : i + self.leaves] + 0.0, ss[i : i + self.leaves])

    def _add(self, n: np.ndarray, mean: np.ndarray, ss: np.ndarray) -> None:
        held = len(self.n)
        to = held + np.arange(len(n))
        if held and self.reach:
            d = squares(mean, self.mean)
            near = d.argmin(1)
            inside = d[np.arange(len(n)), near] <= self.reach**2
            to = np.where(inside, near, held + np.cumsum(~inside) - 1)
        self.n, self.ss = np.concatenate([self.n, n]), np.concatenate([self.ss, ss])
        self.mean = mean if self.mean is None else np.concatenate([self.mean, mean])
        self._join(np.concatenate([np.arange(held), to]))
        if not self.reach:
            self._join(np.unique(self.mean, axis=0, return_inverse=True)[1].reshape(-1))
        if len(self.n) > self.leaves:
            label = ward_labels(self.mean, self.n, self.leaves // 2)
            apart = self._join(label)
            self.reach = max(self.reach, float(np.median(apart[apart > 0])) if (apart > 0).any() else 0.0)

    def _join(self, label: np.ndarray) -> np.ndarray:
        """Leaves of one label become one; distances of the old centres from the new ones."""
        k = int(label.max()) + 1
        n = np.zeros(k, np.int64)
        np.add.at(n, label, self.n)
        base = self.mean[np.unique(label, return_index=True)[1]]  # equal centres keep theirs to the last bit
        shift = np.zeros(base.shape)
        np.add.at(shift, label, (self.mean - base[label]) * self.n[:, None])
        mean = base + shift / n[:, None]
        away = ((self.mean - mean[label]) ** 2).sum(1)
        self.n, self.ss, self.mean = n, np.bincount(label, self.ss + self.n * away, k), mean
        return np.sqrt(away)

    def frame(self, part: int) -> pd.DataFrame:
        m = len(self.n)
        mean = pd.Series(list(self.mean) if m else [], dtype=object)  # without rows too, or Arrow takes it for numbers
        return pd.DataFrame({"part": np.full(m, part), "pos": np.arange(m, dtype=np.int32), "n": self.n, "mean": mean, "ss": self.ss, "reach": np.full(m, self.reach)})


def clustering_features(points: DataFrame, leaves: int = 1000) -> DataFrame:
    """(n, mean, ss) of points (v), at most ``leaves`` rows: each is a count, a mean and a sum of squared distances from it.

    With at most ``leaves`` distinct points they are those points, however the rows are dealt. Points that are null or hold
    missing or non-finite components are left out; no points give no rows. Each partition folds its rows into features of
    its own, then tasks merge the tables of eight partitions at a time until one is left: what is shuffled is at most
    ``leaves`` rows a partition, and no task holds more than eight times as many.
    """
    ship(points.sparkSession)
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))

    def fold(batches):
        held, part = Features(leaves), 0
        for b in batches:
            if len(b):
                part = int(b.part.iloc[0])
                held.add(np.ones(len(b), np.int64), np.stack(b.v.to_numpy()).astype(float), np.zeros(len(b)))
        yield held.frame(part)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["child", "pos"])
        held = Features(leaves)
        held.add(pdf.n.to_numpy(), np.stack(pdf["mean"].to_numpy()).astype(float), pdf.ss.to_numpy(), float(pdf.reach.max()))
        return held.frame(int(key[0]))

    rows = points.select(F.col("v").cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & finite)
    table = materialise(rows.withColumn("part", F.spark_partition_id().cast("long")).mapInPandas(fold, _SCHEMA), "features")
    while (table.agg(F.max("part")).first()[0] or 0) > 0:
        dealt = table.withColumn("child", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        table = materialise(dealt.groupBy("part").applyInPandas(merge, _SCHEMA), "features")
    return table.select("n", "mean", "ss")
