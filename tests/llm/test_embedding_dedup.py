"""Links and components against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from tidewheel.llm import embedding_dedup
from tidewheel.llm.embedding_dedup import link_vectors, spherical_kmeans


def awkward():
    rng = np.random.default_rng(2)
    x = [list(map(float, v)) for v in rng.normal(size=(300, 16))]
    near = [list(map(float, np.array(x[i % 20]) + rng.normal(scale=0.15, size=16))) for i in range(200)]
    rows = list(enumerate([*x, *near]))
    rows += [(900, x[0]), (901, [2 * c for c in x[0]]), (902, None), (903, [0.0] * 16), (904, [float("nan"), *x[1][1:]]), (905, [float("inf"), *x[1][1:]]), (906, [None, *x[1][1:]]), (907, []), (907, x[5]), (908, [1.0, 0.0]), (909, [3.0, 0.1]), (None, x[3]), (910, [1e-200] * 16), (911, [1e200] * 16)]
    return rows


def brute(rows, least):
    unit = []
    for _, v in rows:
        ok = v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        a = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(a / np.linalg.norm(a) if ok else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    out, seen = Counter(), {}
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            name = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, name)
    for i in range(n):
        out[rows[i][0], len(links[i]), seen[i]] += 1
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_POINTS", 40)
    monkeypatch.setattr(embedding_dedup, "TILE", 256)
    rows = awkward()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cell int")
    got = link_vectors(df, 0.9).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows, 0.9)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["component_id"] is not None)


def test_recall_on_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(400)
    noisy = df.selectExpr("vec_id", "embedding").union(df.selectExpr("vec_id + 100000", "transform(embedding, (e, i) -> cast(e + 0.04 * sin(vec_id * 64 + i) as float))"))
    rows = [(r[0], list(map(float, r[1]))) for r in noisy.collect()]
    want = brute(rows, 0.9)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in link_vectors(noisy, 0.9).collect())
    assert sum((got & want).values()) >= 0.99 * len(rows)


def test_empty_table(spark):
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_centroids_are_unit_vectors():
    x = np.random.default_rng(1).normal(size=(200, 4))
    c = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), 7)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
