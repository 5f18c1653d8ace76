"""Cuts and thresholds come from all rows, whatever their shares."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tidewheel.llm import quality, toxicity


def test_most_documents_are_bad(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 > 0
        words = [f"word{r.randrange(300)}" for _ in range(r.randrange(20, 120))]
        rows.append((i, " | ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + ".", "en"))
        labels.append((i, int(not bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert sum(g["predicted"] == int(g["doc_id"] % 5 == 0) for g in got) > 0.97 * len(rows)
    # a sample of fifty rows fits the weights; the cut still sees all
    got = quality.classify(docs, labels, sample_rows=50).collect()
    assert sum(g["predicted"] == int(g["doc_id"] % 5 == 0) for g in got) > 0.97 * len(rows)


def test_best_cut():
    count = lambda *x: np.array(x)
    assert quality.best_cut(count(-4, 0, 1, 2, 9), count(0, 0, 0, 0, 2), count(3, 3, 0, 0, 0)) == 5.0
    assert quality.best_cut(count(-4, 3), count(1, 1), count(0, 0)) == -4.0
    assert quality.best_cut(count(-4, 3), count(0, 0), count(1, 5)) == 4.0


def test_small_languages_get_thresholds_of_their_own():
    # es is toxic from bin -100 on, the large en only from 100 on; fr has one row and stays with the common threshold
    counts = [("en", 120, 400, 400), ("en", -90, 900, 0), ("en", -300, 900, 0), ("es", -90, 40, 40), ("es", -300, 400, 0), ("fr", -300, 1, 0), (None, -300, 5, 0)]
    common, own = toxicity.thresholds(counts)
    assert set(own) == {"en", "es", "fr"}
    assert own["es"] < 0.2 < 0.5 < own["en"]
    assert own["fr"] == common == own["en"]
    assert toxicity.thresholds([]) == (0.5, {}) == toxicity.thresholds([("en", 3, 5, 0)])


def test_each_language_is_calibrated_on_all_its_labels(spark, monkeypatch):
    r = random.Random(6)
    rows = []
    for i in range(900):
        words = [f"word{r.randrange(200)}" for _ in range(30)]
        if i % 3 == 0:
            words[7] = "scumbag"
        rows.append((i, " ".join(words), "es" if i % 15 < 2 else "en", int(i % 3 == 0)))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows], "doc_id long, toxic int")
    seen, made = [], toxicity.thresholds
    monkeypatch.setattr(toxicity, "thresholds", lambda counts: (seen.extend(counts), made(counts))[1])
    got = toxicity.classify(docs, labels, sample_rows=300).collect()
    # 300 rows train, all others outside the held-out fold calibrate
    assert sum(c[2] for c in seen) == sum(not g["held_out"] for g in got) - 300
    assert {c[0] for c in seen} == {"en", "es"}
    assert sum(g["flagged"] == bool(rows[g["doc_id"]][3]) for g in got) > 0.97 * len(rows)


def test_repeated_ids_are_one_training_row(spark):
    from tidewheel.llm.labelled import training_sample

    docs = spark.createDataFrame([(1, "b", "en"), (1, "a", "en"), (1, "b", "en"), (3, None, None), (None, "x", "en"), (4, "no label", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = training_sample(docs, labels, "toxic", 1, 5, 10).collect()
    assert sorted((r["text"] or "", r["y"]) for r in got) == [("", 0), ("a", 1)]
    assert len(training_sample(docs, labels, "toxic", 1, 5, 1).collect()) == 1


def test_the_order_of_rows_does_not_change_the_toxicity_model(spark):
    words = [f"w{i % 50} w{i % 7} {'scum' if i % 3 == 0 else 'fine'}" for i in range(120)]
    rows = [(t, "en", int(i % 3 == 0)) for i, t in enumerate(words)]
    df = spark.createDataFrame(rows, "text string, lang string, y int")
    a, b = toxicity.fit(df.repartition(5)), toxicity.fit(df.orderBy(F.desc("text")))
    assert np.array_equal(a.out, b.out) and np.array_equal(a.tables, b.tables) and a.base == b.base
