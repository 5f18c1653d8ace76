"""Held-out accuracy, and scores of awkward texts."""

from __future__ import annotations

import random
import zlib

from tidewheel.llm import quality, toxicity


def corpus(seed=1, n=900):
    r = random.Random(seed)
    common = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad, toxic = r.random() < 0.25, r.random() < 0.3
        words = [r.choice(common) for _ in range(r.randrange(20, 120))]
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["scumbag", "moronic", "filthy"]))
        text = " | ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, ["en", "de", None][i % 3], 1))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, "en", 1), (n + 1, "", None, 1), (n + 2, " \n", "de", 1), (None, "word1 scumbag", "en", 1), (n + 3, "word2 " * 30_000, "en", 1)]
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"), rows, labels


def rest(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity(spark):
    docs, labels, rows, given = frames(spark)
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (i is not None and rest(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["predicted"], t) for i, _, t in given if rest(i, 5) == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_quality(spark):
    docs, labels, rows, given = frames(spark)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (i is not None and rest(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [(got[i]["predicted"], q) for i, q, _ in given if rest(i, 4) == 2]
    assert sum(p == q for p, q in held) / len(held) > 0.97
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] for r in got.values())


def test_scores_do_not_depend_on_other_columns(spark):
    docs, labels, _, _ = frames(spark)
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.classify(docs.selectExpr("doc_id", "text", "'xx' as lang"), labels).collect()}
    assert a == b


def test_no_labels_and_no_rows(spark):
    docs, labels, rows, _ = frames(spark)
    none = labels.limit(0)
    assert {r["predicted"] for r in quality.classify(docs, none).collect()} == {1}
    assert toxicity.classify(docs, none).count() == len(rows)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0
