"""Hits against brute force over word windows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np

from tidewheel.llm import decontaminate
from tidewheel.llm.bytetext import U
from tidewheel.llm.decontaminate import SuffixArray, contamination, drop_contaminated

FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(rows, items, width):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = Counter()
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= got
                    hit.update(range(k, k + n))
        ids = sorted(str(i) for i in found if i is not None)
        out[d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    return out


def items_of(rows):
    text = rows[3][1]
    long = rows[31][1]
    return [(1, " ".join(text.split()[10:30])), (2, "A,b-c"), (3, "nowhere"), (4, None), (5, ""), (2, "A,b-c"), (None, "one"), (7, " ".join(long.split()[-12:])), (8, "日本語 😀"), (9, " ".join(["ab"] * 12))]


def test_against_brute_force(spark, docs, rows, monkeypatch):
    items = items_of(rows)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, key int")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute([(r[0], r[1]) for r in rows], items, 10)
    assert Counter(tuple(r) for r in contamination(docs, bench, 10).select(*names).collect()) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)  # several blocks of the test set
    assert Counter(tuple(r) for r in contamination(docs, bench, 10).select(*names).collect()) == want


def longest(document, item, width):
    """Length and places of the longest common run of words of at least min(width, item) words."""
    d, t = words(document), words(item)
    best = None
    for p in range(len(d)):
        for o in range(len(t)):
            n = 0
            while p + n < len(d) and o + n < len(t) and d[p + n] == t[o + n]:
                n += 1
            if n >= min(width, len(t)) and (best is None or n > best[0]):
                best = (n, p, o)
    return best


def test_longest_matches_and_their_places(spark, docs, rows, monkeypatch):
    items = [i for i in items_of(rows) if i[0] not in (None, 2)] + [(20, " ".join(rows[3][1].split()[:70])), (21, "ab ab ab"), (22, rows[12][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = docs.filter("doc_id in (3, 4, 12, 13, 31, 35, 59, 60, 62)")
    want = {}
    for r in rows:
        if r[0] in (3, 4, 12, 13, 31, 35, 59, 60, 62):
            want[r[0]] = {str(i): n for i, t in items if (n := longest(r[1], t, 10))}
    assert max(n for m in want.values() for n, _, _ in m.values()) > 100
    for block in (1 << 24, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        for r in contamination(some, bench, 10).collect():
            got = {m["item_id"]: m for m in r["matches"]}
            assert {i: m["length"] for i, m in got.items()} == {i: n[0] for i, n in want[r["doc_id"]].items()}
            assert r["longest"] == max((m["length"] for m in r["matches"]), default=0)
            text, by_id = words(next(x[1] for x in rows if x[0] == r["doc_id"])), {str(i): words(t) for i, t in items}
            for i, m in got.items():
                assert text[m["offset"] : m["offset"] + m["length"]] == by_id[i][m["item_offset"] : m["item_offset"] + m["length"]]


def test_affected_rows_go(spark, docs, rows, monkeypatch):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(r[0], r[1]) for r in rows]
    clean = Counter((d, t) for d, t in texts if not any(k[5] for k in brute([(d, t)], items, 10)))
    for block in (1 << 24, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        kept = drop_contaminated(docs, bench, 10)
        assert kept.columns == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == clean


def test_rows_of_one_id_are_judged_by_their_own_text(spark, rows):
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    docs = spark.createDataFrame([(3, rows[3][1], 1), (3, "a clean text", 2), (None, rows[3][1], 3), (None, None, 4)], "doc_id long, text string, `a.b` int")
    assert sorted(r["a.b"] for r in drop_contaminated(docs, bench).collect()) == [2, 4]


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty, none).count() == 0
    assert contamination(docs, none).filter("contaminated").count() == 0


def test_suffix_array_gives_longest_matches():
    text = np.array([5, 3, 5, 3, 9, 5], U)
    array = SuffixArray(text, np.arange(6), np.full(6, 6), 3)
    query = [np.array([5, 9, 7], U), np.array([3, 5, 1], U), np.array([9, 9, 1], U)]
    lo, hi, longest = array.narrow(query, np.array([3, 3, 3]))
    assert longest.tolist() == [3, 2, 0]
    assert sorted(array.places[lo[0] : hi[0]].tolist()) == [2]
