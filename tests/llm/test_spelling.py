"""Words, near words, forms and roots against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from tidewheel.llm import spelling
from tidewheel.llm.spelling import variants

SCHEMA = "doc_id long, text string, word string, block int, n string"


def brute(rows, times=5, every=199, least_length=6, least_count=5):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if doc is not None:
                h = zlib.crc32(f"{doc}:{run}".encode())
                if h % every == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (root(w), form[w], n, len(links[w]), words.get(form[w])) for w, n in words.items()}


def awkward(seed=4):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéÀèstr") for _ in range(r.randrange(6, 10))) for _ in range(40)]

    def edited(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abeéÿ×") + w[i:], w[:i] + r.choice("abeéÉ") + w[i + 1 :], w[1:] + w[:1]])

    pool = stems + [edited(r.choice(stems)) for _ in range(150)]
    pool += [edited(w) for w in pool]
    rows = []
    for d in range(60):
        words = [r.choice(stems)[: r.randrange(5, 20)] if r.random() < 0.7 else r.choice(pool) for _ in range(150)]
        rows.append((d if d % 7 else None, " ".join(w.upper() if r.random() < 0.1 else w for w in words)))
    chain = [(100 + i, "abcdefgh " * 200 + "abcdefgx " * 30 + "abcdefyx " * 6) for i in range(2)]
    long = "x" * 6000
    rows += [*chain, (200, None), (201, ""), (202, "1 2 3 ... \n\t"), (203, f"{long} {long}a {long[1:]} " * 6), (203, rows[1][1]), (203, rows[1][1]), (None, "aaaaaaa " * 7 + "aaaaaa " * 40), (-5, "Straße œuvre naïveté ÷÷÷÷÷÷ ××××××× " * 6)]
    return rows


def found(spark, rows, **given):
    docs = spark.createDataFrame([(d, t, "c", 1, "c") for d, t in rows], SCHEMA)
    return {r["word"]: (r["root"], r["form"], r["n"], r["n_near"], r["form_n"]) for r in variants(docs, **given).collect()}


def test_against_brute_force(spark):
    rows = awkward()
    expected = brute(rows)
    assert sum(v[3] > 0 for v in expected.values()) > 50
    assert any(v[0] != v[1] for v in expected.values() if v[1])  # a chain of forms
    assert found(spark, rows) == expected


def test_blocks_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE_WORDS", 2)
    monkeypatch.setattr(spelling, "TASK_WORDS", 20)
    monkeypatch.setattr(spelling, "GROUPS", 2)
    rows = awkward(5)
    assert found(spark, rows, every=3, times=2, least_count=2) == brute(rows, every=3, times=2, least_count=2)


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_products_find_every_edit_and_only_edits():
    rng = np.random.default_rng(1)
    letters = np.array([*b"abc", 0xE9], np.uint8)
    x, y = letters[rng.integers(0, 4, (1200, 6))], letters[rng.integers(0, 4, (900, 7))]
    for a, b in ((x, x), (x, y)):
        got = {(int(i), int(j)) for p, r in spelling.near_pairs(a, b) for i, j in zip(p, r, strict=True)}
        A, B = [bytes(w) for w in a], [bytes(w) for w in b]
        less = [{w[:k] + w[k + 1 :] for k in range(len(w))} for w in B]
        want = {(i, j) for i, w in enumerate(A) for j, v in enumerate(B) if (w in less[j] if len(v) > len(w) else sum(p != r for p, r in zip(w, v, strict=True)) == 1)}
        assert got == want
