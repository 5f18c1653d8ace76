"""Trees, proofs and folded roots against a plain recursion."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from tidewheel.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, digest string, grp string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lower(text):
    return text and "".join(c.lower() if c.isascii() else c for c in text)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        s = i // 8 * 8
        out.append((nodes[s:i], nodes[i + 1 : s + 8]))
        i //= 8
    return out


def brute(rows):
    first = lambda x: (x is not None, x)
    groups = {}
    for d, t, lang, source, n in rows:
        leaf = H(*map(enc, (d, source, lang, n, t)))
        other = H(*map(enc, (d, source, lang, n, lower(t)))) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf
        groups.setdefault(lang, []).append((first(d), leaf, d, other))
    trees = {g: tree([x[1] for x in sorted(v)]) for g, v in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        for i, (_, leaf, d, other) in enumerate(sorted(groups[g])):
            steps = path(trees[g], i) + path(top, k)
            folded = other
            for a, b in steps:
                folded = H(*a, folded, *b)
            out[d, leaf, trees[g][-1][0], top[-1][0], H(*[x for a, b in steps for x in [*a, *b]]), folded, folded == top[-1][0]] += 1
    return out


def run(spark, rows, **given):
    docs = spark.createDataFrame([(*r, 3, "x", "y") for r in rows], SCHEMA)
    return Counter(tuple(r) for r in merkle.verified(docs, **given).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def awkward():
    rows = [(i, f"Text {i} É ß" if i % 5 else None, "en" if i % 3 else "de", f"s{i % 4}" if i % 7 else None, i if i % 2 else None) for i in range(700)]
    rows += [(i, "Only lower" if i % 2 else "", lang, None, 5) for i, lang in enumerate([None, None, "fr", "", "日本", "日本", "zz", "Zz", "é", "a", "b", "c"])]
    rows += [(77, "Same Row", "en", "s", 8)] * 90 + [(None, "No id", "en", "s", 5)] * 2 + [(1, "Other text of one id", "en", "s", 1)]
    return rows


def test_against_a_plain_recursion(spark):
    rows = awkward()
    expected = brute(rows)
    assert 100 < sum(n for k, n in expected.items() if not k[-1]) < 400
    assert run(spark, rows) == expected


@pytest.mark.parametrize("step", [1, 2])
def test_any_distance_of_checkpoints(spark, step):
    rows = awkward()[:150]
    assert run(spark, rows, step=step) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_small_trees(spark, n):
    rows = [(i, "Aa", None, "s", 2) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_heights():
    for n in [1, 2, 8, 9, 64, 65, 512, 513]:
        assert merkle.height(n) == len(tree([str(i) for i in range(n)])) - 1
