"""Removed bytes against brute force, and the merge against sorting."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import pytest

from tidewheel.llm import suffix_dedup
from tidewheel.llm.suffix_dedup import common_prefix, cut, dedup, drop_repeats, front_code, merge_runs, read_run


def brute(texts, length):
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


@pytest.mark.parametrize(("length", "hot"), [(400, 20_000), (100, 20_000), (100, 3)])
def test_against_brute_force(docs, rows, length, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 3: nearly all cores are split by offset
    got = Counter(tuple(r) for r in dedup(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text").collect())
    texts = [(r[1] or "").encode() for r in rows]
    assert got == Counter((r[0], *b) for r, b in zip(rows, brute(texts, length), strict=True))


def test_groups_of_copies_and_near_copies(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, shared = [word() for _ in range(80)], " ".join(word() for _ in range(30))
    texts = [" ".join(base)] * 40
    for _ in range(60):
        near = list(base)
        near[r.randrange(80)] = word()
        texts.append(" ".join(near))
    texts += [f"{word()} {word()} {shared} {' '.join(word() for _ in range(r.randrange(40)))}" for _ in range(40)]
    texts += ["ab " * 150, "", "z" * 300]
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    expect = Counter((i % 50, *b) for i, b in enumerate(brute([t.encode() for t in texts], 100)))
    for hot in (20_000, 5):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert Counter(tuple(x) for x in dedup(df, 100).collect()) == expect


def test_a_node_that_is_here_twice_sends_no_places():
    from tidewheel.llm.suffix_dedup import NOWHERE, _flush

    same = [(0, b"rabc", 1, text, text + 5, 2, 3, text + 9) for text in range(6)]
    rows = _flush([*same, (0, b"rabd", 1, 9, 0, 2, 3, 4)], 4).to_pylist()
    run = next(x for x in rows if x["prefix"] is not None)
    assert [int.from_bytes(run["start"][i : i + 8], "little", signed=True) for i in (0, 8)] == [NOWHERE, 0]
    spans = next(x for x in rows if x["prefix"] is None)
    assert len(spans["text"]) == 6 * 8


def test_rows_and_columns_stay(docs):
    out = drop_repeats(docs, 200)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()}[53] == "one"


def test_empty_table(empty):
    assert dedup(empty, 400).count() == 0
    with pytest.raises(ValueError):
        dedup(empty, 10)


def test_merge_of_front_coded_runs():
    r = random.Random(3)
    for _ in range(100):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(15))) for _ in range(r.randrange(8))) for _ in range(r.randrange(7))]
        out = list(merge_runs([read_run(*front_code(x)) for x in runs]))
        assert [s for s, _, _ in out] == sorted(sum(runs, []))
        for (a, _, _), (b, n, _) in zip(out, out[1:], strict=False):
            assert n == len(os.path.commonprefix([a, b]))


def test_known_prefixes_are_not_compared_again():
    a, b = b"x" * 500 + b"a", b"x" * 500 + b"b"
    assert common_prefix(a, b, 400) == 500
    assert common_prefix(b"q" + a[1:], b, 1) == 500


def test_cut():
    assert cut(b"0123456789", [2, 3, 7], [4, 6, 8]) == (b"01689", 5, 2)
    assert cut(b"01", [], []) == (b"01", 0, 0)
