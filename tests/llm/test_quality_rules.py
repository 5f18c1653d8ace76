"""Measurements, policies and ablations against plain loops."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import quality_rules as R
from tidewheel.llm.bytetext import column_bytes

WORD = "[^\x20\x09-\x0d]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit), "n_letter_words": sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words), "longest_word": max(map(len, words), default=0),
    }


def fails(m):
    return [m["n_words"] < 50, m["n_repeat_words"] * 2 > m["n_words"], not 2 * m["n_words"] <= m["word_chars"] <= 12 * m["n_words"], m["n_symbols"] * 10 > m["n_words"], 100 * m["n_dup_lines"] > 40 * m["n_lines"], 100 * m["n_letter_words"] < 70 * m["n_words"], m["longest_word"] > 1000]


def policy(version, f):
    if version == 1:
        return any(f[:2])
    if version == 2:
        return any(f[:6])
    return f[0] or f[1] or f[3] or f[5] or f[2] + f[4] + f[6] > 1


def texts(rows):
    extra = ["a a a a", "a\n\na\n b\nb\r\nb\r\na", "\n".join(["same line here"] * 40), " ".join(f"w{i}" for i in range(60)), "# $ % " * 60, " ".join(f"x{i}" for i in range(80)) + " " + "y" * 1500, "1 2 3 4 5 " * 3 + " ".join(map(str, range(100))), "A b\x00c a B\x00C", "a " * 60]
    return [*rows, *[(1000 + i, t) for i, t in enumerate(extra)]]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 5, True) for d, t in rows], "doc_id long, text string, failed string, n_words int, kept boolean")


def test_against_plain_loops(spark, rows):
    given_rows = texts([(r[0], r[1]) for r in rows])
    entries = R.ledger(frame(spark, given_rows))
    for version in R.POLICIES:
        got = Counter((r["doc"]["doc_id"], *[r[m] for m in R.MEASURES], r["failed"], r["kept"]) for r in R.judged(entries, version).collect())
        want = Counter()
        for d, t in given_rows:
            m = plain(t)
            f = fails(m)
            want[d, *[m[k] for k in R.MEASURES], sum(1 << i for i, x in enumerate(f) if x), not policy(version, f)] += 1
        assert got == want


def test_ablations_count_what_policies_would_do(spark, rows):
    given_rows = texts([(r[0], r[1]) for r in rows])
    entries = R.ledger(frame(spark, given_rows), ["doc_id", "failed"])
    all_fails = [fails(plain(t)) for _, t in given_rows]
    bits = [sum(1 << i for i, x in enumerate(f) if x) for f in all_fails]
    for version, used in ((2, range(6)), (3, range(7))):
        got = {r["rule"]: r for r in R.ablations(entries, version, ["failed"]).collect()}
        assert list(got) == [R.RULES[i].name for i in used]
        for i in used:
            less = [[x and k != i for k, x in enumerate(f)] for f in all_fails]
            r = got[R.RULES[i].name]
            assert r["docs"] == len(given_rows) and r["failing"] == sum(f[i] for f in all_fails)
            assert r["alone"] == sum(f[i] and sum(f[k] for k in used) == 1 for f in all_fails)
            assert r["rejected"] == sum(policy(version, f) for f in all_fails)
            assert r["rejected_without"] == sum(policy(version, f) for f in less)
            assert r["ever"] == int(np.bitwise_or.reduce(bits)) and r["always"] == int(np.bitwise_and.reduce(bits))


def test_empty_table_and_kept_rows(spark):
    assert R.ledger(frame(spark, [])).count() == 0
    assert R.ablations(R.ledger(frame(spark, [])), by=["doc_id"]).count() == 0
    good = " ".join(f"word{i}" for i in range(70))
    kept = R.keep(frame(spark, [(1, good), (1, good), (2, None), (3, "")])).collect()
    assert [tuple(r) for r in kept] == [(1, good, "en", 5, True)] * 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\r#é\x00日", max_size=40), max_size=6))
def test_any_texts(found):
    import pyarrow as pa

    data, offsets = column_bytes(pa.array(found, pa.string()))
    got = R.measure(data, offsets)
    for i, t in enumerate(found):
        assert {m: int(got[m][i]) for m in R.MEASURES} == plain(t)
