"""Ids against the tokenizer itself, and every sequence gapless and within its limit."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import packing
from tidewheel.llm.packing import WordTokenizer, nnls, pack, patterns, plan_packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbB z\t\n'stdlrevm09_-.,!éÉßñª½ÿ\x1c\x85\xa0İΣσ́一ⅷ😀<|>", max_size=30))
def test_ids_are_those_of_the_tokenizer(text):
    t = _shared()
    assert t.encode([text])[0].tolist() == t.encoder.encode(text, add_special_tokens=False).ids


_held = []


def _shared():
    if not _held:
        _held.append(WordTokenizer(PATH))
    return _held[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAB s't\n'_1.relvmdÉßº\x1c\xa0Ⱥ😀<|", max_size=8), max_size=12))
def test_texts_of_a_block_keep_apart(texts):
    t = _shared()
    ids, sizes = t.encode(texts)
    want = [t.encoder.encode(x, add_special_tokens=False).ids for x in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_every_character_beside_letters_digits_and_apostrophes(tokenizer):
    texts = [f"It{chr(c)}s 'll{chr(c)}{chr(c)}1{chr(c)}'re{chr(c)}'" for c in range(1, 0x400)]
    texts += ["it's 'stop x''s _'s 'rex 'Ve <|endoftext|>a"]
    ids, sizes = tokenizer.encode(texts)
    at = np.cumsum([0, *sizes])
    for t, a, b in zip(texts, at, at[1:], strict=False):
        assert ids[a:b].tolist() == tokenizer.encoder.encode(t, add_special_tokens=False).ids, repr(t)


def test_each_word_of_a_block_is_looked_up_once(monkeypatch):
    asked = []
    find = packing._Memory.find
    monkeypatch.setattr(packing._Memory, "find", lambda self, keys: asked.extend(keys) or find(self, keys))
    t = WordTokenizer(PATH)
    texts = [" ".join(f"{a}{'.,;!'[k % 4]}{b}" for k in range(50)) for a in ("one", "two", "it's") for b in ("Red", "blue", "7")]
    ids, _ = t.encode(texts)
    assert ids.tolist() == [x for text in texts for x in t.encoder.encode(text, add_special_tokens=False).ids]
    assert len(asked) == len(set(asked)) == 11


def test_pieces_and_places(docs, rows, tokenizer):
    limit = 64
    got = pack(docs, PATH, limit).collect()
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encoder.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), limit)):
            piece = np.array(ids[s : s + limit], "<u4")
            want[r[0], k, s, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    of = defaultdict(list)
    for r in got:
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    assert len(of) <= 1.1 * sum(r["length"] for r in got) / limit + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), min_size=1, max_size=40))
def test_plan_places_every_piece_once(histogram):
    plan = plan_packing(histogram, 100, 10, 3)
    fill = defaultdict(list)
    for n, k in histogram.items():
        seq, offset = plan.place(np.full(k, n), np.arange(k))
        for s, o in zip(seq.tolist(), offset.tolist(), strict=True):
            fill[s].append((o, n))
    assert sorted(fill) == list(range(plan.sequences))
    for places in fill.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 100


def test_least_squares_is_non_negative():
    a = np.array([[2.0, 1, 0], [0, 1, 3]])
    x = nnls(a, np.array([4.0, 7.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [4, 7], atol=1e-3)
    assert all(sum(p) == 6 and len(p) <= 3 for p in patterns(6, 3))


def test_empty_table(empty):
    assert pack(empty, PATH, 64).count() == 0
