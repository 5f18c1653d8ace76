"""Exact round trips of formatted conversations."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from tidewheel.llm import chat
from tidewheel.llm.chat import digests, format_chats, parse_chats

SCHEMA = "conv_id long, turn long, role string, text string, turns int, formatted string"


def awkward():
    r = random.Random(5)
    parts = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<", "|", "\\", "\n", "<\\|", "é😀", "$1", "assistant", " ", "%0A", ""]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "a\n<|b", None]), "".join(r.choice(parts) for _ in range(r.randrange(8)))) for c in range(60) for t in range(r.randrange(1, 7))]
    return [*rows, (None, None, "assistant", None), (100, 1, "assistant", "tie"), (100, 1, "assistant", "tie"), (100, 1, "assistant", "a tie"), (101, 0, "user", "x" * 50_000)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("chunk,cut", [(256, 1024), (1, 1), (2, 3)])
def test_every_turn_comes_back(spark, monkeypatch, chunk, cut):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    monkeypatch.setattr(chat, "CUT", cut)
    rows = awkward()
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA)
    of = defaultdict(list)
    for c, t, role, text in rows:
        of[c].append((-1 if t is None else t, role or "", text or ""))
    formatted = format_chats(df)
    read = {r["conv_id"]: r for r in parse_chats(formatted).collect()}
    got = {r["conv_id"]: r for r in digests(formatted).collect()}
    assert set(read) == set(of)
    for c, turns in of.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in read[c]["turns"]] == [(role, text) for _, role, text in turns]
        loss = [text for _, role, text in turns if role == "assistant"]
        assert read[c]["loss_texts"] == loss
        assert got[c]["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len("".join(loss)), digest("".join(loss)))


def test_adjacent_turns_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert format_chats(df).first()["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_chunks_do_not_show(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "f") for r in awkward()], SCHEMA)
    whole = {r["conv_id"]: (r["formatted"], r["loss_spans"]) for r in format_chats(df).collect()}
    monkeypatch.setattr(chat, "CHUNK", 2)
    assert {r["conv_id"]: (r["formatted"], r["loss_spans"]) for r in format_chats(df).collect()} == whole


def test_long_conversation(spark):
    df = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('text é ', id) as text")
    got = digests(format_chats(df)).first()
    assert got["n_turns"] == 20_000
    assert got["loss_sha256"] == digest("".join(f"text é {i}" for i in range(20_000) if i % 3))


def test_no_python_on_the_executors(spark):
    df = spark.createDataFrame([], SCHEMA)
    plan = digests(format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert digests(format_chats(df)).count() == 0
