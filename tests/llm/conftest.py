"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, token string, `begin` int"


def awkward_rows() -> list[tuple]:
    r = random.Random(1)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows: list[tuple[int | None, str | None]] = []

    def edited(k: int) -> str:
        words = list(base)
        for _ in range(k):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        return " ".join(words)

    for i in range(30):
        rows.append((i, edited(i % 6)))
    passage = " ".join(r.choice(vocabulary) for _ in range(90))
    for i in range(30, 40):
        rows.append((i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 60))) + " " + passage + " " + " ".join(r.choice(vocabulary) for _ in range(20))))
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one"), (54, "One"), (55, "a b c"), (56, "a b c"), (57, "a b c d"), (58, "x" * 1500), (59, "ab " * 600)]
    rows += [(60, " ".join(r.choice(vocabulary) for _ in range(6000))), (None, edited(0)), (None, "only here and nowhere else at all"), (61, "same row twice in this table"), (61, "same row twice in this table"), (62, "Straße naïve 日本語 😀 ½ ² 'll <|endoftext|> x́")]
    return [(d, t, "en" if (d or 0) % 2 else None, None, None, 7, "t", 1) for d, t in rows]


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
