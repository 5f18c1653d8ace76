"""Splits of rows whose keys repeat."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tidewheel.operators import transforms as T


def table(spark, parts, seed):
    data = [(k % 7, f"v{k % 40}", [k % 3, None] if k % 5 else None) for k in range(300)]
    random.Random(seed).shuffle(data)
    return spark.createDataFrame(data, "k long, v string, a array<int>").repartition(parts)


def counted(df):
    return Counter(map(repr, df.collect()))


@pytest.mark.parametrize("stratify", [None, "k"])
def test_rows_of_one_key_are_split_alike_however_they_are_dealt(spark, stratify):
    parts = [T.random_split(table(spark, p, p), ["k"], 0.3, 42, stratify) for p in (1, 6)]
    (train, test), (other_train, other_test) = parts
    assert counted(train) == counted(other_train) and counted(test) == counted(other_test)
    # train of one evaluation and test of another still are the table
    assert counted(train) + counted(other_test) == counted(table(spark, 3, 9))
    if stratify is None:
        assert test.count() == 90


def test_resampling_ranks_repeated_keys_alike(spark):
    for f in (T.random_undersample, T.random_oversample):
        assert counted(f(table(spark, 1, 1), "v", ["k"])) == counted(f(table(spark, 5, 2), "v", ["k"]))
