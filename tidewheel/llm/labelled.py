"""Bounded samples of labelled documents for the classifiers that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the labels that are neither null nor contradicted by another row of the same id."""
    return labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).filter("y = other").select("doc_id", "y")


def training_ids(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, apart: int = 0) -> DataFrame:
    """(doc_id, y) of at most ``rows`` labelled documents outside the held-out fold, chosen by a hash of their id.

    An id that several rows of ``docs`` have is one document. With ``apart`` one id in so many, by another hash, is never chosen.
    """
    named = docs.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    if apart:
        named = named.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(apart)) != 0)
    return agreed(labels, label).join(named.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(text, lang, y) of the documents of ``training_ids``."""
    return with_texts(docs, training_ids(docs, labels, label, folds, held_out, rows))


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(text, lang, y), one row for each of the chosen ids, which are few enough to be broadcast; of several texts the least."""
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("d")).select("d.text", "d.lang", "y")
