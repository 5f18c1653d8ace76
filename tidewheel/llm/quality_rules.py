"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations read the bits.

``ledger`` measures each whole text, evaluates every rule on the measurements and stores, beside the measurements, one
long whose bit r says that rule r failed. A policy is a version with a mask of rules that reject alone, a mask of rules
that reject together, and how many of those it forgives; a new policy is another pass over the ledger's
bits and not over the texts. ``ablations`` counts documents by their bits (at most two to the number of rules for a group)
and derives for each rule how many documents it fails, how many it alone rejects and how many more would stay without it.

Defined results: null, empty and blank texts have no words and all measurements 0, so they fail the rule on few words; a text
of any length is measured whole; rows are judged by themselves, so repeated rows repeat their results; an empty table gives an
empty ledger; the documents' columns stay in a struct, so their names never clash with measurements.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workers import map_arrow
from .bytetext import RangeHash, chunks, column_bytes, fold_table, windows, words

#: Words [^\x20\x09-\x0D]+ as they are, without lower-casing.
EXACT = fold_table([0x20, *range(0x09, 0x0E)])
EXACT[65:91] = np.arange(65, 91)
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated.
WINDOW = 3
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "longest_word"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
#: Bytes of letters: a-z, A-Z and all beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _before(flags: np.ndarray) -> np.ndarray:
    """How many are set before each position, and in all."""
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item whether an earlier one of its row is equal, and whether any other is."""
    order = np.lexsort((hashes, rows))  # stable: equal ones stay in their order
    r, h = rows[order], hashes[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    later, some = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order], some[order] = same[:-1], same[:-1] | same[1:]
    return later, some


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of each row's text."""
    n = len(offsets) - 1
    starts, ends, hashes, bounds = words(data, offsets, EXACT)
    in_row = lambda at, flags: np.bincount(at[flags], minlength=n).astype(np.int64)
    inside, points = EXACT[data] != 0, (data & 0xC0) != 0x80
    chars = _before(points)
    row_of_word = np.repeat(np.arange(n), np.diff(bounds))
    word_chars = chars[ends] - chars[starts]
    letters = _before(_LETTER[data])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row_of_word, word_chars)

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    row_of_line = np.sort(np.concatenate([np.arange(n), row_of_break]))
    line_end = np.sort(np.concatenate([breaks, offsets[1:]]))
    filled = _before(inside)
    has_word = filled[line_end] > filled[line_start]
    ls, le, lr = line_start[has_word], line_end[has_word], row_of_line[has_word]
    later, _ = _repeats(lr, RangeHash(data)(ls, le) if len(ls) else np.zeros(0, np.uint64))

    covered = np.zeros(len(hashes), bool)
    grams = windows(hashes, WINDOW)
    own = row_of_word[: len(grams)] == row_of_word[WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
    first = np.flatnonzero(own)
    _, some = _repeats(row_of_word[first], grams[first])
    for k in range(WINDOW):
        covered[first[some] + k] = True
    return {
        "n_words": np.diff(bounds), "word_chars": np.bincount(row_of_word, weights=word_chars, minlength=n).astype(np.int64), "n_symbols": np.diff(_before(_SYMBOL[data])[offsets]),
        "n_lines": np.bincount(lr, minlength=n).astype(np.int64), "n_dup_lines": in_row(lr, later), "n_repeat_words": in_row(row_of_word, covered),
        "n_letter_words": in_row(row_of_word, letters[ends] > letters[starts]), "longest_word": longest,
    }


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger, for good: a rule that changes gets a new bit."""

    bit: int
    name: str
    fails: Callable[[], Column]


RULES = [
    Rule(0, "few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule(2, "word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
    Rule(3, "symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule(4, "repeated_lines", lambda: 100 * F.col("n_dup_lines") > 40 * F.col("n_lines")),
    Rule(5, "few_letters", lambda: 100 * F.col("n_letter_words") < 70 * F.col("n_words")),
    Rule(6, "endless_word", lambda: F.col("longest_word") > 1000),
]


def mask(*names: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


BASE = mask("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Rejects on any rule of ``hard``, or on more than ``forgiven`` rules of ``soft``."""

    version: int
    hard: int
    soft: int = 0
    forgiven: int = 0

    def rejects(self, failed: Column) -> Column:
        soft = F.bit_count(failed.bitwiseAND(F.lit(self.soft))) > self.forgiven
        return (failed.bitwiseAND(F.lit(self.hard)) != 0) | soft


POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, BASE | mask("word_length", "symbols", "repeated_lines", "few_letters")),
    3: Policy(3, BASE | mask("symbols", "few_letters"), mask("word_length", "repeated_lines", "endless_word"), 1),
}
CURRENT = 2


def _measured(batches):
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        parts = [measure(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]) for s, e in chunks(offsets)]
        if parts:
            columns = [pa.array(np.concatenate([p[m] for p in parts])) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", *MEASURES])


def ledger(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(doc, measurements, failed): ``doc`` holds the given columns of the documents, all by default."""
    columns = docs.columns if columns is None else columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    found = map_arrow(rows, _measured, ", ".join([f"doc {kind}", *[f"{m} long" for m in MEASURES]]))
    bits = [F.when(r.fails(), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return found.withColumn("failed", failed)


def judged(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with kept, by a policy."""
    return entries.withColumn("kept", ~POLICIES[version].rejects(F.col("failed")))


def keep(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    return judged(ledger(docs), version).filter("kept").select("doc.*")


def ablations(entries: DataFrame, version: int = CURRENT, by: list[str] = ()) -> DataFrame:
    """(by, rule, docs, failing, alone, rejected, rejected_without, ever, always) for each rule of a policy.

    ``by`` names fields of ``doc``. alone: documents that fail no other rule of the policy. rejected_without: rejected by the
    policy less this rule. ever and always: the bits that some, or all, documents of the group fail.
    Documents are counted by bits before anything else, so a group of any size is a few rows a task.
    """
    policy = POLICIES[version]
    failed = F.col("failed")
    group = F.struct(*[F.col(f"doc.`{c}`").alias(c) for c in by]) if by else F.lit(0)
    counts = entries.groupBy(group.alias("of"), "failed").agg(F.count(F.lit(1)).alias("k"))

    def cell(r: Rule) -> Column:
        less = Policy(version, policy.hard & ~(1 << r.bit), policy.soft & ~(1 << r.bit), policy.forgiven)
        own, all_bits = F.lit(1 << r.bit), F.lit(policy.hard | policy.soft)
        n = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
        return F.struct(
            F.lit(r.name).alias("rule"), F.sum("k").alias("docs"), n(failed.bitwiseAND(own) != 0).alias("failing"), n(failed.bitwiseAND(all_bits) == own).alias("alone"),
            n(policy.rejects(failed)).alias("rejected"), n(less.rejects(failed)).alias("rejected_without"), F.bit_or("failed").alias("ever"), F.bit_and("failed").alias("always"),
        )

    used = [r for r in RULES if (policy.hard | policy.soft) >> r.bit & 1]
    cells = counts.groupBy("of").agg(F.array(*[cell(r) for r in used]).alias("cells")).select("of", F.explode("cells").alias("c"))
    return cells.select(*[F.col(f"of.`{c}`") for c in by], "c.*")
