"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are counted with pre-aggregation. A word's letter counts, summed by a few groups of letters, name its
block; one inserted, deleted or replaced letter moves a word to one of a few neighbouring blocks, of its own length or
the next. Each pair of neighbouring blocks is cut into tiles of bounded words and bytes. In a task, a NumPy product of
the tiles' letter counts gives squared distances; pairs at most two apart are verified letter by letter. A tile gives
one row for each word that has a near word in it, with their number and the best, so pairs are never emitted.

The number of pairs compared grows with the square of a block's words, that is, with the vocabulary and not with the text; the
blocks make it a small share of all pairs. Letters are the code points of ``LETTERS``.

Defined results: a null text has no words; a null id alters no word; repeated rows count again; a word without near
words has n_near 0, no form and itself as root; ties of the best near word go to the smallest in code-point order; an empty
table gives no rows. Other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workers import map_arrow
from .shared import materialise

#: Runs of letters that count as words.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of words after lower-casing A-Z.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
#: Groups of letters whose counts name a block.
GROUPS = 6
#: Words and bytes of a tile, on the average; rows of a strip of a product; bytes of letters verified at once.
TILE_WORDS, TILE_BYTES, STRIP, VERIFY_BYTES = 2048, 4 << 20, 512, 8 << 20
#: Words of the vocabulary to a task: a given number of tasks, because few bytes hold much work.
TASK_WORDS = 10_000
#: Length up to which float32 holds every product of counts exactly.
FLOAT32_LENGTH = 4000
_PLACE = np.full(256, -1, np.int64)
_PLACE[LETTERS] = np.arange(len(LETTERS))


def altered_words(docs: DataFrame, every: int = 199) -> DataFrame:
    """(word): every run of letters, A-Z lower-cased; where ``every`` divides the crc32 of id and run, less one letter."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): words of enough letters and occurrences."""
    long = words.filter(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """Letters dealt to groups of about equal use over all words, the commonest first; only their number of uses is collected."""
    uses = words.select([F.sum((F.length("word") - F.length(F.translate("word", chr(c), ""))).cast("long")).alias(str(c)) for c in LETTERS]).first()
    dealt, load = [""] * groups, [0] * groups
    for c in sorted(LETTERS, key=lambda c: (-(uses[str(c)] or 0), c)):
        g = min(range(groups), key=lambda g: (load[g], g))
        dealt[g] += chr(c)
        load[g] += uses[str(c)] or 0
    return dealt


def moves(groups: int) -> list[list[int]]:
    """What one edit does to the counts by group: nothing, one more, or one from a group to another."""
    unit = np.eye(groups, dtype=int)
    out = [np.zeros(groups, int), *unit, *[unit[j] - unit[i] for i in range(groups) for j in range(groups) if i != j]]
    return [m.tolist() for m in out]


def tiles_of(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / TILE_WORDS), F.ceil(size / TILE_BYTES)).cast("int")


def tile_rows(words: DataFrame, groups: list[str]) -> DataFrame:
    """(a, b, i, j, side, word, n): every word in each tile pair that it takes part in; blocks a <= b, and i <= j within one block."""
    k = len(groups)
    counts = F.array(*[(F.length("word") - F.length(F.translate("word", g, ""))).cast("int") for g in groups])
    named = words.withColumn("block", counts)
    blocks = named.groupBy("block").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("size"))
    blocks = blocks.select("block", tiles_of(F.col("words"), F.col("size")).alias("tiles"))
    ways = moves(k)
    every = ways + [[-x for x in m] for m in ways[1 : k + 1]]  # one less, too; exchanges are their own opposites
    near = [F.array(*[F.get("block", i) + F.lit(m[i]) for i in range(k)]) for m in every]
    own = blocks.select(F.col("block").alias("own"), F.col("tiles").alias("own_tiles"))
    pairs = blocks.select("block", "tiles", F.explode(F.array(*near)).alias("other"))
    pairs = pairs.join(own.withColumnRenamed("own", "other").withColumnRenamed("own_tiles", "other_tiles"), "other")
    dealt = named.join(pairs, "block").withColumn("t", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    same = F.col("block") == F.col("other")
    dealt = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    left = F.when(same, F.col("t") <= F.col("u")).otherwise(F.col("block") < F.col("other"))
    return dealt.select(
        F.when(left, F.col("block")).otherwise(F.col("other")).alias("a"), F.when(left, F.col("other")).otherwise(F.col("block")).alias("b"),
        F.when(left, F.col("t")).otherwise(F.col("u")).alias("i"), F.when(left, F.col("u")).otherwise(F.col("t")).alias("j"),
        F.when(left, 0).otherwise(1).alias("side"), "word", "n",
    )


def letters_of(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of bytes (every letter is one byte of Latin-1)."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    n, length = letters.shape
    cells = (np.arange(n)[:, None] * len(LETTERS) + _PLACE[letters]).ravel()
    kind = np.float32 if length <= FLOAT32_LENGTH else np.float64
    return np.bincount(cells, minlength=n * len(LETTERS)).reshape(n, len(LETTERS)).astype(kind)


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether row r of x becomes row r of y by one replaced letter, or by one letter more in y."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    ahead = np.cumprod(x == y[:, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    behind = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return ahead + behind >= x.shape[1]


def near_pairs(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers in x and y of words one edit apart; y's are as long or one letter longer."""
    cx, cy = letter_counts(x), letter_counts(y)
    sx, sy = (cx * cx).sum(axis=1), (cy * cy).sum(axis=1)
    at_once = max(1, VERIFY_BYTES // y.shape[1])
    for s in range(0, len(x), STRIP):
        product = cx[s : s + STRIP] @ cy.T
        product *= 2
        near = product >= sx[s : s + STRIP, None] + (sy - 2)[None, :]
        p, r = np.nonzero(near)
        p += s
        for c in range(0, len(p), at_once):
            pp, rr = p[c : c + at_once], r[c : c + at_once]
            ok = one_edit(x[pp], y[rr])
            yield pp[ok], rr[ok]


def _best(at: np.ndarray, other: np.ndarray, words: list[bytes], n: np.ndarray, other_words: list[bytes], other_n: np.ndarray):
    """(word, number of near words, n and word of the best) for each word that has near ones here."""
    order = np.argsort(np.array(other_words, dtype=object), kind="stable")
    rank = np.empty(len(other_words), np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort((rank[other], -other_n[other], at))
    at, other = at[by], other[by]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    for f, c in zip(first.tolist(), count.tolist(), strict=True):
        yield words[at[f]], c, int(other_n[other[f]]), other_words[other[f]]


def compare(left: list[tuple[bytes, int]], right: list[tuple[bytes, int]], within: bool) -> list[tuple]:
    """Rows of the near words of a pair of tiles, for the words of both; ``within``: a tile with itself."""
    if not left or not (right or within):
        return []
    if within:
        right = left
    elif len(left[0][0]) > len(right[0][0]):
        left, right = right, left
    lw, rw = [w for w, _ in left], [w for w, _ in right]
    ln, rn = np.array([n for _, n in left]), np.array([n for _, n in right])
    found = [f for f in near_pairs(letters_of(lw), letters_of(rw)) if len(f[0])]
    if not found:
        return []
    p, r = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    out = list(_best(p, r, lw, ln, rw, rn))
    return out if within else out + list(_best(r, p, rw, rn, lw, ln))


def _compare_tiles(batches):
    """Reads rows in order of their tile pair and keeps no more than one pair's words."""
    key, left, right = None, [], []

    def done():
        rows = compare(left, right, key is not None and key[0] == key[1] and key[2] == key[3])
        if rows:
            w, c, n, o = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.decode("latin-1") for x in w]), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array([x.decode("latin-1") for x in o])], names=["word", "k", "best_n", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.array(batch.column(i).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1) for i in (0, 1))
        ij = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)], axis=1)
        keys = np.concatenate([a, b, ij], axis=1)
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist()
        side, words, n = batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()
        for s, e in zip(new, [*new[1:], batch.num_rows], strict=True):
            this = (tuple(a[s]), tuple(b[s]), *ij[s].tolist())
            if this != key:
                yield from done()
                key, left, right = this, [], []
            for r in range(s, e):
                (right if side[r] else left).append((words[r].encode("latin-1"), n[r]))
    yield from done()


def near_words(words: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(word, n_near, best, best_n) of the words of ``words`` (word, n; distinct) that have near ones."""
    rows = tile_rows(words, groups or letter_groups(words))
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // TASK_WORDS + 1)
    placed = rows.repartition(parts, "a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j")
    found = map_arrow(placed, _compare_tiles, "word string, k long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("x")).select("word", "n_near", F.col("x.w").alias("best"), (-F.col("x.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): each word's form followed to the last, by doubling; forms gain in count, so there are no circles."""
    steps = materialise(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialise(steps.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = jumped.select("word", "root")
        if not jumped.filter("moved").limit(1).count():
            return steps


def variants(docs: DataFrame, times: int = 5, every: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words; a form is the commonest near word if ``times`` as common."""
    words = materialise(vocabulary(altered_words(docs, every), least_length, least_count), "words")
    near = near_words(words)
    formed = words.join(near, "word", "left").withColumn("ok", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    formed = materialise(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("best")).alias("form"), F.when(F.col("ok"), F.col("best_n")).alias("form_n")), "forms")
    return formed.join(roots(formed), "word", "left").select("word", F.coalesce("root", "word").alias("root"), "form", "n", "n_near", "form_n")
