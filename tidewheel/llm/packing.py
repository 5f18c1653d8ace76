"""Pattern packing: document lengths to sequences by non-negative least squares.

1. Tasks tokenise whole texts and cut them into pieces; only lengths and places move on.
2. The histogram of piece lengths (one count for each length up to the limit) goes to the driver. Patterns of
   few pieces that fill a sequence are enumerated on length classes; non-negative least squares fits
   how often each is used so that the patterns' counts meet the histogram; counts are rounded
   down, and what is left is packed best-fit, longest first, into the slack of open sequences
   and then into new ones. All of this works on counts, so its size is bounded by the limit.
3. The plan maps (length, rank within the length) to sequence and offset by ranges. Ranks come from
   counts by task, so no length is gathered in one place.

Defined results: a null text is empty and still has its end token; every row gives its pieces,
whatever its doc_id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workers import map_arrow
from .bytetext import chunks, column_bytes
from .shared import materialise

#: Characters that Python and the tokenizer class or normalise differently, or beyond the tables below; a text with one
#: or with a special token takes the plain path.
UNUSUAL = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0130\u023a\u023e\u0300-\U0010ffff]")
SPECIAL = re.compile(rb"<\|(?:start|end)oftext\|>")
#: White space of the tokenizer below U+0300.
PARTS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
#: Kinds of characters below U+0300 in the tokenizer's own splitting: words are runs of letters, single digits, and runs of others.
SPACE, LETTER, DIGIT, OTHER, STRANGE = range(5)
#: Endings that are words of their own after an apostrophe.
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def _kind(c: str) -> int:
    if UNUSUAL.match(c):
        return STRANGE
    return SPACE if c.isspace() else DIGIT if re.match(r"\d", c) else LETTER if re.match(r"[^\W\d_]", c) else OTHER


#: By code point: its kind, and its lower-cased one; then the same by byte of text.
KINDS = np.array([_kind(chr(c)) for c in range(0x300)], np.uint8)
LOWER = np.array([ord(chr(c).lower()) if KINDS[c] != STRANGE else c for c in range(0x300)], np.int32)
BYTE_KINDS = np.concatenate([KINDS[:128], np.full(128, STRANGE, np.uint8)])
BYTE_LOWER = np.concatenate([LOWER[:128], np.arange(128, 256)]).astype(np.uint8)

#: Length classes for the patterns, most pieces of a pattern, words that a worker remembers, and bytes of text split at a time.
CLASSES, MOST_PIECES = 64, 4
MEMORY_WORDS = 400_000
SPLIT_BYTES = 8 << 20
LONG = np.int64


class _Memory:
    """Ids of strings, all in one array, found by a dictionary."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0
        self.begin = np.zeros(1 << 16, LONG)
        self.size = np.zeros(1 << 16, LONG)

    def find(self, keys: list[str]) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        return np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), LONG, len(keys))

    def add(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        n = len(self.known)
        while n + len(keys) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.used += len(flat)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered strings in a row, and where each one's end."""
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.begin[which] - (ends - sizes), sizes)], ends


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of UTF-8 text lower-cased, and the kind of the character that each belongs to."""
    low, kinds = BYTE_LOWER[data], BYTE_KINDS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        two = first < 0xCC  # two bytes, below U+0300; longer characters stay strange
        lead = lead[two]
        code = (first[two] & 31) << 6 | data[lead + 1] & 63
        kinds[lead] = kinds[lead + 1] = KINDS[code]
        low[lead], low[lead + 1] = 0xC0 | LOWER[code] >> 6, 0x80 | LOWER[code] & 63
    return low, kinds


def split_words(low: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokenizer's own words of texts without strange characters, in a row, and how many each text has."""
    if not len(low):
        return pa.array([], pa.string()), np.zeros(len(offsets) - 1, LONG)
    starts = np.ones(len(low), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts |= kinds == DIGIT
    heads = np.zeros(len(low) + 3, bool)  # where texts begin, with an end to look at
    heads[offsets] = True
    starts |= heads[: len(low)]
    # an apostrophe alone before letters takes a known ending with it
    at = np.flatnonzero(low == ord("'"))
    at = at[at + 1 < len(low)]
    at = at[starts[at] & (kinds[at + 1] == LETTER) & ~heads[at + 1]]
    after = np.concatenate([low, np.zeros(2, np.uint8)])
    for ending in ENDINGS:
        n = len(ending)
        hit = after[at + 1] == ending[0]
        if n == 2:
            hit &= (after[at + 2] == ending[1]) & ~heads[at + 2]
        here = at[hit]
        starts[here + 1] = False
        end = here + 1 + n
        starts[end[end < len(low)]] = True
    begins = np.flatnonzero(starts)
    wanted = kinds[begins] != SPACE
    sizes = np.diff(begins, append=len(low))[wanted]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(low[kinds != SPACE]))
    return words, np.diff(np.searchsorted(begins[wanted], offsets))


class WordTokenizer:
    """Ids of texts under a word-level BPE tokenizer (white space dropped, lower-cased, word ends marked).

    Texts are lower-cased and split into the tokenizer's own words as arrays of bytes, and each distinct word of
    a block of texts is looked up once. New words are encoded, many in one call: the marked word ends tell where each
    one's ids end. Words are remembered up to a bound, then forgotten together. Texts with
    unusual characters have their parts between white space encoded one by one as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        # for words: nothing to normalise and nothing to split but the blanks between them
        self.word_encoder = Tokenizer(self.encoder.model)
        self.word_encoder.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.parts = _Memory(), _Memory()

    def _learn_apart(self, memory: _Memory, keys: list[str]) -> None:
        got = [self.encoder.encode(t, add_special_tokens=False).ids for t in keys]
        memory.add(keys, np.array([x for g in got for x in g], np.uint32), np.array([len(g) for g in got], LONG))

    def _learn_words(self, words: list[str]) -> None:
        for k in range(0, len(words), 500):
            some = words[k : k + 500]
            flat = np.array(self.word_encoder.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) == len(some) and (not len(flat) or ends[-1] == len(flat)):
                self.words.add(some, flat, np.diff(ends, prepend=0))
            else:
                self._learn_apart(self.words, some)

    def _encode_usual(self, low: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, many = split_words(low, kinds, offsets)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words.known) > MEMORY_WORDS:
            self.words = _Memory()
        which, known = self.words.find(distinct), len(self.words.known)
        new = which < 0
        self._learn_words(list(itertools.compress(distinct, new)))
        which[new] = np.arange(known, len(self.words.known))  # learnt in their order
        ids, ends = self.words.gather(which[coded.indices.to_numpy()])
        return ids, np.diff(np.concatenate([[0], ends])[np.cumsum([0, *many])])

    def _encode_apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts.known) > MEMORY_WORDS:
            self.parts = _Memory()
        split = [PARTS.findall(t) for t in texts]
        flat = [w for parts in split for w in parts]
        self._learn_apart(self.parts, [w for w in dict.fromkeys(flat) if w not in self.parts.known])
        ids, ends = self.parts.gather(self.parts.find(flat))
        return ids, np.diff(np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])])

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text; texts are ranges of UTF-8 bytes."""
        low, kinds = _classes(data)
        odd = [np.flatnonzero(kinds == STRANGE), np.array([m.start() for m in SPECIAL.finditer(data)], LONG)]
        apart = np.zeros(len(offsets) - 1, bool)
        apart[np.searchsorted(offsets, np.concatenate(odd), side="right") - 1] = True
        if not apart.any():
            return self._encode_usual(low, kinds, offsets)
        raw, lengths = data.tobytes(), np.diff(offsets)
        usual = np.repeat(~apart, lengths)
        parts = (
            self._encode_usual(low[usual], kinds[usual], np.concatenate([[0], np.cumsum(lengths[~apart])])),
            self._encode_apart([raw[offsets[i] : offsets[i + 1]].decode() for i in np.flatnonzero(apart).tolist()]),
        )
        sizes = np.zeros(len(apart), LONG)
        sizes[~apart], sizes[apart] = parts[0][1], parts[1][1]
        of_apart = np.repeat(apart, sizes)
        ids = np.empty(len(of_apart), np.uint32)
        ids[~of_apart], ids[of_apart] = parts[0][0], parts[1][0]
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text."""
        return self.encode_bytes(*column_bytes(pa.array(texts, pa.string())))


@functools.cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each tokenizer in a worker process: loading takes longer than many a task."""
    return WordTokenizer(path)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _cut(path: str, limit: int, end_id: int):
    def run(batches):
        tokenizer = tokenizer_of(path)
        seen = np.zeros(limit + 1, LONG)
        part = TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for at, to in chunks(offsets, SPLIT_BYTES):
                ids, sizes = tokenizer.encode_bytes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                # every text's ids, then its end
                ends = np.cumsum(sizes + 1)
                whole = np.full(len(ids) + len(sizes), end_id, "<u4")
                inside = np.ones(len(whole), bool)
                inside[ends - 1] = False
                whole[inside] = ids
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for name, begin, end in zip(names[at:to], (ends - sizes - 1).tolist(), ends.tolist(), strict=True):
                    for k, s in enumerate(range(begin, end, limit)):
                        piece = whole[s : min(s + limit, end)]
                        for c, v in zip(out, (name, k, s - begin, len(piece), zlib.crc32(piece), int(seen[len(piece)])), strict=True):
                            c.append(v)
                        seen[len(piece)] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5]), pa.array([part] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )
        tokenizer.forget()  # workers live on and serve other work

    return run


def patterns(classes: int, most: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of two to ``most`` class sizes that add up to ``classes`` exactly."""
    found: list[tuple[int, ...]] = []

    def extend(so_far: tuple[int, ...], left: int, cap: int, more: int) -> None:
        if not left:
            found.append(so_far)
        elif more:
            for c in range(min(cap, left), max(0, -(-left // more) - 1), -1):
                extend((*so_far, c), left - c, c, more - 1)

    for c in range(classes - 1, 0, -1):
        extend((c,), classes - c, c, most - 1)
    return found


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 of least ``|a x - b|``, by accelerated projected gradient; ``a`` is non-negative."""
    x = np.zeros(a.shape[1])
    if not b.any() or not a.size:
        return x
    gram = a @ a.T
    lipschitz = np.linalg.eigvalsh(gram)[-1]
    y, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - a.T @ (a @ y - b) / lipschitz)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Ranges of ranks: pieces of ``length`` with rank in [rank, rank+count) go to sequence + (rank - first), at offset."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length * (1 << 44) + self.rank, length * (1 << 44) + rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def plan_packing(histogram: dict[int, int], limit: int, classes: int = CLASSES, most: int = MOST_PIECES) -> Plan:
    """Packs ``histogram`` (length -> pieces) into sequences of at most ``limit``, on counts alone."""
    left = {n: k for n, k in histogram.items() if k}
    used: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int]] = []
    step = -(-limit // classes)
    classes = limit // step
    sequence = 0
    spaces: list[int] = []  # sorted slacks of open sequences
    open_: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # slack -> (first sequence, how many, filled)

    def put(n: int, k: int, first: int, offset: int) -> None:
        rows.append((n, used[n], first, offset))
        used[n] += k
        left[n] -= k

    def leave(slack: int, first: int, k: int, filled: int) -> None:
        if slack and k:
            if not open_[slack]:
                insort(spaces, slack)
            open_[slack].append((first, k, filled))

    # 1. patterns by least squares
    of_class: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        if (c := -(-n // step)) <= classes:
            of_class[c].append(n)
    want = np.zeros(classes + 1)
    for c, lengths in of_class.items():
        want[c] = sum(left[n] for n in lengths)
    found = [p for p in patterns(classes, most) if all(want[c] for c in p)]
    if found:
        a = np.zeros((classes + 1, len(found)))
        for j, p in enumerate(found):
            for c in p:
                a[c, j] += 1
        repeats = nnls(a, want)
        there = sorted(left)
        for j in np.argsort(-repeats, kind="stable").tolist():
            k, p = int(repeats[j]), found[j]
            while k > 0:
                # exact lengths from the classes, longest first; the last is the longest that still fits
                take: list[int] = []
                count: dict[int, int] = defaultdict(int)
                for c in p[:-1]:
                    n = next((n for n in of_class[c] if left[n] > count.get(n, 0)), None)
                    if n is None:
                        break
                    take.append(n)
                    count[n] += 1
                room = limit - sum(take)
                i = bisect_right(there, room) - 1
                while i >= 0 and left[there[i]] <= count.get(there[i], 0):
                    if not left[there[i]]:
                        there.pop(i)
                    i -= 1
                if len(take) < len(p) - 1 or i < 0:
                    break
                take.append(there[i])
                count[there[i]] += 1
                run = min(k, *(left[n] // m for n, m in count.items()))
                at = 0
                for n in take:
                    put(n, run, sequence, at)
                    at += n
                leave(limit - at, sequence, run, at)
                sequence += run
                k -= run
    # 2. the rest best-fit, longest first
    for n in sorted(left, reverse=True):
        while left[n]:
            i = bisect_left(spaces, n)
            if i == len(spaces):
                fit = limit // n
                k = left[n] // fit
                if k:
                    for s in range(fit):
                        put(n, k, sequence, s * n)
                    leave(limit - fit * n, sequence, k, fit * n)
                    sequence += k
                if left[n]:  # one sequence takes the last few
                    last = left[n]
                    for s in range(last):
                        put(n, 1, sequence, s * n)
                    leave(limit - last * n, sequence, 1, last * n)
                    sequence += 1
                continue
            slack = spaces[i]
            first, k, filled = open_[slack].pop()
            if not open_[slack]:
                spaces.pop(i)
            run = min(k, left[n])
            put(n, run, first, filled)
            leave(slack - n, first, run, filled + n)
            leave(slack, first + run, k - run, filled)
    rows.sort()
    length, rank, seq, offset = (np.array(c, LONG) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, LONG),) * 4
    return Plan(length, rank, seq, offset, sequence)


def _place(plan):
    def run(batches):
        for batch in batches:
            t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rank = t["rank"].to_numpy() + t["before"].to_numpy()
            seq, offset = plan.value.place(t["length"].to_numpy(), rank)
            yield pa.RecordBatch.from_arrays([t["doc_id"], t["piece"], t["start"], t["length"], t["ids_crc32"], pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of every row of ``docs`` (doc_id, text), with its sequence and offset.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A text's ids are those of
    the tokenizer at ``tokenizer_path`` (which must not join characters across white space), then end_id.
    """
    from pyspark.sql import Window

    pieces = materialise(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _cut(tokenizer_path, limit, end_id), _PIECES), "pieces")
    counts = materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("k")), "counts")
    histogram = {r["length"]: r["k"] for r in counts.groupBy("length").agg(F.sum("k").alias("k")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(plan_packing(histogram, limit))
    before = counts.select("length", "part", (F.sum("k").over(Window.partitionBy("length").orderBy("part")) - F.col("k")).alias("before"))
    placed = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return map_arrow(placed, _place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
