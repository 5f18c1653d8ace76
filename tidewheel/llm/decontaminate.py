"""Benchmark decontamination by suffix arrays over the training shards.

A shard is a block of documents within a task. Its suffix array sorts word suffixes; every test
suffix is looked up in it by binary search, which gives the places that hold a whole window.
Windows that follow one another in an item and in a document are one verbatim match, which is
extended that way to its full length; the longest of each document and item is reported with its
places in both. Suffixes whose first two words start no test window are left out of the array by a
table of fixed size, so most of a clean shard is never sorted.

The test set is read in blocks of bounded size, broadcast one after the other to all shards;
documents are never shuffled, and what is found is carried along with each row. Words are compared by 64-bit hashes.

Defined results: null or wordless documents and items have no words; items with a null id hit but
are not listed; repeated item ids count once; each row of documents gives a row, whatever its id. Columns other
than those named are ignored by ``contamination`` and kept by ``drop_contaminated``. An empty table gives no rows, an empty
test set no hits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.workers import map_arrow
from .bytetext import ALNUM, U, chunks, column_bytes, mix, words
from .shared import materialise

#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
START_BITS = 22
LONG = np.int64


@dataclass(frozen=True)
class TestBlock:
    """Test suffixes: word hashes of all items in a row, where each item starts, and the ids."""

    hashes: np.ndarray
    bounds: np.ndarray
    ids: list
    width: int

    @property
    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows as (first word, number of words)."""
        first, size = [], []
        for b, e in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            n = min(self.width, e - b)
            if n:
                first.append(np.arange(b, e - n + 1))
                size.append(np.full(e - b - n + 1, n))
        return (np.concatenate(first), np.concatenate(size)) if first else (np.zeros(0, LONG), np.zeros(0, LONG))


def _pairs(hashes: np.ndarray) -> np.ndarray:
    nxt = np.zeros_like(hashes)
    nxt[:-1] = hashes[1:]
    return (mix(hashes + U(3) * nxt) >> U(64 - START_BITS)).astype(LONG)


class SuffixArray:
    """The word suffixes at ``places`` of ``hashes``, sorted by their first ``width`` words.

    ``ends`` gives for each place where its document ends; beyond it there are no words (0).
    """

    def __init__(self, hashes: np.ndarray, places: np.ndarray, ends: np.ndarray, width: int):
        self.width = width
        keys = self._keys(hashes, places, ends, width)
        order = np.lexsort(keys[::-1])
        self.places = places[order]
        self.keys = [k[order] for k in keys]

    @staticmethod
    def _keys(hashes, places, ends, width):
        padded = np.concatenate([hashes, np.zeros(width, U)])
        return [np.where(places + k < ends, padded[places + k], U(0)) for k in range(width)]

    def narrow(self, words_: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For test windows (word k of each in words_[k], ``size`` words): the range of suffixes that
        start with the whole window, by one binary search a word, and the longest match in words."""
        lo = np.zeros(len(size), LONG)
        hi = np.full(len(size), len(self.places), LONG)
        longest = np.zeros(len(size), LONG)
        for k in range(self.width):
            live = np.flatnonzero((hi > lo) & (size > k))
            if not len(live):
                break
            want = words_[k][live]
            a = self._bound(k, want, lo[live], hi[live], False)
            b = self._bound(k, want, a, hi[live], True)
            lo[live], hi[live] = a, b
            longest[live[b > a]] = k + 1
        return lo, hi, longest

    def _bound(self, k, want, lo, hi, after):
        lo, hi = lo.copy(), hi.copy()
        column = self.keys[k]
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            at = column[np.minimum(mid, len(column) - 1)]
            below = at <= want if after else at < want
            lo = np.where(open_ & below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)


_MATCH = pa.struct([("item_id", pa.string()), ("item_offset", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])
_FOUND = "hits array<int>, matches array<struct<item_id:string,item_offset:int,offset:int,length:int>>"


def _longest(array: SuffixArray, ranges: list[tuple[int, int, int]], test: TestBlock, first: np.ndarray, size: np.ndarray, item: np.ndarray, bounds: np.ndarray, total: int) -> list[dict]:
    """For each row of a shard {item: (length, place, test place)}, its longest verbatim match with each item.

    ranges: (window, lo, hi) of the windows found, in their order. ``reach`` holds for each place the length of the match
    that ends in the window before; a window at the next place and of the same item goes on with it.
    """
    found: list[dict] = [{} for _ in range(len(bounds) - 1)]
    reach = np.zeros(total + 1, LONG)
    before, at = -2, np.zeros(0, LONG)
    for w, lo, hi in ranges:
        places = np.sort(array.places[lo:hi])
        row = np.searchsorted(bounds, places, side="right") - 1
        length = np.full(len(places), size[w])
        if before == w - 1 and item[w] == item[before] and size[w] == size[before]:
            goes_on = (places > bounds[row]) & (reach[places - 1] > 0)
            length[goes_on] = reach[places[goes_on] - 1] + 1
        reach[at] = 0
        reach[places] = length
        before, at = w, places
        for r, n, place in zip(row.tolist(), length.tolist(), places.tolist(), strict=True):
            # a match of several windows ends in this one
            start = place + int(size[w]) - n
            best = found[r].get(int(item[w]))
            if best is None or n > best[0]:
                found[r][int(item[w])] = (n, start - int(bounds[r]), int(first[w] + size[w]) - n - int(test.bounds[item[w]]))
    return found


def _search(block, width: int, last: bool):
    def run(batches):
        test: TestBlock = block.value
        first, size = test.starts
        started = np.zeros(1 << START_BITS, dtype=bool)
        started[_pairs(test.hashes)[first[size > 1]]] = True
        single = np.sort(test.hashes[first[size == 1]])
        padded = np.concatenate([test.hashes, np.zeros(width, U)])
        query = [padded[first + k] for k in range(width)]
        item = np.searchsorted(test.bounds, first, side="right") - 1
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            out_n, out_at, out_found = [], batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j in chunks(offsets):
                _, _, hashes, bounds = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                out_n += np.diff(bounds).tolist()
                may = started[_pairs(hashes)] if len(hashes) else np.zeros(0, bool)
                if len(single):
                    may |= np.isin(hashes, single)
                places = np.flatnonzero(may)
                if not len(places):
                    continue
                row = np.searchsorted(bounds, places, side="right") - 1
                array = SuffixArray(hashes, places, bounds[row + 1], width)
                lo, hi, most = array.narrow(query, size)
                whole = np.flatnonzero((hi > lo) & (most == size))
                if not len(whole):
                    continue
                hit = np.zeros(len(hashes) + 1, LONG)
                for n in np.unique(size[whole]).tolist():
                    some = whole[size[whole] == n]
                    held = np.zeros(len(places) + 1, LONG)
                    np.add.at(held, lo[some], 1)
                    np.add.at(held, hi[some], -1)
                    place = array.places[np.cumsum(held)[:-1] > 0]
                    hit[place] += 1
                    hit[place + n] -= 1
                covered = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
                for r, k in zip(*np.unique(np.searchsorted(bounds, covered, side="right") - 1, return_index=True), strict=True):
                    end = np.searchsorted(covered, bounds[r + 1])
                    out_at[i + r] = [*(out_at[i + r] or []), *(covered[k:end] - bounds[r]).tolist()]
                ranges = list(zip(whole.tolist(), lo[whole].tolist(), hi[whole].tolist(), strict=True))
                for r, matches in enumerate(_longest(array, ranges, test, first, size, item, bounds, len(hashes)), i):
                    if matches:
                        out_found[r] = [*(out_found[r] or []), *({"item_id": test.ids[t], "item_offset": o, "offset": p, "length": n} for t, (n, p, o) in sorted(matches.items()))]
            columns = [batch.column(0), pa.array(out_at, pa.list_(pa.int32())), pa.array(out_found, pa.list_(_MATCH))]
            if last:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out_n, pa.int64())], names=["key", "hits", "matches", "n_words"])
            else:
                yield pa.RecordBatch.from_arrays([columns[0], batch.column(1), *columns[1:]], names=["key", "text", "hits", "matches"])

    return run


def _blocks(benchmark: DataFrame, width: int):
    """(test block, whether it is the last): blocks of bounded size, each collected only when its turn comes."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = -(-size // BLOCK_BYTES) or 1
    for k in range(count):
        part = texts if count == 1 else texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        rows = part.distinct().collect()
        data, offsets = column_bytes(pa.array([r["text"] for r in rows], pa.large_string()))
        _, _, hashes, bounds = words(data, offsets, ALNUM)
        yield TestBlock(hashes, bounds, [r["item_id"] for r in rows], width), k == count - 1


def _scan(keyed: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """(key, hits, matches, n_words) of (key, text): every block of the test set in turn adds what it finds to each row."""
    spark = keyed.sparkSession
    now = keyed.select("key", "text", F.expr("cast(null as array<int>)").alias("hits"), F.expr(f"cast(null as {_FOUND.split('matches ')[1]})").alias("matches"))
    key = T.StructField("key", keyed.schema["key"].dataType)
    found = T._parse_datatype_string(_FOUND).fields
    for test, last in _blocks(benchmark, width):
        block = spark.sparkContext.broadcast(test)
        more = [*found, T.StructField("n_words", T.LongType())] if last else [T.StructField("text", T.StringType()), *found]
        now = map_arrow(now, _search(block, width, last), T.StructType([key, *more]))
        if not last:
            now = materialise(now, "scanned")
            block.unpersist()
    return now


def _digest(batches):
    for batch in batches:
        c = batch.to_pydict()
        ids = [sorted({m["item_id"] for m in found or [] if m["item_id"] is not None}) for found in c["matches"]]
        hit = [len(set(h or [])) for h in c["hits"]]
        longest = [max((m["length"] for m in found or []), default=0) for found in c["matches"]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c["key"], pa.int64()), pa.array(c["n_words"], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array(longest, pa.int32()), pa.array(ids, pa.list_(pa.string())), pa.array([found or [] for found in c["matches"]], pa.list_(_MATCH))],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "items", "matches"],
        )


_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest int, items array<string>, " + _FOUND.split(", ", 1)[1]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): words, words hit, the items found, and ``matches``.

    ``matches`` holds the longest verbatim match with each item (of ties the first in the item): its length in words, and its first word's
    offset in the item and in the document. ``longest`` is the largest length, 0 without a match.
    """
    return map_arrow(_scan(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), benchmark, width), _digest, _REPORT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` without the rows whose own text is contaminated, whatever their doc_id; columns stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    clean = _scan(docs.select(row.alias("key"), "text"), benchmark, width).filter(F.coalesce(F.size("hits"), F.lit(0)) <= 0)
    return clean.select(*[F.col(f"key.`{c}`").alias(c) for c in docs.columns])
