"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes when some string of ``length`` bytes that covers it also starts anywhere else.

1. Copies. Texts are told apart by a 64-bit hash. A text of ``length`` bytes or more that occurs
   twice goes whole; one row stands for all its copies in what follows, so that a group of copies
   costs what one text costs.
2. Anchors. Every window of ``length`` bytes has one anchor, the leftmost of its least hashed
   32-grams, so equal windows have equal anchors at equal offsets and about one suffix in 185
   bytes stands for all. A node is an anchor with the run of windows that it stands for, on
   its right or left side; all windows of a side share a core of over half their length.
3. Fingerprints of the cores are counted (pre-aggregated); nodes whose core is unique cannot hold
   a repeat and are left out by a bitmap of fixed size. False hits only add work.
4. Each task sorts the suffixes of its remaining nodes. Suffixes that it holds twice are repeats already:
   their spans are final, and one without its places goes on for all of them, so that what a group of near copies
   sends to a bucket does not grow with its copies in a task. The sorted rest is front-coded into
   runs (common prefix length and the rest), split by core over buckets.
5. Buckets are merged by a loser tree that carries common-prefix lengths and never compares a
   known prefix again. Those lengths decide: a window is a repeat when another suffix has the window's
   right part as common prefix and its left part as common prefix of the reversed left contexts.
6. A core held by very many nodes is split by window offset into narrower nodes with longer
   cores, most of whose suffixes are then equal and meet in step 4.
7. Spans are united by text within a task, then over tasks, and joined to the affected rows only: broadcast
   where their counted ranges are few, else by a shuffle of those rows.

Defined results: null is the empty text; shorter texts than ``length`` keep all; repeated rows
are repeats of each other. doc_id is never compared, so null and repeated ids are fine; extra
columns of the input are carried by ``drop_repeats``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.workers import map_arrow
from .bytetext import RangeHash, U, chunks, column_bytes, mix
from .shared import materialise

GRAM = 32
#: Bits of the bitmap of repeated cores: 16 MB whatever the corpus holds; and of that of hot cores.
CORE_BITS, HOT_BITS = 27, 22
#: Nodes of one core from which it is split by window offset, and offsets to a split.
HOT, SPLIT = 20_000, 8
#: Bytes of suffixes that a task sorts into one set of runs, and that a bucket should hold.
RUN_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: Ranges (8 bytes each) up to which they are broadcast to the affected rows; beyond, the rows are shuffled.
BROADCAST_RANGES = 1_000_000
LONG = np.int64


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(U).max, dtype=U)
    padded[:n] = x
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _nodes(data: np.ndarray, offsets: np.ndarray, length: int):
    """Of the rows' windows: row, side (0 right, 1 left), anchor, least and largest offset, core fingerprint."""
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= length)
    none = tuple(np.zeros(0, t) for t in (LONG, LONG, LONG, LONG, LONG, U))
    if not len(rows):
        return none
    hashes = RangeHash(data)
    bits = max(24, int(len(data)).bit_length())
    grams = hashes.fixed(GRAM)
    low = U((1 << bits) - 1)
    grams = (grams & ~low) | np.arange(len(grams), dtype=U)
    least = _sliding_min(grams, length - GRAM + 1) & low
    many = sizes[rows] - length + 1
    ends = np.cumsum(many)
    starts = np.arange(ends[-1]) + np.repeat(offsets[rows] - (ends - many), many)
    anchor = least[starts].astype(LONG)
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    x, first, last = anchor[cut], starts[cut], starts[np.concatenate([cut[1:], [len(starts)]]) - 1]
    row = np.searchsorted(offsets, x, side="right") - 1
    lo, hi = x - last, x - first
    half = (length - GRAM) // 2 + 1
    right, left = lo < half, hi >= half
    key_r = hashes(x[right], x[right] + length - half + 1)
    key_l = hashes(x[left] - half, x[left] + GRAM) ^ U(0x5851F42D4C957F2D)
    join = np.concatenate
    return (
        join([row[right], row[left]]),
        join([np.zeros(right.sum(), LONG), np.ones(left.sum(), LONG)]),
        join([x[right], x[left]]),
        join([lo[right], np.maximum(lo[left], half)]),
        join([np.minimum(hi[right], half - 1), hi[left]]),
        join([key_r, key_l]),
    )


def _one_of_copies(batch: pa.RecordBatch, copied: np.ndarray) -> pa.RecordBatch:
    """The rows of (text, id, stands) that stand for their text: of those in ``copied`` only the chosen ones."""
    ids = batch.column(1).to_numpy(zero_copy_only=False).astype(U)
    keep = ~_test(copied, ids, CORE_BITS) | batch.column(2).to_numpy(zero_copy_only=False)
    return batch if keep.all() else batch.filter(pa.array(keep))


def _only_copies(copied):
    def run(batches):
        for batch in batches:
            keep = _test(copied.value, batch.column(1).to_numpy(zero_copy_only=False).astype(U), CORE_BITS)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def _core_keys(length: int, copied):
    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(_one_of_copies(batch, copied.value).column(0))
            for i, j in chunks(offsets):
                keys = _nodes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)[5]
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(LONG))], names=["core"])

    return run


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with those of the keys set, aggregated by Spark's bitmap functions."""
    cell = F.expr(f"core & {(1 << bits) - 1}L")
    rows = keys.select(cell.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("m")).collect()
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows:
        if r["b"] < 1:  # value 0, which _test takes as set
            continue
        at = (r["b"] - 1) * 4096
        part = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def _test(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    # Spark numbers buckets from 1 with bit positions from 0 for values >= 1, and value 0 ends bucket 0
    cell = (keys & U((1 << bits) - 1)).astype(LONG) - 1
    hit = np.ones(len(keys), dtype=bool)
    inside = cell >= 0
    hit[inside] = (bitmap[cell[inside] >> 3] >> (cell[inside] & 7).astype(np.uint8)) & 1 == 1
    return hit


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known to be equal."""
    end = min(len(a), len(b))
    step = 16
    while known < end:
        if a[known : known + step] == b[known : known + step]:
            known = min(known + step, end)
            step *= 4
        elif step == 1:
            return known
        else:
            # the first difference lies within step bytes: halve
            lo, hi = known, min(known + step, end)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if a[lo:mid] == b[lo:mid]:
                    lo = mid
                else:
                    hi = mid
            return lo if lo < end and a[lo] != b[lo] else min(lo + 1, end)
    return end


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sorted suffixes as common-prefix lengths with the one before, lengths of the rest, and the rests."""
    prefix, rest, before = [], [], b""
    for s in suffixes:
        n = len(s) if s == before else common_prefix(before, s)
        prefix.append(n)
        rest.append(s[n:])
        before = s
    return np.array(prefix, np.int32), np.array([len(r) for r in rest], np.int32), b"".join(rest)


def read_run(prefix: np.ndarray, rest: np.ndarray, text: bytes) -> Iterator[tuple[bytes, int]]:
    """The suffixes of a front-coded run, each with its common-prefix length with the one before."""
    before, at = b"", 0
    for n, more in zip(prefix.tolist(), rest.tolist(), strict=True):
        if more or n < len(before):
            before = before[:n] + text[at : at + more]
            at += more
        yield before, n


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merges sorted runs: (suffix, common-prefix length with the suffix before, number of its run).

    A loser tree in which every loser keeps its common-prefix length with the winner it lost
    to. Against the last output the longer common prefix is the smaller suffix; only equal
    lengths need bytes compared, and those from the known length on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    head: list[bytes | None] = [next(r, (None, 0))[0] for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known length becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(x, y, known[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    win = build(1)
    while head[win] is not None:
        yield head[win], known[win], win
        head[win], known[win] = next(runs[win], (None, 0))
        node = (win + k) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


#: A front-coded run, or (prefix null) spans: texts, begins and, as ``extent``, ends.
_RUN = "bucket int, prefix binary, rest binary, suffixes binary, text binary, start binary, extent binary, left binary, core binary"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]
_SPANS = "text long, begins array<int>, ends array<int>"
#: Spans that a task unites at a time.
SPANS_HELD = 200_000


def _as_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_RUN_NAMES)


def _flush(held: list[tuple], buckets: int) -> pa.RecordBatch:
    """Nodes (bucket, suffix, left, text, start, windows, core, end) as one run a bucket and spans of what is here twice."""
    held.sort(key=lambda n: n[:3])
    out: list[tuple] = []
    twice: list[tuple] = []
    part: list[tuple] = []

    def close() -> None:
        if part:
            prefix, rest, suffixes = front_code([n[1] for n in part])
            column = lambda c, t: np.array([n[c] for n in part], t).tobytes()
            out.append((part[0][0], prefix.tobytes(), rest.tobytes(), suffixes, column(3, LONG), column(4, LONG), column(5, np.int32), column(2, np.int32), column(6, np.int32)))
            part.clear()

    i = 0
    while i < len(held):
        j = i + 1
        while j < len(held) and held[j][:3] == held[i][:3]:
            j += 1
        if part and part[0][0] != held[i][0]:
            close()
        if j > i + 1:
            twice += [(n[3], n[4], n[7]) for n in held[i:j]]
            b, suffix, left, _, _, windows, core, _ = held[i]
            part.append((b, suffix, left, 0, NOWHERE, windows, core))
        else:
            part.append(held[i])
        i = j
    close()
    if twice:
        columns = [np.array(c, LONG).tobytes() for c in zip(*twice, strict=True)]
        out.append((int(mix(np.array([twice[0][0]], LONG).astype(U))[0] % U(buckets)), None, None, None, *columns, None, None))
    return _as_rows(out)


#: The start of a node whose places are known to be repeats.
NOWHERE = -1


def _write_runs(length: int, buckets: int, copied, repeated, hot):
    half = (length - GRAM) // 2 + 1

    def run(batches):
        held, room = [], 0
        for whole in batches:
            batch = _one_of_copies(whole, copied.value)
            data, offsets = column_bytes(batch.column(0))
            ids = batch.column(1).to_pylist()
            for i, j in chunks(offsets):
                base = offsets[i]
                part, at = data[base : offsets[j]], offsets[i : j + 1] - base
                row, side, x, lo, hi, key = _nodes(part, at, length)
                keep = np.flatnonzero(_test(repeated.value, key, CORE_BITS))
                if not len(keep):
                    continue
                row, side, x, lo, hi, key = (c[keep] for c in (row, side, x, lo, hi, key))
                is_hot = _test(hot.value, key, HOT_BITS)
                hashes = RangeHash(part) if is_hot.any() else None
                raw = part.tobytes()
                bucket = (mix(key) % U(buckets)).astype(LONG)
                for r, s, a, l, h, b, wide in zip(row.tolist(), side.tolist(), x.tolist(), lo.tolist(), hi.tolist(), bucket.tolist(), is_hot.tolist(), strict=True):
                    if wide:
                        cuts = [(o, max(l, o), min(h, o + SPLIT - 1), length - SPLIT + 1) for o in range(l // SPLIT * SPLIT, h + 1, SPLIT)]
                    else:
                        cuts = [(half, l, h, half + GRAM)] if s else [(0, l, h, length - half + 1)]
                    for o, low, high, core in cuts:
                        at_core, begin, end = a - o, a - high, a + length - low
                        if wide:
                            b = int(hashes(np.array([at_core]), np.array([at_core + core]))[0] % U(buckets))
                        # the first byte keeps kinds of cores apart
                        suffix = (b"w" if wide else b"l" if s else b"r") + raw[at_core:end] + raw[begin:at_core][::-1]
                        start = begin - int(at[r])
                        held.append((b, suffix, at_core - begin, ids[i + r], start, high - low + 1, core + 1, start + end - begin))
                        room += len(suffix)
                    if room > RUN_BYTES:
                        yield _flush(held, buckets)
                        held, room = [], 0
        if held:
            yield _flush(held, buckets)

    return run


def repeated_windows(nodes: list[tuple], length: int) -> np.ndarray:
    """For each node its windows that another node holds, as rows of flags by the bytes left of the core.

    nodes: (suffix, left, windows, common prefix with the node before, 0 where a group begins), in merged
    order. For windows with ``o`` bytes left of the core, suffixes fall into classes by the first
    ``length - o`` bytes, which are runs of the merged order, and reversed left contexts into classes
    by the first ``o``, runs of theirs; two windows are equal when both classes are.
    """
    m = len(nodes)
    left = np.array([n[1] for n in nodes])
    least = left - np.array([n[2] for n in nodes]) + 1
    right_known = np.array([n[3] for n in nodes]) - 1
    contexts = [n[0][len(n[0]) - n[1] :] for n in nodes]
    order = sorted(range(m), key=contexts.__getitem__)
    left_known = np.array([0] + [common_prefix(contexts[a], contexts[b]) for a, b in zip(order, order[1:], strict=False)])
    order = np.array(order)
    twice = np.zeros((m, int(left.max()) + 1), dtype=bool)
    context_class = np.empty(m, LONG)
    for o in range(int(least.min()), int(left.max()) + 1):
        here = np.flatnonzero((least <= o) & (o <= left))
        if len(here) < 2:
            continue
        context_class[order] = np.cumsum(left_known < o)
        both = np.cumsum(right_known < length - o)[here] * (m + 1) + context_class[here]
        by = np.argsort(both, kind="stable")
        same = both[by[1:]] == both[by[:-1]]
        twice[here[by[1:][same]], o] = True
        twice[here[by[:-1][same]], o] = True
    return twice


class _Spans:
    """Spans by text, united before they leave the task."""

    def __init__(self):
        self.of: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.count = 0

    def add(self, text: int, begin: int, end: int) -> None:
        self.of[text].append((begin, end))
        self.count += 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        texts, begins, ends = [], [], []
        for text, spans in self.of.items():
            b, e = unite(spans)
            texts.append(text)
            begins.append(b)
            ends.append(e)
        self.__init__()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["text", "begins", "ends"])


def unite(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the maximal runs that the spans cover, in order."""
    begins: list[int] = []
    ends: list[int] = []
    for b, e in sorted(spans):
        if ends and b <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(b)
            ends.append(e)
    return begins, ends


def _merge_buckets(length: int):
    def settle(groups: list[list[list]], spans: _Spans) -> None:
        """groups: of distinct suffixes [suffix, left, windows, places, count, known]; places: (text, start)."""
        nodes = [node for group in groups for node in group]
        if not nodes:
            return
        twice = repeated_windows([(n[0], n[1], n[2], n[5]) for n in nodes], length)
        for flags, (_, left, windows, places, count, _) in zip(twice, nodes, strict=True):
            if not places:
                continue
            # window p starts p bytes into the node, left - p bytes left of the core
            own = np.ones(windows, bool) if count > 1 else flags[left - windows + 1 : left + 1][::-1]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            for p, q in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                for text, start in places:
                    spans.add(text, start + p, start + q - 1 + length)

    def merge(rows: list[dict], spans: _Spans) -> None:
        read = lambda r, c, t: np.frombuffer(r[c], dtype=t)
        for r in rows:
            if r["prefix"] is None:
                for text, begin, end in zip(*(read(r, c, LONG).tolist() for c in ("text", "start", "extent")), strict=True):
                    spans.add(text, begin, end)
        rows = [r for r in rows if r["prefix"] is not None]
        runs = [read_run(read(r, "prefix", np.int32), read(r, "rest", np.int32), r["suffixes"]) for r in rows]
        extra = [zip(*(read(r, c, t).tolist() for c, t in (("text", LONG), ("start", LONG), ("extent", np.int32), ("left", np.int32), ("core", np.int32))), strict=True) for r in rows]
        groups: list[list[list]] = []
        group: list[list] = []
        room, most = 0, 0

        def close() -> None:
            nonlocal room
            if len(group) > 1 or group and group[0][4] > 1 and group[0][3]:
                groups.append(group)
                room += sum(len(n[0]) for n in group)

        for suffix, shared, run in merge_runs(runs):
            text, start, windows, left, core = next(extra[run])
            # a node without places stands for several
            places, count = ([], 2) if start == NOWHERE else ([(text, start)], 1)
            if group and shared >= most and core == most:
                last = group[-1]
                if suffix == last[0] and left == last[1]:
                    last[3].extend(places)
                    last[4] += count
                    continue
                group.append([suffix, left, windows, places, count, shared])
            else:
                close()
                if room > 2 << 20:
                    settle(groups, spans)
                    groups, room = [], 0
                group, most = [[suffix, left, windows, places, count, 0]], core
        close()
        settle(groups, spans)

    def run(batches):
        now, rows, spans = None, [], _Spans()
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != now and rows:
                    merge(rows, spans)
                    rows = []
                    if spans.count > SPANS_HELD:
                        yield from spans.rows()
                now = r["bucket"]
                rows.append(r)
        if rows:
            merge(rows, spans)
        yield from spans.rows()

    return run


def _with_id(texts: DataFrame, *more: str) -> DataFrame:
    """(text, id, ...) with null as the empty text; id is the text's 64-bit hash."""
    text = F.coalesce("text", F.lit(""))
    return texts.select(text.alias("text"), F.xxhash64(text).alias("id"), *more)


def repeated_spans(texts: DataFrame, length: int = 400) -> DataFrame:
    """(text, begins, ends): byte ranges covered by strings of ``length`` bytes that start more than once.

    ``texts`` has a string column ``text``; ``text`` of the result is the 64-bit hash of the whole text, with
    one row for each affected text and its maximal ranges in order.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    long_enough = _with_id(texts).filter(F.octet_length("text") >= length)
    copies = materialise(long_enough.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.max(F.octet_length("text")).alias("n")).filter("k > 1").select("id", "n"), "copies")
    copied = share(_bitmap(copies.select(F.col("id").alias("core")), CORE_BITS))
    chosen = map_arrow(long_enough, _only_copies(copied), "text string, id long").groupBy("id").agg(F.first("text").alias("text"))
    once = long_enough.withColumn("stands", F.lit(False)).unionByName(materialise(chosen, "chosen").withColumn("stands", F.lit(True)))
    cores = map_arrow(once, _core_keys(length, copied), "core long").groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    cores = materialise(cores, "cores")
    total = cores.agg(F.sum("k")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, total * length * 3 // 2 // BUCKET_BYTES)
    repeated = share(_bitmap(cores, CORE_BITS))
    hot = share(_bitmap(cores.filter(F.col("k") > HOT), HOT_BITS))
    runs = map_arrow(once, _write_runs(length, buckets, copied, repeated, hot), _RUN)
    dealt = runs.repartition(max(1, buckets // 2), "bucket").sortWithinPartitions("bucket")
    whole = copies.select(F.col("id").alias("text"), F.array(F.lit(0)).alias("begins"), F.array("n").alias("ends"))
    found = materialise(map_arrow(dealt, _merge_buckets(length), _SPANS).unionByName(whole), "spans")
    united = found.groupBy("text").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    return materialise(map_arrow(united, _unite_rows, _SPANS), "united")


def _unite_rows(batches):
    for batch in batches:
        pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        done = [unite(list(zip(b, e, strict=True))) for b, e in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in done], pa.list_(pa.int32())), pa.array([e for _, e in done], pa.list_(pa.int32()))], names=["text", "begins", "ends"])


def _mark(hit):
    """Adds whether a text may be affected."""

    def run(batches):
        for batch in batches:
            marks = _test(hit.value, batch.column(1).to_numpy(zero_copy_only=False).astype(U), CORE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], names=[*batch.schema.names, "affected"])

    return run


def cut(raw: bytes, begins: list[int], ends: list[int]) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the ranges, the bytes removed, and the maximal removed runs."""
    begins, ends = unite(list(zip(begins, ends, strict=True)))
    kept = [raw[e:b] for e, b in zip([0, *ends], [*begins, len(raw)], strict=True)]
    return b"".join(kept), sum(ends) - sum(begins), len(begins)


def _cut_rows(batches):
    for batch in batches:
        raw, begins, ends = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        out = [cut(x, b or [], e or []) for x, b, e in zip(raw, begins, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([n for _, n, _ in out], pa.int64()), pa.array([k for _, _, k in out], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _, _ in out], pa.string()), pa.array([x.decode("utf-8", "ignore") for x, _, _ in out], pa.string())],
            names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
        )


def _cut_all(texts: DataFrame, length: int) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, text) of texts (text, key); key may be of any type."""
    spark = texts.sparkSession
    key = T.StructField("key", texts.schema["key"].dataType)
    long_ = lambda n: T.StructField(n, T.LongType())
    string = lambda n: T.StructField(n, T.StringType())
    spans = repeated_spans(texts.select("text"), length)
    hit = spark.sparkContext.broadcast(_bitmap(spans.select(F.col("text").alias("core")), CORE_BITS))
    marked = materialise(map_arrow(_with_id(texts, "key"), _mark(hit), T.StructType([string("text"), long_("id"), key, T.StructField("affected", T.BooleanType())])), "marked")
    none = F.lit(0).cast("long")
    whole = marked.filter("not affected").select("key", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), "text")
    ranges = spans.agg(F.sum(F.size("begins"))).first()[0] or 0
    of_id = spans.withColumnRenamed("text", "id")
    affected = marked.filter("affected").join(F.broadcast(of_id) if ranges <= BROADCAST_RANGES else of_id, "id", "left").select("key", "text", "begins", "ends")
    return whole.unionByName(map_arrow(affected, _cut_rows, T.StructType([key, long_("n_bytes"), long_("n_removed"), long_("n_spans"), string("kept_sha256"), string("text")])))


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) for every row of ``docs`` (doc_id, text).

    ``text`` is what is left; bytes of characters that were cut through are dropped from it (but
    not from the digest).
    """
    return _cut_all(docs.select("text", F.col("doc_id").cast("long").alias("key")), length).withColumnRenamed("key", "doc_id")


def drop_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with the remaining text as ``text``; all rows and columns stay, and n_chars, if any, is counted anew.

    A null text stays null.
    """
    names = docs.columns
    row = F.struct(F.col("text").isNull().alias("none"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"], F.lit(0).alias("one more")).alias("row"))
    done = _cut_all(docs.select("text", row.alias("key")), length)
    text = F.when(~F.col("key.none"), F.col("text"))
    count = F.when(F.col("n_removed") > 0, F.char_length(text)).otherwise(F.col("key.row.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None
    return done.select(*[text.alias(c) if c == "text" else count.alias(c) if c == "n_chars" else F.col(f"key.row.`{c}`").alias(c) for c in names])
