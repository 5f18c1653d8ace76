"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, hashes and shingles.

Words are separated by ASCII bytes only, so bytes and code points give the same words, and
lower-casing A-Z is a byte table. A hash of any byte range comes from one prefix sum over
the buffer: ``(H[e] - H[s]) * B**-s`` modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 1 << 20
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random odd value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _TABLES or len(_TABLES["p"]) < n:
        n = (n // _STEP + 1) * _STEP
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            t = np.full(n, base, dtype=U)
            t[0] = 1
            _TABLES[key] = np.multiply.accumulate(t)
    return _TABLES["p"], _TABLES["i"]


def fold_table(separators: Iterator[int] | list[int]) -> np.ndarray:
    """256 bytes: 0 for a separator, else the byte with A-Z lower-cased; NUL, no separator, as a byte that UTF-8 never has."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 255
    t[65:91] += 32
    t[list(separators)] = 0
    return t


#: Words [^\x20\x09-\x0D]+ : separated by blanks only.
BLANKS = fold_table([0x20, *range(0x09, 0x0E)])
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a-z and all beyond ASCII.
ALNUM = fold_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, null as empty, and the n+1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, start = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[start : start + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class RangeHash:
    """Hashes of byte ranges of one buffer, each from two prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.p, self.i = _powers(n + 1)
        self.h = np.empty(n + 1, dtype=U)
        self.h[0] = 0
        np.cumsum(BYTE_VALUE[data] * self.p[:n], out=self.h[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.h[end] - self.h[start]) * self.i[start])

    def fixed(self, width: int) -> np.ndarray:
        """The hash of every range of ``width`` bytes, unmixed and by start."""
        n = len(self.h) - width
        return (self.h[width:] - self.h[:n]) * self.i[:n] if n > 0 else np.zeros(0, U)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of the rows, and the n+1 offsets of each row's words."""
    folded = table[data]
    n = len(folded)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, RangeHash(folded)(starts, ends), np.searchsorted(starts, offsets)


_PLACE = mix(np.arange(1, 65, dtype=U) * U(0x8CB92BA72F3D8DD7)) | U(1)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` words in a row, by first word; across rows too, which callers skip."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    total = hashes[:n] * _PLACE[0]
    for k in range(1, width):
        total += hashes[k : k + n] * _PLACE[k]
    return mix(total + U(width))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, table: np.ndarray = BLANKS) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles.

    A row of fewer words has one, of the whole sequence; a row without words has none.
    """
    _, _, hashes, bounds = words(data, offsets, table)
    whole = windows(hashes, width)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s >= width:
            x = np.sort(whole[s : e - width + 1])
            yield x if len(x) < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif e > s:
            yield windows(hashes[s:e], e - s)
        else:
            yield np.zeros(0, U)
