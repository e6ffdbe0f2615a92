"""Vectorised word splitting and hashing over Arrow string columns.

Whole record batches are handled as bytes: word boundaries come from a 256-entry class table and word
hashes from prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 18
#: The same where a chunk has no costs of its own, so that eight bytes for each byte of text stay in a core's cache.
CACHED_BYTES = 1 << 16

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_COMBINE = _U(0xD1342543DE82EF95)
_BYTE_KEYS = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _byte_class(separators: list[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[separators] = False
    return table


#: Words [^\x20\x09-\x0D]+: white space separates.
SPACE_WORDS = _byte_class([0x20, *range(0x09, 0x0E)])
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are in lower case.
ALNUM_WORDS = _byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
_FOLDED_KEYS = _BYTE_KEYS[FOLD]

_powers: dict[str, np.ndarray] = {}


def power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if len(table) <= 4 * CHUNK_BYTES:
            _powers[name] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` of bytes, for a table of bytes or booleans."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string column; null reads as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose text is at most ``limit`` bytes (default: CHUNK_BYTES), or one row."""
    limit = limit or CHUNK_BYTES
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, rows)
        low = min(high, rows)


class Words:
    """The words of some rows: ``start`` and ``end`` in bytes, ``bounds`` (rows + 1) into the words, ``hash``.

    A word is a longest run of bytes to which ``table`` gives the same value, other than 0.
    """

    __slots__ = ("start", "end", "bounds", "hash", "raw", "fold", "folded", "offsets")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool):
        n = len(data)
        self.raw, self.fold, self.folded, self.offsets = data, fold, None, offsets
        kind = mapped(data, table[FOLD] if fold else table)
        inside = kind != 0
        # Where a run begins; it ends where the next one does.
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:] = kind[1:] != kind[:-1]
        first[offsets[:-1][offsets[:-1] < n]] = True
        last[:-1] = first[1:]
        self.start = np.flatnonzero(inside & first)
        self.end = np.flatnonzero(inside & last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        keys, total = (_FOLDED_KEYS if fold else _BYTE_KEYS).take(data, mode="clip"), np.zeros(n + 1, np.uint64)
        keys *= power_table("power", BASE, n)[:n]
        np.cumsum(keys, out=total[1:])
        self.hash = total.take(self.end, mode="clip")
        self.hash -= total.take(self.start, mode="clip")
        self.hash *= power_table("inverse", BASE_INVERSE, n).take(self.start, mode="clip")
        self.hash = mix(self.hash)

    @property
    def data(self) -> np.ndarray:
        """The bytes that start and end are places in, folded if words are; made when first asked for."""
        if self.folded is None:
            self.folded = mapped(self.raw, FOLD) if self.fold else self.raw
        return self.folded

    def grams(self, k: int) -> np.ndarray:
        """Hashes of k consecutive words by first word, without regard to rows; see :meth:`gram_mask`."""
        h, n = self.hash, max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _COMBINE + h[j : j + n]
        return mix(out + _U(k))

    def gram_mask(self, k: int) -> np.ndarray:
        """Which of :meth:`grams` lie within one row."""
        n = max(0, len(self.hash) - k + 1)
        row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return row[:n] == row[k - 1 : k - 1 + n]

    def text(self, low: int, high: int) -> str:
        """Words low to high - 1, as they stand, joined by a space."""
        return " ".join(self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace") for i in range(low, high))


def words_of(column: pa.Array, table: np.ndarray, fold: bool = True, limit: int | None = None) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, their words), a chunk of at most ``limit`` bytes (default: CHUNK_BYTES) at a time."""
    offsets, data = utf8(column)
    for low, high in chunks(offsets, limit):
        yield low, high, Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], table, fold)


def gram_hash(words: list[str]) -> int:
    """The hash that :meth:`Words.grams` gives these words."""
    column = pa.array([" ".join(words)], pa.string())
    (_, _, w), = words_of(column, SPACE_WORDS, fold=False)
    return int(w.grams(len(words))[0])
