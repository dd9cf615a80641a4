"""Words and their hashes for whole Arrow columns, with numpy and no Python loop over words.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A word is known by a 64-bit hash: two of n distinct
words share one with probability n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18  # numpy works on so much text at a time; a longer document is a chunk of its own

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_RNG = np.random.Generator(np.random.PCG64(20240101))
RANDOM_OF_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_RANDOM = RANDOM_OF_BYTE[LOWER]
BASE = 0x9E3779B97F4A7C17  # odd, so it has an inverse modulo 2 ** 64
KEPT_POWERS = 1 << 21
_POWERS: dict[str, np.ndarray] = {}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        steps = np.full(max(n, CHUNK_BYTES) + 1, base % (1 << 64), dtype=np.uint64)
        steps[0] = 1
        grown = np.multiply.accumulate(steps)
        if n > KEPT_POWERS:  # of a very long text: not kept
            return grown[:n]
        _POWERS[name] = grown
    return _POWERS[name][:n]


def powers(n: int) -> np.ndarray:
    return _grown("up", BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _grown("down", pow(BASE, -1, 1 << 64), n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one array of UTF-8 bytes and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about `limit` bytes, CHUNK_BYTES unless given."""
    first, n, limit = 0, len(offsets) - 1, limit or CHUNK_BYTES
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[k] * BASE ** k over i <= k < j, modulo 2 ** 64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each range, the same wherever its content stands."""
    return (prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start]


def bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true `inside`, never across rows, and where each row's runs begin."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    full = offsets[1:] > offsets[:-1]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, where each row's words begin, byte start and byte end of each word)."""
    start, end, rows = bounds(data, offsets, ~SPACE[data])
    h = range_hashes(prefix_hashes(LOWER_RANDOM[data]), start, end)
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), rows, start, end


def shingles(word: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of each run of `size` words; a shorter row gives its whole sequence, an empty one nothing."""
    n = np.diff(rows)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = prefix_hashes(word)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), many)
    first = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + rows[:-1][row]
    last = np.minimum(first + size, rows[1:][row])
    return mix(range_hashes(prefix, first, last) + (last - first).astype(np.uint64)), row, first


def distinct(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts, or the sums of their values."""
    if values is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


class Lookup:
    """Positions of hashes in a fixed list, -1 for others. Two tables by different bits; what is left is searched."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.bits = max(10, int(len(keys)).bit_length() + 4)
        left = np.arange(len(keys))
        self.tables = []
        for shift in (64 - self.bits, 7):
            table = np.full(1 << self.bits, -1, np.int32)
            slot = self._slot(self.keys[left], shift)
            table[slot] = left
            left = left[table[slot] != left]
            self.tables.append((shift, table))
        self.rest = left[np.argsort(self.keys[left])]

    def _slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return out
        for shift, table in self.tables:
            at = table[self._slot(h, shift)]
            found = (at >= 0) & (self.keys[at] == h)
            out[found] = at[found]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.keys[self.rest], h), len(self.rest) - 1)
            found = self.keys[self.rest][at] == h
            out[found] = self.rest[at[found]]
        return out
