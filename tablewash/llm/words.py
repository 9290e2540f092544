"""Words of whole texts as numpy arrays: spans, 64-bit hashes and row numbers.

Texts are read as UTF-8 bytes straight from an Arrow column, a slice of rows at
a time, so memory follows the slice (and the longest single text), not the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# The contracts' separators: space and U+0009 to U+000D.
SPACES = (0x20, *range(0x09, 0x0E))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(32)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def is_space_free() -> np.ndarray:
    """The byte table of words between separators."""
    table = np.ones(256, dtype=bool)
    table[list(SPACES)] = False
    return table


def is_letter_or_digit() -> np.ndarray:
    """The byte table of words of ASCII letters, digits and anything beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all input bits."""
    x = (x ^ (x >> _SHIFT)) * _MIX_1
    x = (x ^ (x >> _SHIFT)) * _MIX_2
    return x ^ (x >> _SHIFT)


# One random number per byte value, and powers of an odd base by place in the word.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = np.cumprod(np.full(64, _BASE, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64))
    return _powers


@dataclass
class Words:
    """Words of some rows: ``row`` of each word counts from 0 within the slice;
    ``first`` has the index of each row's first word and, at the end, their number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, of its bytes in order."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        length = self.end - self.start
        offset = np.cumsum(length) - length
        place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(offset, length)
        byte = self.data[place + np.repeat(self.start, length)]
        value = _BYTE[byte] * powers(int(length.max()))[place]
        return mixed(np.add.reduceat(value, offset) + length.astype(np.uint64))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or a single longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> Words:
    """The maximal runs of bytes in ``table``, none of which spans two rows."""
    if lower:
        data = _LOWER[data]
    inside = table[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(row, np.arange(len(offsets)), side="left")
    return Words(data, start, end, row, first)
