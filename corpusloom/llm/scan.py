"""Words and hashes of whole Arrow batches of texts, computed on the bytes without a Python object per word.

Words are maximal runs of `[^\\x20\\x09-\\x0D]`. All separators are ASCII, so the bytes of UTF-8 suffice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes handled at once. A single longer text is handled whole, in pieces of this size where arrays are wide.
CHUNK = 2 << 20

_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[~_WORD] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15


class Words(NamedTuple):
    """Words of the rows `first` to `last` of a batch: bytes, bounds, row of each word and its hash."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray


def coefficients(n: int, seed: int) -> np.ndarray:
    """Random odd 64-bit factors, the same in every process."""
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def rows_up_to(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together, or of one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(offsets: np.ndarray, data: np.ndarray, member: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words, runs of the bytes that `member` marks; no word crosses a row."""
    word = member[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    marks = offsets[(offsets > 0) & (offsets < len(data))]
    first[marks] = word[marks]
    last[marks - 1] = word[marks - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, member: np.ndarray = _WORD) -> np.ndarray:
    """64-bit hash of each word: a polynomial over random byte values, finalised with the length."""
    value = np.where(member, _BYTE, np.uint64(0))
    out = np.empty(len(starts), dtype=np.uint64)
    longest = int((ends - starts).max(initial=1))
    powers = np.empty(longest, dtype=np.uint64)
    powers[0] = 1
    powers[1:] = np.uint64(_BASE)
    np.cumprod(powers, out=powers)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        low, high = starts[i], ends[j - 1]
        local = starts[i:j] - low
        place = np.arange(high - low) - np.repeat(local, np.diff(np.append(local, high - low)))
        values = value[data[low:high]] * powers[np.minimum(place, longest - 1)]
        out[i:j] = np.add.reduceat(values, local)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a column, some rows at a time, rows in order; rows without words have no entry."""
    offsets, data = buffers(column)
    for first, last in rows_up_to(offsets):
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = _LOWER[part]
        local = offsets[first : last + 1] - offsets[first]
        starts, ends = word_bounds(local, part)
        row = first + np.searchsorted(local, starts, side="right") - 1
        yield Words(first, last, part, starts, ends, row, word_hashes(part, starts, ends))


def grams(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hash of every run of len(factors) consecutive words, also of runs that cross rows."""
    n = len(hashes) - len(factors) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j, factor in enumerate(factors):
        total += hashes[j : j + n] * factor
    return mix(total)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.uint8)
    ends = np.cumsum(lengths)
    return data[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def strings(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """An Arrow column over one buffer of all values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    large = pa.large_string() if kind == pa.string() else pa.large_binary()
    buffers_ = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(large, len(lengths), buffers_).cast(kind)


def segments(row: np.ndarray, first: int, last: int) -> np.ndarray:
    """Bounds of each row's words: those of row first + i are [out[i], out[i + 1])."""
    return np.searchsorted(row, np.arange(first, last + 1))
