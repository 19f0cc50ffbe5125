"""Vectorised words, hashes and shingles over Arrow string columns.

A string column already is one run of UTF-8 bytes with offsets, so whole blocks
of documents are cut into words and hashed by a few numpy passes, with no Python
work per word.  Blocks are bounded by bytes, not rows: one very long text is a
block of its own and nothing is ever cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Bytes between words: space, tab, newline, vertical tab, form feed, return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Odd multipliers of the positions in a window of words.
WINDOW = np.array([(0xD1342543DE82EF95 * (2 * k + 1) ** 5 | 1) & (2**64 - 1) for k in range(16)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets from 0; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    """The words of a block: byte spans, and for document ``d`` the words ``first[d]:first[d + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def cut(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that are no breaks, never across documents."""
    inside = ~breaks[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    starts[head] = inside[head]
    ends[tail] = inside[tail]
    start = np.flatnonzero(starts)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def windows(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words inside documents, and their bounds by document."""
    n = len(word)
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if n < k:
        return np.zeros(0, np.uint64), bounds
    acc = word[: n - k + 1] * WINDOW[0]
    for j in range(1, k):
        acc += word[j : n - k + 1 + j] * WINDOW[j]
    keep = np.zeros(n + 1, np.int32)  # windows that start in a document and end in it
    long = counts > 0
    np.add.at(keep, first[:-1][long], 1)
    np.add.at(keep, first[:-1][long] + counts[long], -1)
    return mix(acc[np.cumsum(keep[: n - k + 1]) > 0]), bounds
