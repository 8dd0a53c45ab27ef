"""Numpy views of Arrow text columns: word boundaries, word hashes and byte n-grams for whole blocks of documents.

All functions work on one block: the bytes of some documents, one after another.  Blocks are cut at document
boundaries, so that memory follows ``BLOCK_BYTES`` (or the longest single text), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_900_000          # under 2^21, the size of the table of powers
BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
MASK64 = (1 << 64) - 1
SPACE = 0x20


def byte_class(keep) -> np.ndarray:
    """Table of 256 truth values from a predicate on byte values."""
    return np.array([bool(keep(b)) for b in range(256)])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LETTER = byte_class(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a NULL has no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if column.null_count and np.any(np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)]):
        return column_bytes(column.fill_null("").combine_chunks() if hasattr(column, "combine_chunks") else column.fill_null(""))
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end, bytes, offsets from 0) of about ``limit`` bytes; a longer text is a run of its own."""
    data, offsets = column_bytes(column)
    first, n = 0, len(column)
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


class Words:
    """The words of one block: lower-cased text in which every word is followed by exactly one space.

    ``text``: the bytes; ``start``, ``end``: of each word in it; ``doc``: row of each word; ``first``: index of
    each row's first word (one more entry than rows).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool = True):
        rows = len(offsets) - 1
        lengths = np.diff(offsets)
        spread = np.full(len(data) + rows, SPACE, np.uint8)     # a blank after each row, so that words end with it
        at = np.arange(len(data)) + np.repeat(np.arange(rows), lengths)
        spread[at] = LOWER[data] if lower else data
        inside = keep[spread]
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & ~before)
        self.doc = np.searchsorted(offsets[1:] + np.arange(1, rows + 1), starts, side="right")
        kept = inside | before
        spread[~inside] = SPACE
        self.text = spread[kept]
        closes = (~inside)[kept]
        self.end = np.flatnonzero(closes)
        self.start = np.empty_like(self.end)
        if len(self.end):
            self.start[0] = 0
            self.start[1:] = self.end[:-1] + 1
        self.first = np.searchsorted(self.doc, np.arange(rows + 1))
        self.rows = rows

    def __len__(self) -> int:
        return len(self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word (polynomial in its bytes; equal words have equal hashes)."""
        up, down = powers(len(self.text) + 1)
        sums = np.zeros(len(self.text) + 1, np.uint64)
        np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[:len(self.text)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64; sizes are rounded up so that the table is seldom rebuilt."""
    return _powers(1 << max(16, int(size - 1).bit_length()))


def grams(text: np.ndarray, n: int, bits: int, salt: int = 0) -> np.ndarray:
    """Bucket of the ``n`` bytes that begin at each place of ``text`` (the last n - 1 places have none); n up to 8."""
    if len(text) < n:
        return np.zeros(0, np.int64)
    size = len(text) - n + 1
    code = text[:size].astype(np.uint64)
    for k in range(1, n):
        code |= text[k:k + size].astype(np.uint64) << np.uint64(8 * k)
    return bucket(code + np.uint64((n * 0x1F3D5B79 + salt * 0x2545F491) & MASK64), bits)


def bucket(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code * np.uint64(BASE)) >> np.uint64(64 - bits)).astype(np.int64)


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]`` over axis 0, zero for empty groups."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
