"""Numpy helpers that look at a batch of texts as one run of bytes.

A batch arrives as an Arrow string column. ``pieces`` gives slices of bounded size, so that the arrays below
(eight bytes for each byte or word) stay small; only a single text longer than the bound makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Small enough that the arrays stay in a core's cache.
PIECE_BYTES = 1 << 17
#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes.
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 2**64)
#: White space as the contracts list it: blank, and tab to carriage return.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes that split words when only letters, digits and non-ASCII characters count.
NOT_ALNUM = np.isin(np.arange(256), [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with their texts' bytes and offsets. A null text has no bytes."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        to = min(to, len(texts))
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (BASE, INVERSE):
        steps = np.full(size, x, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


class Rolling:
    """Hashes of any stretch of a sequence in constant time: the same values give the same hash wherever they stand."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(16, int(len(values) + 1).bit_length())
        self.power, inverse = _powers(size)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * inverse[: len(values)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """The hash of each stretch of that length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.power[:n] + np.uint64(length))


def words(data: np.ndarray, ends: np.ndarray, splits: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the offsets of each text's words."""
    inside = ~splits[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[ends[:-1][ends[:-1] < len(data)]] = False
        after[ends[1:][ends[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, ends)


def sliding(a: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or greatest) of each stretch of that width."""
    done = 1
    while 2 * done <= width:
        a = best(a[:-done], a[done:]) if len(a) > done else a[:0]
        done *= 2
    if (rest := width - done) > 0:
        a = best(a[:-rest], a[rest:]) if len(a) > rest else a[:0]
    return a


def inside_texts(ends: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each of n starts: whether that length from there stays in one text."""
    change = np.zeros(n + 1, np.int64)
    last = np.maximum(ends[1:] - length + 1, ends[:-1])
    np.add.at(change, np.minimum(last, n), 1)
    np.add.at(change, np.minimum(ends[1:], n), -1)
    return np.cumsum(change[:n]) == 0


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a stretch of that length from one of the starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:n]) > 0


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of longs as values and offsets; null is empty."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    sizes = np.asarray(pc.fill_null(pc.list_value_length(a), 0)).astype(np.int64)
    values = np.asarray(a.flatten()) if len(a) else np.zeros(0, np.int64)
    return values.astype(np.int64, copy=False), np.concatenate([[0], np.cumsum(sizes)])
