"""Suffix-array dedup by bytes: bucket-pointer refinement over sampled suffixes.

A full suffix array of a corpus is a row for each byte, which no shuffle budget bears. Here the suffixes are
sampled (of each 100-byte window the one that starts with the least-hashed 32-gram) and fall into buckets by that
q-gram; most are settled by then. See ``repeats`` for this part, and for buckets that are too large for a task.

The suffixes of all windows in the buckets that aren't settled are sorted by refinement: they start in buckets
by their first eight bytes, and the members of a bucket are sorted on the bucket pointers of a later offset, which
gives them pointers of their own. These are reused by the next round, so the depth doubles until all that a window
holds is compared, or all buckets are settled. Equal pointers at that depth mean equal bytes; no hash decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.repeats import Bucketed, Units, repeated
from tidemark.llm.spread import with_text

LENGTH_BYTES = 100
GRAM_BYTES = 32
#: Bytes that the first buckets go by.
FIRST_BYTES = 8
#: Sampled suffixes of one q-gram that a task refines.
BUCKET_SPANS = 4_096


def pointers(data: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Bucket pointers of the suffixes of data to that depth, and how many rounds of refinement they took.

    room: bytes from each place to the end of its string. A pointer is the place of the bucket's first member in
    the order of suffixes; places with less room than the depth have none that means anything.
    """
    first = min(FIRST_BYTES, depth)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (8 - first))
    pointer = np.full(len(data), -1, np.int64)
    places = np.flatnonzero(room >= first)
    order = places[np.argsort(value[places])]
    key, reached, rounds, base = value[order], first, 0, np.zeros(len(order), np.int64)
    while True:
        # order holds members bucket by bucket, sorted; base is the pointer of the bucket that they were in
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (base[1:] != base[:-1])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        bucket = np.ones(len(order), bool)
        bucket[1:] = base[1:] != base[:-1]
        within = begin - np.maximum.accumulate(np.where(bucket, np.arange(len(order)), 0))
        now = base + within
        pointer[order] = now
        if reached >= depth:
            return pointer, rounds
        many = np.zeros(len(order), bool)
        many[1:] = ~new[1:]
        many[:-1] |= ~new[1:]
        step = min(reached, depth - reached)
        open_ = order[many & (room[order] >= reached + step)]  # a member that is alone in its bucket is settled
        if not len(open_):
            return pointer, rounds
        own, later = pointer[open_], pointer[open_ + step]
        by = np.argsort(own * len(data) + later)
        order, key, base = open_[by], later[by], own[by]
        reached += step
        rounds += 1


def refine(b: Bucketed, length: int, width: int) -> np.ndarray:
    """Flags of the windows of each span that are in no smaller document's span."""
    data = np.frombuffer(b"".join(b.bodies), np.uint8)
    sizes = np.array([len(x) for x in b.bodies], np.int64)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(data))
    pointer, _ = pointers(data, room, length)
    which = np.repeat(np.arange(len(sizes)), b.windows)
    within = np.arange(len(which)) - np.repeat(np.cumsum(b.windows) - b.windows, b.windows)
    own, key = b.owner[which], pointer[(ends - sizes)[which] + within]
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=-2))  # pointers are -1 at least
    least = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.append(first, len(order))))
    out = np.zeros((len(sizes), width), bool)
    out[which[order], within[order]] = own[order] == least
    return out


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH_BYTES, gram: int = GRAM_BYTES, hash_bits: int = 64) -> DataFrame:
    """Each document without the bytes of strings that start earlier: doc_id, kept, n_bytes, n_removed, n_spans.

    kept is binary, as a cut may part the bytes of one character; n_spans counts the maximal runs removed.
    Strings are judged on the input; matches don't cross documents. Null and empty texts have no bytes; texts
    shorter than ``length`` stay whole, very long ones are taken whole. Repeated and missing ids, other columns
    empty tables and hash_bits are taken as in ``substring_dedup``.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram has at least one byte and no more than the length")

    def units(data, ends):
        place = np.arange(len(data))
        return Units(data, ends, place, place + 1)

    def finish(piece, data, ends, gone, _):
        edge = np.zeros(len(gone) + 1, np.int64)
        edge[1:] = np.cumsum(gone)
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        first[ends[:-1][ends[:-1] < len(gone)]] |= gone[ends[:-1][ends[:-1] < len(gone)]]
        runs = np.concatenate([[0], np.cumsum(first)])
        kept = [(data[a:b] if c == d else data[a:b][~gone[a:b]]).tobytes() for a, b, c, d in zip(ends[:-1], ends[1:], edge[ends[:-1]], edge[ends[1:]], strict=True)]
        counts = [pa.array(x) for x in (np.diff(ends), np.diff(edge[ends]), np.diff(runs[ends]))]
        return pa.record_batch([piece.column("doc_id"), pa.array(kept, pa.binary()), *counts], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    decide = lambda b: refine(b, length, length - gram + 1)
    return repeated(with_text(docs), units, length, gram, decide, bytes, BUCKET_SPANS, finish, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long", hash_bits)
