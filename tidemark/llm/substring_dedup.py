"""Substring dedup by words: seed and extend.

Seeds are winnowed anchors: of the 8-word grams in each 20-word window, the one with the least hash. Spans of
documents meet on equal anchors. There each match is extended both ways, word by word, as far as two spans agree;
what is at least as long as a window is a maximal repeat, and its windows go from the later document. See
``repeats`` for how spans get there, and for anchors of more spans than may be compared in pairs within a task.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import Rolling, words
from tidemark.llm.repeats import Bucketed, Units, repeated
from tidemark.llm.spread import with_text

WINDOW_WORDS = 20
ANCHOR_WORDS = 8
#: Spans of one anchor whose matches are extended in pairs.
BUCKET_SPANS = 96


def extend(b: Bucketed, window: int, anchor: int) -> np.ndarray:
    """Flags of the windows of each span that are in no maximal repeat which a smaller document has, too."""
    side = window - anchor
    number: dict[bytes, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in body.split()] for body in b.bodies]
    # Words to the left of the anchor, nearest first, and to its right. Beyond a span stands what nothing else equals.
    beyond = -1 - np.arange(len(rows) * side).reshape(-1, side)
    left, right = beyond.copy(), beyond.copy()
    core: dict[tuple[int, ...], int] = {}
    anchors = np.array([core.setdefault(tuple(row[at : at + anchor]), len(core)) for row, at in zip(rows, b.seed.tolist(), strict=True)])
    for i, (row, at) in enumerate(zip(rows, b.seed.tolist(), strict=True)):
        before, after = row[:at][::-1][:side], row[at + anchor :][:side]
        left[i, : len(before)] = before
        right[i, : len(after)] = after
    size = np.diff(b.buckets)
    end = np.repeat(b.buckets[1:], size)
    many = end - np.arange(len(rows)) - 1  # pairs with spans further down the bucket
    i = np.repeat(np.arange(len(rows)), many)
    j = i + 1 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    apart = (b.owner[i] != b.owner[j]) & (anchors[i] == anchors[j])
    i, j = i[apart], j[apart]
    reach = [np.logical_and.accumulate(part[i] == part[j], axis=1).sum(1) for part in (left, right)]
    long = reach[0] + anchor + reach[1] >= window
    i, j, to_left, to_right = i[long], j[long], reach[0][long], reach[1][long]
    later = np.where(b.owner[i] < b.owner[j], j, i)
    # A window that starts t words before the anchor lies in the repeat if side - to_right <= t <= to_left.
    change = np.zeros((len(rows), side + 2), np.int64)
    np.add.at(change, (later, b.seed[later] - to_left), 1)
    np.add.at(change, (later, b.seed[later] - (side - to_right) + 1), -1)
    return np.cumsum(change, axis=1)[:, : side + 1] == 0


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS, hash_bits: int = 64) -> DataFrame:
    """Each document without the words of windows that start earlier: doc_id, text, n_words, n_removed.

    Words are runs of anything but ASCII white space; text has the kept ones, joined by a blank. Windows are
    judged on the input. A null or blank text has no words and an empty result; texts shorter than a window
    stay whole, and very long ones are taken whole like any other. Rows with one doc_id each count as a document
    of their own, and neither as earlier than the other; rows without doc_id come after all others, in the order
    of a hash of their text. Other columns are left out, so their names don't matter; an empty table gives an
    empty result. hash_bits: of the hashes by which repeats meet before their text is compared.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor has at least one word and no more than a window")

    def units(data, ends):
        start, end, offsets = words(data, ends)
        return Units(Rolling(data).at(start, end), offsets, start, end)

    def finish(piece, data, ends, gone, offsets):
        texts, removed = [], np.zeros(len(piece), np.int64)
        for i in range(len(piece)):
            own, out = data[ends[i] : ends[i + 1]].tobytes().split(), gone[offsets[i] : offsets[i + 1]]
            removed[i] = np.count_nonzero(out)
            texts.append(b" ".join(compress(own, ~out) if removed[i] else own).decode())
        return pa.record_batch([piece.column("doc_id"), pa.array(texts, pa.string()), pa.array(np.diff(offsets)), pa.array(removed)], ["doc_id", "text", "n_words", "n_removed"])

    decide = lambda b: extend(b, window, anchor)
    return repeated(with_text(docs), units, window, anchor, decide, lambda raw: b" ".join(raw.split()), BUCKET_SPANS, finish, "doc_id long, text string, n_words long, n_removed long", hash_bits)
