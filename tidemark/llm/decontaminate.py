"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark's items, the text is a document's words (as 64-bit hashes).
Patterns of one length share a set of tables: a shift table over blocks of two words tells how far a search may
advance, and where it may not, the hash of the window's suffix selects a bucket of patterns, which are compared
with the text word by word. Many stretches of text are searched at once, each with a cursor of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.arrays import LOWER, NOT_ALNUM, Rolling, mix, pieces, words
from tidemark.llm.spread import cut, spread_join

WINDOW_WORDS = 10
#: Text of benchmark items that is sent to every task at once; tables take up to ten times that. A larger
#: benchmark is searched block by block, a job each.
BLOCK_BYTES = 8 * 2**20
#: Words of text for each cursor of the search.
STRIDE = 256
#: Bits of a shift table, for few and for very many patterns.
LEAST_BITS, MOST_BITS = 18, 24


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes, if they fit."""
    return a.astype(np.int32) if not len(a) or a.max() < 2**31 else a


class Benchmark:
    """The words of some items: one buffer of bytes, the words' places in it, and the items' offsets and ids."""

    def __init__(self, items: list[tuple[object, str | None]]):
        raw = [(t or "").encode() for _, t in items]
        self.ids = [i for i, _ in items]
        self.bytes = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        self.start, self.end, self.offsets = words(self.bytes, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), NOT_ALNUM)
        self.hashes = Rolling(self.bytes).at(self.start, self.end)
        self.start, self.end = narrow(self.start), narrow(self.end)

    def text(self, word: int, length: int) -> list[bytes]:
        return [self.bytes[a:b].tobytes() for a, b in zip(self.start[word : word + length], self.end[word : word + length], strict=True)]


class Tables:
    """Wu-Manber tables for patterns of one length in words. A pattern is a word to begin with; equal ones are one."""

    def __init__(self, length: int, bench: Benchmark, at: np.ndarray, item: np.ndarray):
        """at: first words of the patterns, item: their items' numbers."""
        self.length, self.bench, self.block = length, bench, min(2, length)
        whole = Rolling(bench.hashes).at(at, at + length)
        order = np.lexsort((item, whole))
        at, item, whole = at[order], item[order], whole[order]
        new = np.ones(len(at), bool)
        new[1:] = whole[1:] != whole[:-1]
        for i in range(length):  # equal hashes of other words are patterns of their own
            new[1:] |= bench.hashes[at[1:] + i] != bench.hashes[at[:-1] + i]
        first = np.flatnonzero(new)
        self.at, self.item, self.item_ends = narrow(at[first]), narrow(item), narrow(np.append(first, len(at)))
        bits = min(MOST_BITS, max(LEAST_BITS, int(2 * len(first) * length).bit_length()))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, np.uint8 if length < 256 else np.int64)
        word = bench.hashes
        for i in range(self.block - 1, length):
            key = self.key(word[self.at + i], word[self.at + max(i - 1, 0)])
            self.shift[key] = np.minimum(self.shift[key], length - 1 - i)
        suffix = self.suffix(word[self.at + length - 1], word[self.at + length - self.block])
        order = np.argsort(suffix, kind="stable")
        self.order, self.sorted = narrow(order), suffix[order]

    def items(self, pattern: int) -> set:
        """Ids of the items that hold a pattern; those without an id have none to tell."""
        held = (self.bench.ids[i] for i in self.item[self.item_ends[pattern] : self.item_ends[pattern + 1]])
        return {i for i in held if i is not None}

    def key(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return (self.suffix(last, before) >> self.down).astype(np.int64)

    def suffix(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return mix(last + mix(before)) if self.block == 2 else mix(last)

    def search(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns occur in the words of texts: first word and number of the pattern."""
        m, sizes = self.length, np.diff(ends)
        parts = np.maximum(0, -(-(sizes - m + 1) // STRIDE))
        rank = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(ends[:-1], parts) + rank * STRIDE + m - 1  # the last word of the window looked at
        stop = np.minimum(at + STRIDE, np.repeat(ends[1:], parts))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(at):
            last, before = text[at], text[at - self.block + 1]
            step = self.shift[self.key(last, before)].astype(np.int64)
            if len(here := np.flatnonzero(step == 0)):
                suffix = self.suffix(last[here], before[here])
                low, high = np.searchsorted(self.sorted, suffix, "left"), np.searchsorted(self.sorted, suffix, "right")
                many = high - low
                which = self.order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                start = np.repeat(at[here], many) - m + 1
                for i in range(m):
                    same = text[start + i] == self.bench.hashes[self.at[which] + i]
                    start, which = start[same], which[same]
                found.append((start, which))
            at = at + np.maximum(step, 1)
            at, stop = at[at < stop], stop[at < stop]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def tables(items: list[tuple[object, str | None]], window: int) -> list[Tables]:
    """Tables for the windows of items, a set for each length of pattern."""
    bench = Benchmark(items)
    sizes = np.diff(bench.offsets)
    length = np.minimum(sizes, window)
    many = np.where(sizes > 0, sizes - length + 1, 0)
    item = np.repeat(np.arange(len(sizes)), many)
    at = bench.offsets[:-1][item] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return [Tables(int(n), bench, at[length[item] == n], item[length[item] == n]) for n in np.unique(length[item])]


HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hits (first word and number of words of each occurrence) and items (sorted ids) added.

    An item with fewer words than a window is one window; an item or text without words matches nothing, as
    do nulls. Items may repeat: each id is reported. Windows of items without an id are hits like any others, but
    there is no id to report. Ids keep their type, and may be negative. docs needs a text column and may have any others, except that columns named n_words,
    hits and items are replaced. Rows, repeated or not, are judged alone, very long texts are searched whole, and
    empty tables are fine.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    taken = docs.drop("n_words", "hits", "items")
    if blocks == 1:
        return _searched(taken, items, window)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    digest = F.sha2("text", 256).alias("digest")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    once = [_searched(texts, items.where(part == block), window).where(F.size("hits") > 0) for block in range(1, blocks)]
    # Each block is a job of its own, so a task holds the tables of one. What is written is one row for each text that is hit.
    once = [cut(h.groupBy(digest).agg(F.first("hits").alias("hits"), F.first("items").alias("items"), F.count(F.lit(1)).alias("weight"))) for h in once]
    each = lambda c: F.flatten(F.collect_list(c)).alias(f"more_{c}")  # noqa: E731  # one list for each block, at most
    more = cut(reduce(DataFrame.unionByName, once).groupBy("digest").agg(each("hits"), each("items"), F.max("weight").alias("weight")))
    whole = _searched(taken.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), items.where(part == 0), window)
    limit = max(1_000, (more.agg(F.sum("weight")).first()[0] or 0) // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    both = spread_join(whole.withColumn("digest", digest), more, ["digest"], "weight", limit, "left")
    merged = lambda c: F.sort_array(F.array_distinct(F.concat(c, F.coalesce(f"more_{c}", F.array().cast(both.schema[c].dataType))))).alias(c)
    return both.select("row.*", "n_words", merged("hits"), merged("items"))


def _searched(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """docs with n_words, and what the items' windows hit in hits and items."""
    columns, of_item = docs.columns, items.schema["item_id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast(tables([tuple(r) for r in items.collect()], window))  # bounded by block_bytes
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.list_(to_arrow_type(of_item))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, ends in pieces(batch):
                data = LOWER[data]
                start, end, offsets = words(data, ends, NOT_ALNUM)
                text = Rolling(data).at(start, end)
                hits: dict[int, set] = {}
                names: dict[int, set] = {}
                for t in sent.value:
                    for at, which in zip(*t.search(text, offsets), strict=True):
                        if [data[a:b].tobytes() for a, b in zip(start[at : at + t.length], end[at : at + t.length], strict=True)] == t.bench.text(t.at[which], t.length):
                            doc = int(np.searchsorted(offsets, at, side="right")) - 1
                            hits.setdefault(doc, set()).add((int(at - offsets[doc]), t.length))
                            names.setdefault(doc, set()).update(t.items(which))
                spans = [[{"start": a, "length": n} for a, n in sorted(hits.get(i, ()))] for i in range(len(piece))]
                added = [np.diff(offsets), spans, [sorted(names.get(i, ())) for i in range(len(piece))]]
                yield pa.record_batch([*piece.columns, *(pa.array(x, kind) for x, kind in zip(added, kinds, strict=True))], [*columns, "n_words", "hits", "items"])

    schema = T.StructType([*docs.schema, T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("items", T.ArrayType(of_item))])
    return docs.mapInArrow(search, schema)


def hit_words() -> F.Column:
    """How many words of a document lie in its hits, which may overlap; sorted by start."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(s, h):
        end = h["start"] + h["length"]
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(s["to"], h["start"]))
        return F.struct((s["n"] + new).alias("n"), F.greatest(s["to"], end).alias("to"))

    return F.aggregate("hits", state, step, lambda s: s["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with the columns that they came with."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))  # no name can clash
    return find_items(whole, benchmark, window).where(F.size("hits") == 0).select("row.*")
