"""Ranked lexical search: WAND in every shard of documents, heaps of shards merged.

A task reads documents and keeps, shard by shard, the postings of the terms that are asked for: document, term and
what the term adds to the document's score there (its *impact*). Each term's greatest impact in the shard bounds
what it can add to any document. WAND walks the postings of an item's terms at once, by document. The *pivot* is
the first document at which the bounds of the terms that come up at or before it could beat the heap's last entry;
all cursors before it jump there, and no document in between is looked at. The pivot's own impacts are added up
only if the bounds of the terms that are really there could still beat it.

Many items are searched side by side, a step choosing one pivot for each. A task's heap outlives its shards, so
later shards start with its threshold. Heaps of tasks (k rows for each item) are merged by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import LOWER, NOT_ALNUM, Rolling, pieces, words
from tidemark.llm.spread import with_text

#: Text of items that is sent to every task at once. More items are searched block by block, a job each.
BLOCK_BYTES = 8 * 2**20
#: Postings in a shard's index (some 40 bytes each), and cursors of items that are searched side by side.
SHARD_POSTINGS, CURSORS = 1 << 20, 1 << 14
#: Fixed values of the measure: weights are thousandths, impacts rise with the count over it and the length.
SCALE, SATURATION, LENGTH_PERCENT = 1_000_000_000, 8, 75


class Terms:
    """The distinct terms of some items, and each item's terms with their repeats."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        raw = [(t or "").encode() for _, t in items]
        data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        start, end, offsets = words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), NOT_ALNUM)
        number: dict[bytes, int] = {}
        token = np.array([number.setdefault(data[a:b].tobytes(), len(number)) for a, b in zip(start, end, strict=True)], np.int64)
        size = np.array([len(t) for t in number], np.int64)
        self.bytes = np.frombuffer(b"".join(number), np.uint8)
        first = np.cumsum(size) - size
        hashes = Rolling(self.bytes).at(first, first + size)
        self.order = np.argsort(hashes)  # by hash; a term's number stays the order in which it came up
        self.hash, self.first, self.size = hashes[self.order], first[self.order], size[self.order]
        self.crowd = int(np.unique(hashes, return_counts=True)[1].max(initial=0))  # terms of one hash: one, as a rule
        self.item = [np.unique(token[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def __len__(self) -> int:
        return len(self.order)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of the term that each word is, by its bytes, or -1."""
        out = np.full(len(start), -1, np.int64)
        hashes = Rolling(data).at(start, end)
        low = np.searchsorted(self.hash, hashes)
        for step in range(self.crowd):
            at = np.minimum(low + step, len(self.hash) - 1)
            word = np.flatnonzero((self.hash[at] == hashes) & (self.size[at] == end - start))
            at = at[word]
            for i in range(int(self.size[at].max(initial=0))):
                long = self.size[at] > i
                same = np.ones(len(at), bool)
                same[long] = data[start[word[long]] + i] == self.bytes[self.first[at[long]] + i]
                if not same.all():
                    word, at = word[same], at[same]
            out[word] = self.order[at]
        return out

    def counts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; and text, term and count where terms come up, by text and term."""
        data = LOWER[data]
        start, end, offsets = words(data, ends, NOT_ALNUM)
        term = self.find(data, start, end)
        text = np.repeat(np.arange(len(ends) - 1), np.diff(offsets))
        here = term >= 0
        pair, count = np.unique(text[here] * max(1, len(self)) + term[here], return_counts=True)
        return np.diff(offsets), pair // max(1, len(self)), pair % max(1, len(self)), count


class Index:
    """Postings of a shard: by term and document, with their impacts, and each term's greatest."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        self.docs = docs
        self.key = term * (docs + 1) + doc  # a document's number is below docs, which stands for the end of a list
        order = np.argsort(self.key)
        self.key, self.doc, self.impact = self.key[order], np.append(doc[order], docs), np.append(impact[order], 0)
        self.first = np.searchsorted(self.key, np.arange(terms + 1) * (docs + 1))
        self.most = np.zeros(terms, np.int64)
        np.maximum.at(self.most, term, impact)

    def seek(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first posting of each term at or after a document."""
        return np.searchsorted(self.key, term * (self.docs + 1) + doc)

    def at(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The document of a posting; beyond a term's list, the number of documents."""
        return np.where(place < self.first[term + 1], self.doc[np.minimum(place, len(self.key))], self.docs)


def wand(index: Index, term: np.ndarray, repeats: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents of a shard for some items whose scores beat their floor, best first, and how many were scored.

    term, repeats: a row for each item, padded with repeats of 0. Documents are numbered in the order in which ties
    go. Returns documents and scores, a row for each item, filled up with the number of documents and 0.
    """
    rows = len(term)
    top_doc, top = np.full((rows, k), index.docs), np.zeros((rows, k), np.int64)
    bound = index.most[term] * repeats
    place = index.first[term]
    doc = np.where(bound > 0, index.at(term, place), index.docs)
    least, row, looked_at = floor.copy(), np.arange(rows), 0
    while len(row):
        order = np.argsort(doc, axis=1)
        reach = np.cumsum(np.take_along_axis(bound, order, 1), axis=1) > least[row, None]
        nth = reach.argmax(1)
        pivot = np.take_along_axis(doc, np.take_along_axis(order, nth[:, None], 1), 1)[:, 0]
        go = reach[np.arange(len(row)), nth] & (pivot < index.docs)
        if not go.all():
            row, term, repeats, bound, place, doc, pivot = (x[go] for x in (row, term, repeats, bound, place, doc, pivot))
        i, j = np.nonzero(doc < pivot[:, None])
        place[i, j] = index.seek(term[i, j], pivot[i])
        doc[i, j] = index.at(term[i, j], place[i, j])
        here = doc == pivot[:, None]
        open_ = np.flatnonzero((bound * here).sum(1) > least[row])
        looked_at += len(open_)
        score = np.where(here[open_], index.impact[np.minimum(place[open_], len(index.key))] * repeats[open_], 0).sum(1)
        better = score > least[row[open_]]
        if better.any():
            into, score, new = row[open_[better]], score[better], pivot[open_[better]]
            scores = np.column_stack([top[into], score])  # a new document comes after all before it, so it loses ties
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            top[into] = np.take_along_axis(scores, best, 1)
            top_doc[into] = np.take_along_axis(np.column_stack([top_doc[into], new]), best, 1)
            least[into] = np.maximum(least[into], top[into, -1])
        i, j = np.nonzero(here)
        place[i, j] += 1
        doc[i, j] = index.at(term[i, j], place[i, j])
    return top_doc, top, looked_at


class Heaps:
    """The best documents of each item that a task has seen: scores, ids, and whether there is an id. Ties go by id, none last."""

    def __init__(self, terms: Terms, weight: np.ndarray, documents: int, words_: int, k: int):
        self.terms, self.weight, self.documents, self.words, self.k = terms, weight, documents, words_, k
        self.score, self.id = np.zeros((len(terms.ids), k), np.int64), np.zeros((len(terms.ids), k), np.int64)
        self.null = np.zeros((len(terms.ids), k), bool)
        self.shard: list[tuple[np.ndarray, ...]] = []
        self.size, self.scored = 0, 0
        asked = sorted((i for i, (t, _) in enumerate(terms.item) if len(t)), key=lambda i: len(terms.item[i][0]))
        self.groups: list[list[int]] = [[]]
        for i in asked:  # items of like size side by side, few enough cursors at a time
            if self.groups[-1] and (len(self.groups[-1]) + 1) * len(terms.item[i][0]) > CURSORS:
                self.groups.append([])
            self.groups[-1].append(i)

    def length(self, n: np.ndarray) -> np.ndarray:
        rate = LENGTH_PERCENT * self.documents
        if len(n) and int(n.max()) * rate >= 2**63:
            return np.array([100 - LENGTH_PERCENT + int(x) * rate // self.words for x in n], np.int64)
        return 100 - LENGTH_PERCENT + n * rate // self.words

    def add(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, text: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        impact = self.weight[term] * ((SCALE * count) // (1000 * count + SATURATION * self.length(n)[text]))
        held, text = np.unique(text, return_inverse=True)
        self.shard.append((ids[held], null[held], text, term, impact))
        self.size += len(term)
        if self.size >= SHARD_POSTINGS:
            self.close()

    def close(self) -> None:
        """Searches the shard and starts another."""
        if not self.shard or not self.size:
            return
        ids, null, text, term, impact = zip(*self.shard, strict=True)
        base = np.cumsum([0, *map(len, ids[:-1])])
        doc = np.concatenate([t + b for t, b in zip(text, base, strict=True)])
        ids, null, term, impact = map(np.concatenate, (ids, null, term, impact))
        order = np.lexsort((ids, null))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        ids, null = np.append(ids[order], 0), np.append(null[order], False)
        index = Index(term, number[doc], impact, len(order), len(self.terms))
        for group in self.groups:
            width = len(self.terms.item[group[-1]][0]) if group else 0
            terms, repeats = np.zeros((len(group), width), np.int64), np.zeros((len(group), width), np.int64)
            for row, i in enumerate(group):
                own, many = self.terms.item[i]
                terms[row, : len(own)], repeats[row, : len(own)] = own, many
            floor = np.maximum(self.score[group, -1] - 1, 0)  # equals may win by their id
            found, score, scored = wand(index, terms, repeats, floor, self.k)
            self.scored += scored
            score = np.concatenate([self.score[group], score], axis=1)
            name = np.concatenate([self.id[group], ids[found]], axis=1)
            none = np.concatenate([self.null[group], null[found]], axis=1)
            best = np.lexsort((name, none, -score), axis=1)[:, : self.k]
            for own, all_ in ((self.score, score), (self.id, name), (self.null, none)):
                own[group] = np.take_along_axis(all_, best, 1)
        self.shard, self.size = [], 0


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item, of those that score above 0.

    docs: doc_id, text; items: item_id, text; other columns don't matter. Terms are runs of letters and digits
    (anything beyond ASCII counts as a letter), A-Z in lower case. Documents are ranked by score, equal ones by id,
    rows without an id last. Null, empty and wordless texts have no terms: such documents don't count, and such
    items find nothing. Very long texts are taken whole. Repeated rows of docs count and rank each; rows of items
    that share id and text are one item. Either table may be empty.
    """
    spark = docs.sparkSession
    texts = with_text(docs)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    blocks = int((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = [_block(texts, [tuple(r) for r in asked.where(part == b).collect()], k) for b in range(blocks)]  # bounded by block_bytes
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    numbered = [f.withColumn("block", F.lit(i)) for i, f in enumerate(found)]
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, numbered).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _block(texts: DataFrame, items: list[tuple[int | None, str | None]], k: int) -> DataFrame | None:
    """item (its number in the block), item_id, doc_id and score: the heaps of all tasks. Nothing, if there is nothing to find."""
    sc = texts.sparkSession.sparkContext
    terms = Terms(items)
    if not len(terms):
        return None
    sent = sc.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, total = np.zeros(len(sent.value), np.int64), 0, 0
        for batch in batches:
            for _, data, ends in pieces(batch):
                n, _, term, _ = sent.value.counts(data, ends)
                held += np.bincount(term, minlength=len(held))
                documents, total = documents + int(np.count_nonzero(n)), total + int(n.sum())
        some = np.flatnonzero(held)
        rows = [np.append(some, [-1, -2]), np.append(held[some], [documents, total])]
        yield pa.record_batch([pa.array(x) for x in rows], ["term", "n"])

    sums = {r["term"]: r["n"] for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, total = sums.pop(-1, 0), sums.pop(-2, 0)
    if not sums:
        return None
    weight = np.zeros(len(terms), np.int64)
    for term, df in sums.items():
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    weights = sc.broadcast(weight)

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Heaps(sent.value, weights.value, documents, total, k)
        for batch in batches:
            for piece, data, ends in pieces(batch):
                n, text, term, count = sent.value.counts(data, ends)
                column = piece.column("doc_id")
                ids, null = np.asarray(column.fill_null(0)), np.asarray(column.is_null())
                best.add(ids, null, n, text, term, count)
        best.close()
        item, place = np.nonzero(best.score > 0)
        ids = pa.array(best.id[item, place], pa.int64(), mask=best.null[item, place])
        names = pa.array([best.terms.ids[i] for i in item], pa.int64())
        yield pa.record_batch([pa.array(item), names, ids, pa.array(best.score[item, place])], ["item", "item_id", "doc_id", "score"])

    return texts.mapInArrow(heaps, "item long, item_id long, doc_id long, score long")
