"""Removal of long repeats: seeds, their buckets, and what is common to the two substring operators around them.

A *window* is ``length`` consecutive units (words or bytes) of one document. It is dropped if the same units
also start earlier: in a document with a smaller id, or earlier in the same document.

Each window is filed under its *seed*, the leftmost of the least-hashed q-grams in it, as winnowing picks them.
Equal windows have equal seeds, so only windows of one seed need comparing. Windows that share one occurrence of
a seed lie side by side; the stretch that they cover together is its *span*.

* Spans are dealt out by ranges of (seed, span), so all spans of a seed meet, unless they are very many. Equal
  spans hold equal windows: all but those of the smallest document go as a whole. A seed of which there is one
  span only is settled. Spans are equal if their hashes are *and their text is*: of all that share a hash the texts'
  128-bit BLAKE2 digests are compared. Should two texts have one hash, their seed is taken as crowded.
* The other spans go, with their text, to their seed's bucket, where ``decide`` compares the text itself: by
  extending matches (``substring_dedup``) or by refining buckets of suffixes (``suffix_dedup``).
* Seeds of more spans than a bucket may hold, and those that the ranges cut, aren't gathered anywhere. What lies
  beside such a seed, to few depths on either side, is grouped by its hash first: where only one document goes on
  like that, none of its windows that reach so far can come up elsewhere. The other windows are grouped one by one,
  by two 64-bit hashes of different make (128 bits). Both are aggregations combined before the shuffle.

Answers go back as lists of first occurrences keyed by document. So no group of copies ever meets in one task,
and no pairs leave one. Texts are shuffled once, by document; later steps join lists to that same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays
from tidemark.llm.arrays import Rolling, covered, lists, mix, pieces, sliding
from tidemark.llm.spread import order_key, partitions, whole_runs

ALONE, SHARED, CROWDED = 0, 1, 2
#: Hashes that two texts may share before the run ends with an error: by chance there are none.
MOST_CLASHES = 10_000


class Units(NamedTuple):
    """A piece's units: their values, offsets by text, and first and last byte."""

    values: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Bucketed(NamedTuple):
    """Spans of whole buckets in the order of their seeds: text, place of the seed in units, windows, document, and the buckets' offsets."""

    bodies: list[bytes]
    seed: np.ndarray
    windows: np.ndarray
    owner: np.ndarray
    buckets: np.ndarray


class Spans:
    """Seeds of a run of units with their spans: text, first and last window, hashes of the q-gram and the span."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, length: int, gram: int, bits: int = 64):
        self.values, self.rolling, n = values, Rolling(values), len(values) - length + 1
        self.length, self.gram_length, self.other, width = length, gram, None, length - gram + 1
        if n <= 0:
            self.low = self.high = self.text = self.seed = np.zeros(0, np.int64)
            self.gram = self.span = np.zeros(0, np.int64)
            return
        grams = self.rolling.every(gram)
        begin, seed = seeds_of(grams, width)
        last = ends[1:] - length  # last start in each text
        cuts = np.sort(np.concatenate([begin, ends[:-1], last + 1]), kind="stable")
        cuts = cuts[(cuts >= 0) & (cuts < n) & (np.diff(cuts, prepend=-1) > 0)]
        text = np.searchsorted(ends, cuts, side="right") - 1
        here = np.flatnonzero(cuts <= last[text])
        self.low, self.high = cuts[here], np.append(cuts[1:], n)[here] - 1
        self.seed = seed[np.searchsorted(begin, self.low, side="right") - 1]
        self.text = np.searchsorted(ends, self.low, side="right") - 1
        self.gram = grams[self.seed].view(np.int64)
        place = ((self.seed - self.low).astype(np.uint64) << np.uint64(32)) | (self.high - self.low).astype(np.uint64)
        self.span = mix(self.rolling.at(self.low, self.high + length) ^ mix(place + np.uint64(1)))
        self.span = (self.span >> np.uint64(64 - bits)).view(np.int64)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of chosen spans: start, number of the span among the chosen, and number within it."""
        size = self.high[chosen] - self.low[chosen] + 1
        which = np.repeat(np.arange(len(chosen)), size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.low[chosen][which] + within, which, within

    def side(self, seed: np.ndarray, depth: np.ndarray, left: bool) -> np.ndarray:
        """Hashes of the seeds with what lies beside them to some depth."""
        low, high = (seed - depth, seed + self.gram_length) if left else (seed, seed + self.gram_length + depth)
        return mix(self.rolling.at(low, high) + np.uint64(1 + left)).view(np.int64)

    def lone(self, chosen: np.ndarray, starts: np.ndarray, which: np.ndarray, column: pa.Array) -> np.ndarray:
        """Which windows of chosen spans reach so far beside their seed that only this document goes on like that."""
        seed, text = self.seed[chosen][which], self.text[chosen][which]
        out, levels = np.zeros(len(starts), bool), depths(self.length, self.gram_length)
        for left, room in ((True, seed - starts), (False, starts + self.length - seed - self.gram_length)):
            level = np.searchsorted(levels, room, side="right") - 1
            far = np.flatnonzero(level >= 0)
            out[far] |= _listed(text[far], self.side(seed[far], levels[level[far]], left), column)
        return out

    def hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows at some starts."""
        if self.other is None:
            self.other = Rolling(arrays.mix(self.values.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
        return tuple(r.at(starts, starts + self.length).view(np.int64) for r in (self.rolling, self.other))

    def clashes(self) -> np.ndarray:
        """Spans that share their hash with one of another seed in their text: rare, but lists can't tell them apart."""
        order = np.lexsort((self.gram, self.span, self.text))
        text, span, gram = self.text[order], self.span[order], self.gram[order]
        near = (text[1:] == text[:-1]) & (span[1:] == span[:-1]) & (gram[1:] != gram[:-1])
        out = np.zeros(len(order), bool)
        out[order[1:][near]] = out[order[:-1][near]] = True
        return out


def seeds_of(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the leftmost least of each stretch of width grams changes, and its place from there on.

    Where the least value falls, the gram that comes in is it; where it rises, it is looked for. While it stays, each
    gram of the same value takes over from the one before.
    """
    least = sliding(grams, width)
    rows = np.lib.stride_tricks.sliding_window_view(grams, width)
    begin = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    stop = np.append(begin[1:], len(least))
    seed = begin + width - 1
    rises = np.flatnonzero(least[begin] >= least[np.maximum(begin - 1, 0)])
    seed[rises] = _leftmost(rows, begin[rises])
    twice = np.flatnonzero(seed < stop - 1)
    if not len(twice):
        return begin, seed
    n = stop[twice] + width - 2 - seed[twice]  # what comes after the seed, to the end of the last stretch
    which = np.repeat(np.arange(len(twice)), n)
    at = seed[twice][which] + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    equal = np.flatnonzero(grams[at] == least[begin[twice]][which])
    which, at = which[equal], at[equal]
    start = np.concatenate([[0], at[:-1] + 1])
    first = np.concatenate([[True], which[1:] != which[:-1]])
    start[first] = seed[twice][which[first]] + 1
    need = start < stop[twice][which]
    begin, seed = np.concatenate([begin, start[need]]), np.concatenate([seed, at[need]])
    order = np.argsort(begin, kind="stable")
    return begin[order], seed[order]


def _leftmost(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of the least values of some rows, the row of a place beginning there."""
    step = 1 << 14  # bounds what is copied
    return at + np.concatenate([np.zeros(0, np.int64), *(rows[at[i : i + step]].argmin(1) for i in range(0, len(at), step))])


def depths(length: int, gram: int) -> np.ndarray:
    """Depths, each twice the one before, to which the surroundings of a crowded seed are compared."""
    least = max(1, (length - gram) // 16)
    return least << np.arange(max(1, (length - gram) // least).bit_length())


def _once(text: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """True where a key comes up for the first time in its text."""
    order = np.lexsort((*key, text))
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in (text, *key)], axis=0)
    out = np.zeros(len(order), bool)
    out[order[new]] = True  # lexsort is stable: the first of equal keys is the earliest
    return out


def _repeats(values: np.ndarray, starts: np.ndarray, text: np.ndarray, key: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    """Which windows, sorted by text and start, come up before in their text: those of one key, if their values are the same."""
    order = np.lexsort((*key, text))  # stable, so earlier starts come first
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in (text, *key)], axis=0)
    again = np.flatnonzero(~new)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))[again]]
    out, again = np.zeros(len(starts), bool), order[again]
    for i in range(0, len(again), 1 << 14):
        one, other = (starts[x[i : i + (1 << 14)], None] + np.arange(length) for x in (again, first))
        out[again[i : i + (1 << 14)]] = (values[one] == values[other]).all(1)
    return out


def _least(own: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """For each key the place of its smallest document: what a task knows of it before the shuffle."""
    order = np.lexsort((own, *key))
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in key], axis=0)
    return order[new]


def _found(text: np.ndarray, key: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...], ends: np.ndarray) -> np.ndarray:
    """The place of a key in its text's list, or -1."""
    if not len(values[0]):
        return np.full(len(text), -1)
    known, asked, here = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), text.astype(np.int64), np.ones(len(text), bool)
    for v, k in zip(values, key, strict=True):  # by number instead of value, so that text and key make one number
        distinct = np.unique(v)
        at = np.minimum(np.searchsorted(distinct, k), len(distinct) - 1)
        here &= distinct[at] == k
        known, asked = known * len(distinct) + np.searchsorted(distinct, v), asked * len(distinct) + at
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known[order], asked), len(known) - 1)]
    return np.where(here & (known[at] == asked), at, -1)


def _listed(text: np.ndarray, key: np.ndarray, column: pa.Array) -> np.ndarray:
    values, ends = lists(column)
    return _found(text, (key,), (values,), ends) >= 0


def _clash(gram: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which spans have a seed of which a span shares its hash with another text. The column holds one list in all rows."""
    values = lists(column.slice(0, 1))[0]
    return np.isin(gram, values) if len(values) else np.zeros(len(gram), bool)


def _structs(column: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def _masks(spans: Spans, chosen: np.ndarray, column: pa.Array, width: int) -> np.ndarray:
    """Flags of the windows of chosen spans that their buckets have found to be first."""
    told, ends = _structs(column)
    at = _found(spans.text[chosen], (spans.span[chosen],), (np.asarray(told.field("span")).astype(np.int64),), ends)
    size = -(-width // 8)
    raw = np.frombuffer(b"".join(told.field("mask").to_pylist()), np.uint8).reshape(-1, size)
    return np.unpackbits(raw[at], axis=1, count=width).astype(bool) if len(chosen) else np.zeros((0, width), bool)


def bucket_kinds(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """For a range of (gram, span): k, span and kind of the first occurrence of each span, and whether there are more.

    The first and the last seed of a range may go on in another, so they count as crowded.
    """
    held = [[np.asarray(b.column(c)) for c in ("gram", "span", "k", "many")] for b in batches]  # a partition's columns
    gram, span, k, many = (np.concatenate([h[i] for h in held] or [np.zeros(0, np.int64)]) for i in range(4))
    if not len(gram):
        return
    order = np.lexsort((k, span, gram))
    gram, span, k, many = gram[order], span[order], k[order], many[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])
    rows = np.flatnonzero(new)
    many = np.add.reduceat(many, rows) > 1
    gram, span, k = gram[new], span[new], k[new]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    size = np.diff(np.append(first, len(gram)))
    kind = np.where(size == 1, ALONE, np.where(size <= limit, SHARED, CROWDED))
    kind[[0, -1]] = CROWDED
    yield pa.record_batch([pa.array(k), pa.array(span), pa.array(np.repeat(kind, size).astype(np.int32)), pa.array(many)], ["k", "span", "kind", "many"])


def repeated(docs: DataFrame, units: Callable[[np.ndarray, np.ndarray], Units], length: int, gram: int, decide: Callable[[Bucketed], np.ndarray], plain: Callable[[bytes], bytes], limit: int, finish: Callable, schema: str, bits: int = 64) -> DataFrame:
    """Rows of ``schema`` that ``finish(piece, data, ends, gone, unit_ends)`` makes of each piece of texts.

    docs: doc_id, text. decide gives, for each span of some buckets, flags of the windows that come up in no
    smaller document. plain: a span's text, the same for equal units. limit: spans that a bucket may hold. gone: for each
    unit, whether a dropped window covers it. bits: of a span's hash; with few, texts share hashes.
    """
    n, width = partitions(docs), length - gram + 1
    base = docs.select(order_key().alias("k"), "doc_id", "text").repartition(n, "k")

    def each(batch: pa.RecordBatch):
        for piece, data, ends in pieces(batch):
            u = units(data, ends)
            yield piece, data, ends, u, Spans(u.values, u.offsets, length, gram, bits), np.asarray(piece.column("k"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if parts := [(s.gram, s.span, k[s.text]) for *_, s, k in each(batch)]:
                gram_, span, k = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.argsort(mix(gram_.view(np.uint64) + mix(span.view(np.uint64))))  # pairs that share this are rows of their own
                gram_, span, k = gram_[order], span[order], k[order]
                new = np.ones(len(order), bool)
                new[1:] = (gram_[1:] != gram_[:-1]) | (span[1:] != span[:-1])
                rows = np.flatnonzero(new)
                least = np.minimum.reduceat(k, rows) if len(rows) else k
                yield pa.record_batch([pa.array(c) for c in (gram_[rows], span[rows], least, np.diff(np.append(rows, len(order))))], ["gram", "span", "k", "many"])

    def bodies_of(data: np.ndarray, u: Units, s: Spans, at: np.ndarray) -> list[bytes]:
        return [data[a:b].tobytes() for a, b in zip(u.start[s.low[at]], u.end[s.high[at] + length - 1], strict=True)]

    def kinds_of(s: Spans, piece: pa.RecordBatch) -> list[np.ndarray]:
        """Which spans are, as far as their hash tells, first and alone, first and shared, first and crowded."""
        alone, shared, crowded = (_listed(s.text, s.span, piece.column(c)) for c in ("alone", "shared", "crowded"))
        if "clashes" in piece.schema.names:
            clash = _clash(s.gram, piece.column("clashes"))
            alone, shared, crowded = alone & ~clash, shared & ~clash, crowded | clash
        return [alone, shared, crowded]

    def emit_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int, bool, bytes]] = set()
            last: dict[int, bytes] = {}  # the text of a hash as it came up last, to leave out what is the same
            for piece, data, _, u, s, _ in each(batch):
                clash = s.clashes()
                at = np.flatnonzero(~np.any(kinds_of(s, piece), axis=0) | _listed(s.text, s.span, piece.column("compare")) | clash)
                for span, gram_, differs, body in zip(s.span[at].tolist(), s.gram[at].tolist(), clash[at].tolist(), bodies_of(data, u, s, at), strict=True):
                    if differs or last.get(span) != body:
                        last[span] = body
                        seen.add((span, gram_, differs, blake2b(plain(body), digest_size=16).digest()))
            span, gram_, clash, digest = zip(*seen, strict=True) if seen else ((), (), (), ())
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(span, pa.int64()), pa.array(gram_, pa.int64()), pa.array(clash, pa.bool_()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["span", "gram", "clash", "one", "two"])

    def emit_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, _, u, s, k in each(batch):
                at = np.flatnonzero(kinds_of(s, piece)[1])
                at = at[_once(s.text[at], s.span[at])]
                bodies = bodies_of(data, u, s, at)
                whole = [s.gram[at], s.span[at], k[s.text[at]], s.seed[at] - s.low[at], s.high[at] - s.low[at] + 1]
                yield pa.record_batch([*map(pa.array, whole), pa.array(bodies, pa.binary())], ["gram", "span", "k", "seed", "windows", "body"])

    def crowded_here(s: Spans, piece: pa.RecordBatch) -> np.ndarray:
        """Crowded spans: the first of each hash in a text, and all of a seed with spans that share a hash but not their text."""
        crowded = kinds_of(s, piece)[2]
        return crowded & (_once(s.text, s.span) | _clash(s.gram, piece.column("clashes")))

    def emit_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for piece, *_, s, k in each(batch):
                at = np.flatnonzero(crowded_here(s, piece))
                seed = s.seed[at]
                for left, room in ((True, seed - s.low[at]), (False, s.high[at] + length - seed - gram)):
                    for depth in depths(length, gram):
                        far = room >= depth
                        hashes.append(s.side(seed[far], np.full(far.sum(), depth), left))
                        owners.append(k[s.text[at]][far])
            h, own = np.concatenate(hashes), np.concatenate(owners)
            low, high = _least(own, h), _least(-own, h)
            yield pa.record_batch([pa.array(x) for x in (h[low], own[low], own[high])], ["h", "low", "high"])

    def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, *_, s, k in each(batch):
                starts, which, _ = s.windows(at := np.flatnonzero(crowded_here(s, piece)))
                here = ~s.lone(at, starts, which, piece.column("lone"))
                starts, which = starts[here], which[here]
                one, two = s.hashes(starts)
                own = k[s.text[at]][which]
                keep = _least(own, one, two)
                yield pa.record_batch([pa.array(x[keep]) for x in (one, two, own)], ["one", "two", "k"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_runs(batches, "gram"):
            column = lambda c, table=table: np.asarray(table.column(c))
            flags = decide(Bucketed(table.column("body").to_pylist(), column("seed"), column("windows"), column("k"), ends))
            bits = np.packbits(flags, axis=1)
            yield pa.record_batch([pa.array(column("k")), pa.array(column("span")), pa.array([b.tobytes() for b in bits], pa.binary())], ["k", "span", "mask"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, ends, u, s, _ in each(batch):
                once = _once(s.text, s.span)
                alone, shared, _ = (kind & once for kind in kinds_of(s, piece))
                crowded = crowded_here(s, piece)
                whole, part, open_ = np.flatnonzero(~(alone | shared | crowded)), np.flatnonzero(shared), np.flatnonzero(crowded)
                starts, which, within = s.windows(part)
                first = _masks(s, part, piece.column("masks"), width)[which, within]
                more, of, _ = s.windows(open_)
                text = np.concatenate([s.text[part][which], s.text[open_][of]])
                starts = np.concatenate([starts, more])
                lone = s.lone(open_, more, of, piece.column("lone"))
                told, ends_ = _structs(piece.column("firsts"))
                known = tuple(np.asarray(told.field(c)).astype(np.int64) for c in ("one", "two"))
                listed = _found(s.text[open_][of], s.hashes(more), known, ends_) >= 0
                stay = np.flatnonzero(np.concatenate([first, lone | listed]))
                stay = stay[np.lexsort((starts[stay], text[stay]))]
                stay = stay[~_repeats(s.values, starts[stay], text[stay], s.hashes(starts[stay]), length)]  # of windows first here, those that this text has first
                goes = np.ones(len(starts), bool)
                goes[stay] = False
                gone = np.concatenate([s.windows(whole)[0], starts[goes]])
                yield finish(piece, data, ends, covered(gone, length, len(u.values)), u.offsets)

    seeds = base.mapInArrow(emit, "gram long, span long, k long, many long").repartitionByRange(n, "gram", "span")
    kinds = seeds.mapInArrow(lambda b: bucket_kinds(b, limit), "k long, span long, kind int, many boolean")
    listed = [F.collect_list(F.when(F.col("kind") == kind, F.col("span"))).alias(name) for kind, name in ((ALONE, "alone"), (SHARED, "shared"), (CROWDED, "crowded"))]
    compare = F.collect_list(F.when(F.col("many"), F.col("span"))).alias("compare")
    told = base.join(kinds.groupBy("k").agg(*listed, compare).hint("shuffle_hash"), "k", "left")
    differ = (F.min("one") != F.max("one")) | (F.min("two") != F.max("two")) | F.max("clash")
    compared = told.mapInArrow(emit_bodies, "span long, gram long, clash boolean, one long, two long").groupBy("span", "gram").agg(differ.alias("differ"))
    few = F.when(F.count(F.lit(1)) > MOST_CLASHES, F.raise_error(F.lit("too many texts share a hash"))).otherwise(F.collect_set("gram")).alias("clashes")
    clashes = compared.where("differ").limit(MOST_CLASHES + 1).agg(few).withColumn("all", F.lit(1))  # one row, a short list
    told = told.withColumn("all", F.lit(1)).join(F.broadcast(clashes), "all", "left").drop("all")  # with all columns, so that exchanges are reused
    clash = F.size("clashes") > 0
    spans = told.where(F.size("shared") > 0).mapInArrow(emit_spans, "gram long, span long, k long, seed long, windows long, body binary")
    masks = spans.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(answer, "k long, span long, mask binary")
    masks = masks.groupBy("k").agg(F.collect_list(F.struct("span", "mask")).alias("masks"))
    crowded = told.where((F.size("crowded") > 0) | clash)
    sides = crowded.mapInArrow(emit_sides, "h long, low long, high long").groupBy("h").agg(F.min("low").alias("k"), F.max("high").alias("high"))
    lone = sides.where("k = high").groupBy("k").agg(F.collect_list("h").alias("lone"))
    windows = crowded.join(lone.hint("shuffle_hash"), "k", "left").mapInArrow(emit_windows, "one long, two long, k long")
    firsts = windows.groupBy("one", "two").agg(F.min("k").alias("k")).groupBy("k").agg(F.collect_list(F.struct("one", "two")).alias("firsts"))
    for lists_ in (masks, lone, firsts):
        told = told.join(lists_.hint("shuffle_hash"), "k", "left")
    return told.mapInArrow(remove, schema)
