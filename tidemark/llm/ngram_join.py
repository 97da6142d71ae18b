"""N-gram Jaccard self-join by universe partition and pigeonhole, exact.

Texts with equal shingle sets form a class. For classes whose larger set lies in a size band, at most H
shingles differ. Hashing cuts the universe of shingles into segments, and an allocation of more than H units
over them (one for a segment indexed as it is, two for one indexed with its one-deletion neighbourhood)
leaves one segment at least that two similar sets agree on. A segment too thin to tell anything gets no unit. A
cost model picks the allocation of each band, which may mix the three.
Classes that share a signature form a bucket, whose pairs are verified on the sets themselves.

Buckets that overlap are merged into families, so that each set is sent once instead of with every bucket. Texts
that share a passage may meet by chance, the more of them the longer they are and the larger the table is, so families
are narrowed before any set is sent: parity bits, some for each shingle, tell which sets may be similar at all.
A family that one task can hold is compared whole. In a larger one links are first looked for within blocks of
members and with a few hubs that every block gets, which joins up groups of near copies. What is left are families
whose members aren't all connected. There, members of different components that may be similar by their bits are
compared block by block: those of the largest component with each block of the rest, not with each other. A set is in
many buckets, which hardly differ in a group of near copies, so a family is taken as a whole unless it is so large
that this sends more rows than its buckets have. Tasks emit connected members, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import LOWER, Rolling, mix, pieces, signed, words
from tidemark.llm.components import components
from tidemark.llm.spread import cut, order_key, partitions, scratch, spent_shuffles_deleted, whole_runs, with_text

#: Shingle size and similarity that near-duplicate operators take unless told otherwise.
SHINGLE_WORDS, PERCENT = 5, 80
#: Ratio of the largest to the least set size of a band.
BAND_RATIO = 1.25
#: Sets that one task compares with each other, and about how many hubs each block of a larger family gets.
BLOCK, HUBS = 384, 16
#: Parts that members of a component are dealt to where its least id comes back to them.
SALTS = 16
#: Parity bits of a set at least; more, if it has more shingles.
LEAST_BITS = 256
#: Cost of a chance agreement of small segments against that of a signature.
CHANCE = 30.0
#: Steps from no segment with a one-deletion neighbourhood to all of them, of which the cost model picks one.
SHARES = 8
#: Common shingles: at most so many, of which a task has seen so many in a batch of texts, and all tasks so many.
#: Which ones are known changes what is compared, but never what is found.
COMMON, COMMON_IN_BATCH, COMMON_IN_ALL = 200_000, 3, 24


@lru_cache(maxsize=4096)
def band(number: int, percent: int) -> tuple[int, int, int, int, int]:
    """Of a size band: least and largest size, segments, those with one-deletion neighbourhoods, spare units.

    The first of the segments are the ones with neighbourhoods for all sets; where more units are lost to sparse
    segments than are spare, a set's other segments get neighbourhoods, too. Costs are the signatures expected of a
    set and the chance agreements; the cheapest allocation is taken.
    """
    low = 1
    for _ in range(number):
        low = max(low + 1, math.floor(low * BAND_RATIO) + 1)
    high = max(low, math.floor(low * BAND_RATIO))
    differ = (100 - percent) * 2 * high // (100 + percent)
    options = []
    for step in range(SHARES + 1):
        for spare in range(0, differ + 12, max(1, differ // 64)):
            units = differ + 1 + spare
            deep = units // 2 * step // SHARES
            m = units - deep
            g = low / m
            single, double = (m - deep) * _fewer(least_size(g), g), deep * _fewer(least_size(g) + 1, g)
            upgraded = math.erfc((spare + 0.5 - single - 2 * double) / math.sqrt(2 * (single + 4 * double) + 1e-9)) / 2
            signatures = m + deep * g
            options.append((signatures + upgraded * (m - deep) * g + CHANCE * math.exp(-g) * signatures, m, deep, spare))
    _, m, deep, spare = min(options)
    return low, high, m if differ else 0, deep, spare


def least_size(g: float) -> int:
    """Shingles that a segment needs to be indexed at once, if segments hold g in the mean."""
    return 3 if g >= 7 else 2 if g >= 3 else 1


def _fewer(k: int, g: float) -> float:
    return sum(math.exp(-g) * g**i / math.factorial(i) for i in range(k))


def band_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    edges, number = [1], 0
    while edges[-1] <= (sizes.max() if len(sizes) else 0):
        number += 1
        edges.append(band(number, percent)[0])
    return np.searchsorted(np.array(edges), sizes, side="right") - 1


def shingles(data: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text, as sorted hashes, and the sets' offsets. A text of fewer than n words has one shingle."""
    data = LOWER[data]
    start, end, offsets = words(data, ends)
    word = Rolling(Rolling(data).at(start, end))
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    text = np.repeat(np.arange(len(size)), count)
    at = offsets[:-1][text] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    key = word.at(at, np.minimum(at + n, offsets[1:][text]))
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(text) != 0) | (key[1:] != key[:-1])
    return key[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(size)))])


def class_ids(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(key))])
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(size)) | np.uint64(1), np.uint64(0))


def signatures(key: np.ndarray, first: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signature and number of the set for every set, in its own band and those of larger sets that may be similar.

    A segment is thin if it holds hardly any shingle that isn't common (a sorted array): sets would agree on it
    by chance. What is thin, also after a deletion, isn't indexed, and its units are lost. A set that loses more than
    the band has spare indexes the neighbourhoods of all its segments that aren't thin. If even they make up too few
    units, it indexes thin segments as well. Of two similar sets, the one that loses less decides what they agree
    on, and the other one indexes as much.
    """
    sizes = np.diff(first)
    rare = np.ones(len(key)) if common is None or not len(common) else (common[np.minimum(np.searchsorted(common, key), len(common) - 1)] != key).astype(float)
    own, most = band_of(sizes, percent), band_of(sizes * 100 // percent, percent)
    out, who = [], []
    for number in range(int(own[sizes > 0].min()) if (sizes > 0).any() else 0, int(most.max(initial=0)) + 1):
        _, _, m, deep, spare = band(number, percent)
        chosen = np.flatnonzero((own <= number) & (number <= most) & (sizes > 0))
        if not m or not len(chosen):
            continue
        n = sizes[chosen]
        at = np.repeat(first[:-1][chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        which, h = np.repeat(np.arange(len(chosen)), n), key[at]
        salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64)
        cell = which * m + ((mix(h ^ salt) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        value = mix(h + salt)
        sums = np.zeros(len(chosen) * m, np.uint64)
        np.add.at(sums, cell, value)
        part = mix((np.arange(len(sums)) % m).astype(np.uint64) + salt)
        filled, least = np.bincount(cell, weights=rare[at], minlength=len(sums)), max(1, least_size(band(number, percent)[0] / m) - 1)
        near = np.arange(len(sums)) % m < deep
        units = lambda which: which.reshape(-1, m).sum(1)
        lost = units((filled < least + near) * (1 + near)) > spare
        bare = lost & (units((filled >= least) + 0 + (filled > least)) < m + deep - spare)
        keep = (filled >= least) | np.repeat(bare, m)
        out.append(mix(sums ^ part)[keep])
        who.append(np.repeat(chosen, m)[keep])
        if deep or lost.any():
            rest = filled[cell] - rare[at] >= least
            left = ((near[cell] | lost[which]) & rest) | (near[cell] & bare[which])
            out.append(mix((sums[cell] - value) ^ part[cell])[left])
            who.append(chosen[which][left])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(who)


def connected(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix of links, a member's row and the row of the first member that it is connected with."""
    n = len(linked)
    root, left = np.arange(n), linked.any(1)
    while left.any():
        first = int(np.argmax(left))
        front = np.zeros(n, bool)
        front[first], left[first] = True, False
        while front.any():
            front = linked[front].any(0) & left
            left &= ~front
            root[front] = first
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections."""
    n = len(sets)
    keys, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    used = np.bincount(column, minlength=len(keys)) > 1  # a shingle of one set adds to no intersection
    number = np.cumsum(used) - 1
    row, column = row[used[column]], number[column[used[column]]]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(used.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((n, min(4096, int(used.sum()) - low)), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        shared += m @ m.T
    return shared.astype(np.int64)


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    size, shared = np.array([len(s) for s in sets]), overlaps(sets)
    linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    np.fill_diagonal(linked, False)
    return linked


def parities(key: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set bits that tell whether it has an odd number of the shingles that hash there: one bit to two for each shingle.

    The bits of two sets differ in no more places than the sets do.
    """
    n = np.diff(first)
    width = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(width)])
    cell = np.repeat(ends[:-1], n) + (mix(key) & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(cell, minlength=ends[-1]) & 1).astype(bool), bitorder="little")
    return [odd[a:b].tobytes() for a, b in zip(ends[:-1] // 8, ends[1:] // 8, strict=True)]


def possible(bits: list[bytes], size: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be similar: those whose bits, and so whose sets, needn't differ by more than similar ones do.

    Sets that have more than twice the bits of another have too many shingles to be similar; twice as many are
    folded.
    """
    out = np.zeros((len(size), len(size)), bool)
    width = np.array([len(x) for x in bits], np.int64)
    for w in np.unique(width):
        at = np.flatnonzero((width == w) | (width == 2 * w))
        folded = np.zeros((len(at), w // 8), np.uint64)
        for row, i in enumerate(at):
            folded[row] = np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, w // 8))
        own = width[at] == w
        rows = max(1, 2**20 // folded.size)
        for low in range(0, len(at), rows):
            some = slice(low, low + rows)
            apart = np.bitwise_count(folded[some, None] ^ folded[None]).sum(2, dtype=np.int64)
            both = size[at[some], None] + size[None, at]
            may = ((100 - percent) * both >= (100 + percent) * apart) & (own[some, None] | own[None])
            out[np.ix_(at[some], at)] |= may
    np.fill_diagonal(out, False)
    return out


def compare(links_of, names: tuple[str, ...] = ("c",)):
    """A function over a task sorted by g that emits, for each group, pairs a, b of connected members: a, and the first of those that it is connected with.

    links_of gives the matrix of links of a part of the table. Members with a label are linked only if theirs
    differ, and if they are on different sides where the group has two. names: the columns to emit of a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_runs(batches, "g"):
            side, label = np.asarray(table.column("side")), np.asarray(table.column("l"))
            rows, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if b - a < 2:
                    continue
                linked = links_of(table.slice(a, b - a))
                linked &= label[a:b, None] != label[None, a:b]
                if side[a:b].any():
                    linked &= side[a:b, None] != side[None, a:b]
                row, root = connected(linked)
                first = np.unique(root)
                rows += [a + row, a + first]
                roots += [a + root, a + first]
            row, root = np.concatenate(rows), np.concatenate(roots)
            value = [np.asarray(table.column(c)) for c in names]
            columns = [v[at] for v in value for at in (row, root)]
            yield pa.record_batch([pa.array(x) for x in columns], [f"{end}{'' if c == 'c' else c}" for c in names for end in "ab"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Components of documents linked by 100 * |A and B| >= percent * |A or B|: doc_id, k, n_shingles, component.

    Sets are of distinct shingles of ASCII-lower-cased words; fewer words than a shingle make one, and a text
    without words (or a null one) has an empty set, which links with nothing. ``component`` is the least k
    reachable; k is doc_id, or for rows without one a value above all ids from their text's hash. Rows that
    share an id are members like any others. Other columns are left out; tables may be empty, texts of any
    length. Sets, classes and signatures are compared by 64-bit hashes, pairs by the shingles' hashes.
    """
    return _grouped(docs, shingle, percent).select("doc_id", "k", "n_shingles", "component")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """What near_duplicates returns, with t, a hash of the text, and group, which names the component by its classes (null for texts without words)."""
    if not 50 <= percent <= 100 or shingle < 1:
        raise ValueError("similarity is from 50 to 100 percent, and a shingle has a word at least")
    base = with_text(docs).select(order_key().alias("k"), "doc_id", "text", _text_key().alias("t"))

    def emit_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text; and for each shingle common in a batch a row without k, with its number of sets below zero."""
        names = ["k", "doc_id", "t", "n_shingles", "c", "bits"]
        for batch in batches:
            keys = [np.zeros(0, np.uint64)]
            for piece, data, ends in pieces(batch):
                key, first = shingles(data, ends, shingle)
                c = class_ids(key, first)
                yield pa.record_batch([piece.column("k"), piece.column("doc_id"), piece.column("t"), pa.array(np.diff(first)), signed(c), pa.array(parities(key, first), pa.binary())], names)
                keys.append(np.concatenate([key[first[i] : first[i + 1]] for i in np.unique(c, return_index=True)[1]] or keys[:1]))
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            key, n = key[n >= COMMON_IN_BATCH], n[n >= COMMON_IN_BATCH]
            yield pa.record_batch([*[pa.nulls(len(key), pa.int64())] * 3, pa.array(-n), signed(key), pa.nulls(len(key), pa.binary())], names)

    def emit_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, ends in pieces(batch):
                key, first = shingles(data, ends, shingle)
                c = class_ids(key, first)
                new = np.unique(c, return_index=True)[1]  # copies in a piece have the same signatures
                n = np.diff(first)[new]
                at = np.repeat(first[:-1][new] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                sig, who = signatures(key[at], np.concatenate([[0], np.cumsum(n)]), percent, common.value)
                yield pa.record_batch([signed(sig), signed(c[new][who])], ["sig", "c"])

    def emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, ends in pieces(batch):
                key, first = shingles(data, ends, shingle)
                meant = np.flatnonzero(class_ids(key, first).view(np.int64) == np.asarray(piece.column("c")))  # rows may share an id
                sets = [key[first[i] : first[i + 1]].tobytes() for i in meant]
                yield pa.record_batch([piece.column("c").take(pa.array(meant)), pa.array(sets, pa.binary())], ["c", "shingles"])

    spark = docs.sparkSession
    seen = cut(base.mapInArrow(emit_classes, "k long, doc_id long, t long, n_shingles long, c long, bits binary"))
    of_class = seen.where("n_shingles >= 0")
    with spent_shuffles_deleted(spark), scratch(spark) as keep:
        often = seen.where("n_shingles < 0").groupBy("c").agg(F.sum("n_shingles").alias("n")).where(F.col("n") <= -COMMON_IN_ALL)
        top = often.orderBy("n", "c").limit(COMMON).select("c").toArrow().column("c")  # bounded
        common = spark.sparkContext.broadcast(np.sort(np.asarray(top).astype(np.int64).view(np.uint64)))
        n = partitions(docs)
        members = cut(buckets(base.select("text").mapInArrow(emit_signatures, "sig long, c long"), n))
        family = components(members.select(F.col("c").alias("a"), F.col("low").alias("b"))).withColumnsRenamed({"node": "c", "component": "f"})
        of_one = of_class.groupBy("c").agg(F.min("k").alias("k"), F.first("bits").alias("bits"), F.first("n_shingles").alias("size"))
        known = cut(family.join(of_one, "c"))
        family = cut(_narrowed(known, members, percent, n))
        wanted = known.join(family, "c", "left_semi").select("c", "k")
        sets = base.select("k", "text").join(wanted, "k").select("c", "text").mapInArrow(emit_sets, "c long, shingles binary")
        sets = cut(sets.groupBy("c").agg(F.first("shingles").alias("shingles")))
        found = _linked(known, members, family, sets, percent, n)
        least = of_class.groupBy("c").agg(F.min("k").alias("least")).where("c <> 0")
        label = cut(least.join(found, "c", "left"))
        linked = label.where("l is not null").withColumn("part", F.pmod(F.xxhash64("c"), F.lit(SALTS)))
        lowest = linked.groupBy("l").agg(F.min("least").alias("component")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        of_linked = linked.join(lowest, ["l", "part"]).select("c", F.col("l").alias("group"), "component")  # a large component is dealt to several tasks
        named = keep(label.where("l is null").select("c", F.col("c").alias("group"), F.col("least").alias("component")).unionByName(of_linked))
    return of_class.join(named, "c", "left").select("doc_id", "k", "t", "n_shingles", "group", F.coalesce("component", "k").alias("component"))


def _may_link(tasks: DataFrame, known: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs a, b that connect the classes of tasks (g, c, side, l) that may be similar by their bits (known: c, bits, size)."""

    def links(table: pa.Table) -> np.ndarray:
        return possible(table.column("bits").to_pylist(), np.asarray(table.column("size")), percent)

    return tasks.join(known.select("c", "bits", "size"), "c").repartition(n, "g").sortWithinPartitions("g").mapInArrow(compare(links), "a long, b long")


def _narrowed(known: DataFrame, members: DataFrame, percent: int, n: int) -> DataFrame:
    """Families f of classes c that may be similar by their bits, cut out of those of known (f, c, bits, size). Others are left out."""
    sizes = cut(known.groupBy("f").agg(F.count(F.lit(1)).alias("n_all")))  # read again, the join can split a large family's rows
    sized = known.select("f", "c").join(sizes, "f")
    small = sized.where(F.col("n_all") <= BLOCK).select(F.col("f").alias("g"), "c", F.lit(0).alias("side"), F.col("c").alias("l"))
    out = _may_link(small, known, percent, n).select(F.col("a").alias("c"), F.col("b").alias("f"))
    large = cut(sized.where(F.col("n_all") > BLOCK).select("f", "c"))
    if large.isEmpty():
        return out
    apart = _crosswise(cut(_across(members, large)))
    return out.unionByName(components(_may_link(apart, known, percent, n)).select(F.col("node").alias("c"), F.col("component").alias("f")))


def _linked(known: DataFrame, members: DataFrame, family: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """c and l, the name of its component, for classes that are linked with another."""

    def links(tasks: DataFrame, names: tuple[str, ...]) -> DataFrame:
        both = tasks.join(sets, "c").repartition(n, "g").sortWithinPartitions("g")
        of = lambda table: similar([np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")], percent)
        kinds = {"whole": "boolean"}
        return both.mapInArrow(compare(of, names), ", ".join(f"{end}{'' if c == 'c' else c} {kinds.get(c, 'long')}" for c in names for end in "ab"))

    sizes = cut(family.groupBy("f").agg(F.count(F.lit(1)).alias("size")))  # read again, the join can split a large family's rows
    sized = cut(family.join(sizes, "f"))
    large = sized.where(F.col("size") > BLOCK)
    tasks = sized.where(F.col("size") <= BLOCK).select(F.col("f").alias("g"), "c", F.lit(True).alias("whole")).unionByName(_blocks(large).withColumn("whole", F.lit(False)))
    within = cut(links(tasks.select("g", "c", F.lit(0).alias("side"), F.col("c").alias("l"), "whole"), ("c", "whole")))
    settled = within.where("awhole").select(F.col("a").alias("c"), F.col("b").alias("l"))  # a task has compared all of the family
    if large.isEmpty():
        return settled
    of_blocks = components(within.where("NOT awhole")).select(F.col("node").alias("c"), F.col("component").alias("l"))
    of_large = cut(large.join(of_blocks, "c", "left").select("f", "c", F.coalesce("l", "c").alias("l")))
    may = _may_link(_crosswise(cut(_whole_or_buckets(members, of_large))), known, percent, n)
    again = components(may).select(F.col("component").alias("f"), F.col("node").alias("c")).join(of_large.select("c", "l"), "c")
    more = links(_crosswise(cut(_whole_or_buckets(members, again))), ("l",)).select(F.col("al").alias("a"), F.col("bl").alias("b"))
    joined = components(more).select(F.col("node").alias("l"), F.col("component").alias("m"))
    left = settled.unionByName(of_large.select("c", "l"))
    return left.join(joined, "l", "left").select("c", F.coalesce("m", "l").alias("l"))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def buckets(sigs: DataFrame, n: int) -> DataFrame:
    """g, c and low for the classes c of each bucket g of two classes or more; low links all members of a bucket.

    Signatures are dealt out by ranges of (sig, c), so a signature of very many classes is spread over tasks. What
    a task sees of its first and its last signature may go on elsewhere: those buckets take the signature as their
    name and as a node of its own. Others are named by their members, so that many signatures of the same classes
    are one bucket.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column("sig")), np.asarray(b.column("c"))) for b in batches]  # a partition's two columns
        sig, c = (np.concatenate([h[i] for h in held] or [np.zeros(0, np.int64)]) for i in (0, 1))
        order = np.lexsort((c, sig))
        sig, c = sig[order], c[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])
        sig, c = sig[new], c[new]
        if not len(sig):
            return
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        open_ = (sig[first] == sig[0]) | (sig[first] == sig[-1])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(c.view(np.uint64) + np.uint64(1)))])
        whole = mix((sums[first + size] - sums[first]) ^ mix(c[first].view(np.uint64)) ^ size.astype(np.uint64)).view(np.int64)
        own = mix(sig[first].view(np.uint64) ^ np.uint64(0xB0C4E7)).view(np.int64)
        g, low = np.where(open_, own, whole), np.where(open_, own, c[first])
        take = np.flatnonzero(open_ | (size > 1))
        take = take[np.sort(np.unique(g[take], return_index=True)[1])]  # of buckets with the same members, one
        n = size[take]
        at = np.repeat(first[take] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield pa.record_batch([pa.array(x) for x in (np.repeat(g[take], n), c[at], np.repeat(low[take], n))], ["g", "c", "low"])

    dealt = sigs.repartitionByRange(n, "sig", "c")
    return dealt.mapInArrow(name, "g long, c long, low long")


def _blocks(families: DataFrame) -> DataFrame:
    """Tasks g, c within blocks of families that are too large for one (f, c, size): every member once, hubs with every block."""
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("c"), count).cast("int")
    hub = F.pmod(F.xxhash64("c", F.lit(1)), F.ceil(F.col("size") / HUBS)) == 0
    of = F.when(hub, F.sequence(F.lit(0), count - 1)).otherwise(F.array(own))
    return families.select("f", "c", F.explode(of).alias("block")).select(F.xxhash64("f", "block").alias("g"), "c")


def _across(members: DataFrame, families: DataFrame) -> DataFrame:
    """As _whole_or_buckets, for families of which no link is known yet: each member has a label of its own."""
    return _whole_or_buckets(members, families.withColumn("l", F.col("c")))


def _whole_or_buckets(members: DataFrame, labelled: DataFrame) -> DataFrame:
    """Groups g, c, l that hold all pairs of buckets across labels l of families f (labelled: f, c, l): whole families, or their buckets.

    Families of one label have none. The others' rows, if whole, grow with the square of the family over ``BLOCK``,
    and those of its buckets with the buckets that a member is in; the fewer decide.
    """
    sizes = _by_label(labelled.withColumnRenamed("f", "g")).withColumnRenamed("g", "f")
    held = members.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(labelled, "c").groupBy("f").agg(F.sum("n").alias("held"))
    rest = F.col("n_all") - F.col("n_main")
    blocks = lambda n: F.ceil(n / BLOCK)
    sent = F.col("n_main") * blocks(rest) + rest * (blocks(rest) + blocks(F.col("n_main")))
    placed = cut(labelled.join(sizes.join(held, "f").select("f", (sent <= F.col("held")).alias("whole")), "f"))
    whole = placed.where("whole").select(F.col("f").alias("g"), "c", "l")
    return whole.unionByName(members.select("g", "c").distinct().join(placed.where("NOT whole").select("c", "l"), "c").select("g", "c", "l"))


def _by_label(groups: DataFrame) -> DataFrame:
    """Of each group g of several labels: main, its largest, and the numbers of that one's members and of all, n_main and n_all."""
    counted = groups.groupBy("g", "l").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("g").agg(F.max_by("l", F.struct("n", "l")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")).where("n_main < n_all")


def _crosswise(groups: DataFrame) -> DataFrame:
    """Tasks g, c, side, l that compare members c of a group g across labels l; groups of one label need none.

    Members of a group's largest label are only compared with the rest, which is cut into blocks: each of the
    largest goes with every block of the rest, and each of the rest with every block of both.
    """
    mixed = groups.join(_by_label(groups), "g")
    main, one = F.col("l") == F.col("main"), F.col("n_all") <= BLOCK
    at_most = lambda n: F.when(one, 1).otherwise(F.ceil(n / BLOCK)).cast("int")
    placed = mixed.withColumns({"mains": at_most(F.col("n_main")), "rests": at_most(F.col("n_all") - F.col("n_main")), "is_main": main & ~one})
    h = F.xxhash64("c", F.lit(2))
    placed = placed.withColumn("own", F.pmod(h, F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    pair = lambda kind, x, y, side: F.struct(F.xxhash64("g", F.lit(kind), x, y).alias("t"), side.cast("int").alias("side"))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: pair("r", F.least("own", j), F.greatest("own", j), F.col("own") > j))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: pair("m", F.col("own"), j, F.lit(0)))
    of_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: pair("m", j, F.col("own"), F.lit(1)))
    tasks = F.when(one, F.array(pair("o", F.lit(0), F.lit(0), F.lit(0)))).when(F.col("is_main"), of_main).otherwise(F.concat(with_rest, with_main))
    return placed.select("c", "l", F.explode(tasks).alias("task")).select(F.col("task.t").alias("g"), "c", "task.side", "l")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of near copies: the one with the least id. Texts without words stay.

    If texts of a group share the least id, the one with the least hash stays. Rows of one id and text, or of no
    id and one text, with or without words, are one document, of which the row with the least hash stays.
    """
    alone = F.when(F.col("group").isNull(), F.col("t")).alias("alone")
    least = _grouped(docs, shingle, percent).where("k = component").groupBy("k", "group", alone).agg(F.min("t").alias("t"))
    kept = least.select(F.col("k").alias("kept_key"), F.col("t").alias("kept_text"))
    hashed = [F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    whole = docs.select(F.struct("*").alias("row"), order_key().alias("key"), _text_key().alias("t"), F.xxhash64(*hashed).alias("h"))
    once = whole.groupBy("key", "t").agg(F.min_by("row", "h").alias("row"))  # before the join, which needs the same shuffle
    return once.join(kept, (once.key == kept.kept_key) & (once.t == kept.kept_text), "left_semi").select("row.*")
