"""Conversation prefix trie: equal beginnings of conversations, named by prefix doubling.

A turn is named by number: equal turns share one. Blocks of 2, 4, 8, ... turns that begin at a multiple of their
length are named by the pair of their halves' names, in as many rounds as a conversation's length has binary digits.
The first d turns are the blocks that d's binary digits stand for, longest first, so a prefix is named by the pair of
a shorter prefix (d without its last set bit) and one block: again as many rounds as there are digits. Prefixes of
one length and name are a node of the trie. Names are dense numbers of distinct pairs: no hash decides, but for a
turn's role and text, which stand as their SHA-256 from the first shuffle on.

A node is named by its smallest member. Along a conversation, the nodes that are named by it are the last ones, so
a sum over a node's subtree is a sum over its members of what they themselves name from there on: one row for each
conversation and depth, however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.spread import cut, dense, partitions, scratch, spread_join

#: Turns of one conversation that running sums go over at once; the sums of such stretches are added up after.
STRETCH = 4_096
#: Ids that are written out to be hashed at once.
IDS = 512


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), digest (of role and text) and bytes (of the text) of each turn, by turn number, null first.

    Turns of one number go by their digest. Rows are numbered where they lie after one sort of the whole table, so
    a very long conversation is spread over tasks like others.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(text).cast("long")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), size.alias("bytes"))
    turns = cut(turns.where("conv_id is not null"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    part = lambda: TaskContext.get().partitionId()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the conversation that a batch before ended in, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = np.asarray(batch.column("conv_id"))
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            first = np.flatnonzero(new)
            at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv)))) + 1
            if conv[0] == last:
                at[: first[1] if len(first) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(at[-1])
            yield pa.record_batch([batch.column("conv_id"), pa.array(at), batch.column("digest"), batch.column("bytes"), pa.array(np.full(len(at), part(), np.int32))], ["conv_id", "at", "digest", "bytes", "part"])

    n = partitions(conversations)
    placed = cut(turns.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, "conv_id long, at long, digest binary, bytes long, part int"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "part", before.alias("before"))
    on = F.broadcast(parts.where("before is not null"))  # conversations that an edge between two partitions cuts: no more than there are
    return placed.join(on, ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "digest", "bytes")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("at").alias("length"))


def limit_of(df: DataFrame, rows: int) -> int:
    """Rows of one key that a task may have: a quarter of a task's share."""
    return max(1_000, rows // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def branch(turns: DataFrame, sizes: DataFrame, origin: Column, shared: Column, most: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first turns replaced by those of another: its turns, and length of each.

    origin, shared: expressions over conv_id, of the other conversation (which may be absent) and of the number of turns
    (most, at most) that come from it. A conversation's own turns after its first ``shared`` ones follow.
    """
    of = sizes.select("conv_id", "length", origin.alias("origin"), shared.cast("long").alias("shared"))
    other = sizes.select(F.col("conv_id").alias("origin"), F.col("length").alias("there"))
    taken = F.least("shared", F.coalesce("there", F.lit(0)))
    of = cut(of.join(other, "origin", "left").select("conv_id", "origin", "shared", F.col("length").alias("own"), taken.alias("taken"), (taken + F.greatest(F.col("length") - F.col("shared"), F.lit(0))).alias("length")))
    head = turns.where(F.col("at") <= most).withColumnRenamed("conv_id", "origin").join(of.where("taken > 0").select("conv_id", "origin", "taken", "length"), "origin").where("at <= taken")
    tail = spread_join(turns.where(F.col("at") > shared), of.select("conv_id", "shared", "taken", "length", "own"), ["conv_id"], "own", limit)
    columns = ["conv_id", "digest", "bytes", "length"]
    whole = head.select("at", *columns).unionByName(tail.select((F.col("at") - F.col("shared") + F.col("taken")).alias("at"), *columns))
    return whole, of.select("conv_id", "length")


def named(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """rows with a column ``name`` instead of ``by``: a dense number of what ``by`` holds."""
    keys = dense(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("weight")), "name")
    return cut(spread_join(rows, keys, by, "weight", limit).drop("weight", *(c for c in by if c != "depth")))


def prefixes(turns: DataFrame, longest: int, limit: int) -> DataFrame:
    """conv_id, depth, name of the first ``depth`` turns: equal for equal ones of one depth."""
    level = named(turns.select("conv_id", (F.col("at") - 1).alias("j"), "digest"), ["digest"], limit)
    blocks = []
    for power in range(longest.bit_length()):
        if power:
            half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name")))
            pairs = level.groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(half(0).alias("left"), half(1).alias("right"))
            level = named(cut(pairs.where("right is not null")), ["left", "right"], limit)
        blocks.append(level.where("j % 2 = 0").select("conv_id", F.shiftleft(F.col("j") + 1, power).alias("depth"), F.col("name").alias("block")))
    block = reduce(DataFrame.unionByName, blocks)
    bits = F.bit_count("depth")
    known = [block.where(bits == 1).withColumnRenamed("block", "name")]
    for many in range(2, (longest + 1).bit_length()):  # no number up to the longest has more bits set
        shorter = known[-1].select("conv_id", F.col("depth").alias("from"), F.col("name").alias("shorter"))
        last = block.where(bits == many).withColumn("from", F.col("depth").bitwiseAND(F.col("depth") - 1))
        known.append(named(cut(last.join(shorter, ["conv_id", "from"]).drop("from")), ["depth", "shorter", "block"], limit))
    return reduce(DataFrame.unionByName, [k.select("conv_id", "depth", "name") for k in known])


def ends(rows: DataFrame) -> DataFrame:
    """depth, node, ends_sha256: a hash of the ids of the conversations that end there, in order.

    A hash goes over its input in one piece, so a node's ids end up in one task. They come there sorted and written
    out in stretches, and it holds one batch of these at a time.
    """
    n = partitions(rows)

    def runs(columns: list[np.ndarray], most: int) -> np.ndarray:
        new = np.ones(len(columns[0]), bool)
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        first = np.flatnonzero(new)
        within = np.arange(len(new)) - np.repeat(first, np.diff(np.append(first, len(new))))
        return np.flatnonzero(new | (within % most == 0))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, node, conv = (np.asarray(batch.column(c)) for c in ("depth", "node", "conv_id"))
            first = runs([depth, node], IDS) if len(depth) else np.zeros(0, np.int64)
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(first, np.append(first[1:], len(conv)), strict=True)]
            yield pa.record_batch([pa.array(depth[first]), pa.array(node[first]), pa.array(conv[first]), pa.array(text, pa.string())], ["depth", "node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (depth, node), hashlib.sha256(ids.encode())
            yield table(out)
        if last is not None:
            yield table([(*last, state.hexdigest())])

    def table(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "node", "ends_sha256"])

    order = ["depth", "node", "conv_id"]
    written = rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, "depth long, node long, first long, ids string")
    whole = written.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "first")
    return whole.mapInArrow(digest, "depth long, node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, origin: Column | None = None, shared: Column | None = None, most: int = 0) -> DataFrame:
    """A row for each distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text; other columns don't matter. Turns go by number, null first, those of one
    number by a hash of role and text; null roles and texts are empty. With origin and shared, conversations are
    rebuilt first (see ``branch``); one of which nothing is left is a member of the root alone. Rows without conv_id
    take no part; repeated rows are turns of their own. Very long texts and conversations are taken whole. An empty
    table gives no node. saved_tokens sums up (n_convs - 1) times the bytes of the last text over a node's subtree.
    """
    spark = conversations.sparkSession
    with scratch(spark) as keep:
        turns = cut(turns_in_order(conversations))
        limit = limit_of(turns, turns.count())
        sizes = cut(lengths(turns))
        if shared is None:
            turns = spread_join(turns, sizes.withColumn("own", F.col("length")), ["conv_id"], "own", limit).drop("own")
        else:
            turns, sizes = branch(turns, sizes, origin, shared, most, limit)
        turns = cut(turns)
        longest = sizes.agg(F.max("length")).first()[0]
        names = prefixes(turns, longest or 0, limit) if longest else turns.select("conv_id", F.col("at").alias("depth"), F.col("at").alias("name")).limit(0)
        facts = turns.select("conv_id", F.col("at").alias("depth"), "bytes", "length")
        root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("bytes"), "length")
        return keep(_nodes(cut(names.join(facts, ["conv_id", "depth"]).unionByName(root)), limit))


def _nodes(rows: DataFrame, limit: int) -> DataFrame:
    """Nodes of rows: conv_id, depth, name, bytes, length (of the conversation)."""
    found = rows.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("members"), F.max("length").alias("deepest"))
    rows = spread_join(rows, found, ["depth", "name"], "members", limit)
    own = F.col("conv_id") == F.col("node")
    worth = F.when(own, (F.col("members") - 1) * F.col("bytes")).otherwise(0)
    leaf = F.when(own & (F.col("deepest") == F.col("depth")), 1).otherwise(0)
    stretch = F.floor(F.col("depth") / STRETCH)
    rows = cut(rows.select("conv_id", "depth", "node", "length", worth.cast("long").alias("worth"), leaf.cast("long").alias("leaf"), stretch.alias("stretch")))
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "stretch").agg(F.sum("worth").alias("w"), F.sum("leaf").alias("l"))
    sums = sums.select("conv_id", "stretch", F.sum("w").over(later).alias("later_worth"), F.sum("l").over(later).alias("later_leaf")).where("later_leaf is not null")
    from_here = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    told = rows.join(sums, ["conv_id", "stretch"], "left")
    total = lambda c: F.sum(c).over(from_here) + F.coalesce(f"later_{c}", F.lit(0))
    told = told.select("depth", "node", total("worth").alias("worth"), total("leaf").alias("leaf"))
    nodes = told.groupBy("depth", "node").agg(F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("worth").alias("saved_tokens"))
    above = rows.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = cut(nodes.join(above, ["depth", "node"], "left"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    ended = ends(rows.where("depth = length"))
    whole = nodes.join(children, ["depth", "node"], "left").join(ended, ["depth", "node"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
