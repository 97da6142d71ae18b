"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spread import cut, delete, scratch

ROUNDS = 60
#: Links that a task holds at least before it merges them into what it has found.
HELD = 2**19


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links that aren't the least of their component, and that least node."""
    node, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    root = np.arange(len(node))
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high > low
        if not apart.any():
            break
        a, b, high, low = a[apart], b[apart], high[apart], low[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(node)))
    return node[rest], node[root[rest]]


def merged(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[pa.RecordBatch]:
    """a, b and home: the forest of a task's links, or of parts of them; home are nodes that are the larger end of one."""
    none = np.zeros(0, np.int64)
    x, y, home, held, size = none, none, none, [], 0

    def merge() -> None:
        nonlocal x, y, home, held, size
        a, b = (np.concatenate([none, *(np.asarray(t.column(name)) for t in held)]) for name in ("a", "b"))
        home = np.union1d(home, a)
        x, y = forest(np.concatenate([x, a]), np.concatenate([y, b]))
        held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x), pa.array(y), pa.array(np.isin(x, home))], ["a", "b", "home"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= max(HELD, len(x)):
            merge()
            if not whole:
                yield out()
                x, y, home = none, none, none
    merge()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for the ends a and b of links, as a written table.

    Each round deals the links out by their larger end, and a task merges what it gets into a forest, whose nodes all
    point at the least of their tree. So a node has a link from each task at most, and one from the task that it is
    dealt to. Then links whose smaller end has such a link go on to where that one points, until none does and each
    node has one link. Rounds grow with the logarithm of the nodes. Of what is dealt out, a node has no more rows than
    there are tasks; of the join, a hub has its links, but skewed joins can split those. A round's tables are deleted
    when the next has been written.
    """
    spark = links.sparkSession
    kind = "a long, b long, home boolean"
    with scratch(spark) as keep:
        ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = cut(ends.mapInArrow(lambda batches: merged(batches, whole=False), kind).select("a", "b").repartition("a").mapInArrow(merged, kind))
        for _ in range(ROUNDS):
            with scratch(spark) as keep_edges:
                on = edges.where("home").select(F.col("a").alias("b"), F.col("b").alias("next"))
                moved = cut(edges.join(on, "b", "left").select("a", F.coalesce("next", "b").alias("b"), (F.col("next").isNotNull() | ~F.col("home")).alias("open")))
                if not moved.agg(F.coalesce(F.bool_or("open"), F.lit(False))).first()[0]:
                    break
                after = keep_edges(moved.select("a", "b").repartition("a").mapInArrow(merged, kind))
            for path in {f.rpartition("/")[0] for f in edges.inputFiles()}:
                delete(spark, path)
            edges = after
        else:
            raise RuntimeError("components have not settled")
        root = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(root))
