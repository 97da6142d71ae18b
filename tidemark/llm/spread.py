"""Spark helpers shared by the text operators: row keys, partition counts, durable cut points, runs of a key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of input that one partition of a shuffled text should hold.
TEXT_PARTITION_BYTES = 24 * 2**20


def partitions(df: DataFrame, bytes_each: int = TEXT_PARTITION_BYTES) -> int:
    """Partitions for a shuffle of df: the session's count, or more if the size of the tables that it reads asks for it.

    Tables of unknown size (such as checkpoints) don't count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 2**60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // bytes_each)


def order_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A long that orders documents as doc_id does.

    Rows without an id follow every id (ids stay below 2**62), in the order of a hash of their text. That
    spreads them over partitions as well as ids would. Rows that share a key count as none earlier than the other.
    """
    spread = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 2)
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(2**62) + spread)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share. Only a local session may do without."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df, written to the checkpoint folder and read from there: its lineage ends here."""
    spark = df.sparkSession
    path = f"{folder or _folder.get() or checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``cut`` writes within goes at the end, but for tables written by the function that this yields."""
    outer = _folder.get() or checkpoint_dir(spark)
    inner = f"{outer}/{uuid.uuid4().hex}"
    before = _folder.set(inner)
    try:
        yield lambda df: cut(df, outer)
    finally:
        _folder.reset(before)
        delete(spark, inner)


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, limit: int, how: str = "inner") -> DataFrame:
    """rows joined to table, which has one row for each key and in ``weight`` the number of rows that have it.

    Keys of more than limit rows are dealt to several tasks. These are few (all rows by limit, at most), so they
    are broadcast.
    """
    salts = F.ceil(F.col(weight) / limit).cast("int")
    hot = F.broadcast(table.where(F.col(weight) > limit).select(*on, salts.alias("salts")))
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("salts", F.lit(1))).cast("int")
    left = rows.join(hot, on, "left").withColumn("salt", salt).drop("salts")
    right = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [*on, "salt"], how).drop("salt")


def dense(keys: DataFrame, name: str) -> DataFrame:
    """keys, written, with a number for each row: 0, 1, 2 and so on."""
    raw = cut(keys.withColumn("raw", F.monotonically_increasing_id()))
    part, nth = F.shiftright("raw", 33), F.col("raw").bitwiseAND(2**33 - 1)
    before = F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    base = raw.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("many")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return raw.withColumn("part", part).join(F.broadcast(base), "part").withColumn(name, F.col("base") + nth).drop("part", "base", "raw")


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of a task that is sorted by key, as tables that hold whole runs of it, with the runs' offsets.

    A table has about so many rows, or one run, so memory is bounded where runs are.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def whole(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, size
        table = pa.Table.from_batches(held)
        value = np.asarray(table.column(key))
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        end = len(value) if last else int(first[-1])
        held, size = table.slice(end).to_batches(), len(value) - end
        if end:
            yield table.slice(0, end), np.append(first[first < end], end)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from whole(False)
    if held:
        yield from whole(True)


@contextmanager
def spent_shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query within are deleted as it ends, not only when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def with_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, can't clash with those made here."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
