"""Mixing sources to target weights: Poisson replication, in DataFrame functions only.

A source with weight w of the mixture should yield w * total rows, so each of its n rows comes w * total / n
times in the mean. The number for a row is the inverse of that Poisson distribution at a uniform number that
is a hash of the seed and the row's id: it stays the same on every run, machine and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spread import partitions

SEED = 17
#: Rates for at most so many sources are broadcast (each has a short list of doubles); more are joined.
BROADCAST_SOURCES = 2_000
#: Exponent of a source's size in its default weight: 1 keeps the sizes, 0 levels them.
TEMPERATURE = 0.5


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a SHA-256 of seed and parts."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def cumulative(rate: Column) -> Column:
    """P(X <= k) of a Poisson distribution for k = 0, 1, ... far into its tail, as an array; built from logarithms."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.array().cast("array<double>").alias("cdf"), (-rate).alias("log_p"), F.lit(0.0).alias("sum"))

    def step(s, k):
        log_p = F.when(k == 0, -rate).otherwise(s["log_p"] + F.ln(rate) - F.ln(k.cast("double")))
        total = s["sum"] + F.exp(log_p)
        return F.struct(F.array_append(s["cdf"], total).alias("cdf"), log_p.alias("log_p"), total.alias("sum"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), top), start, step, lambda s: s["cdf"])).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source: str = "source") -> DataFrame:
    """For each source: rows, weight, target share, mean number of copies of a row, and its distribution; marked for broadcast if few.

    Without weights a source weighs its size to the power TEMPERATURE. A source that the weights leave out
    gets no rows. total: rows to aim at; the rows there are, if not given.
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_rows"))
    if weights is None:
        weight = F.pow(F.col("mix_rows").cast("double"), F.lit(TEMPERATURE))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights can't be negative")
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = sizes.withColumn("mix_weight", weight)
    count, rows, all_weights = weighed.agg(F.count(F.lit(1)), F.sum("mix_rows"), F.sum("mix_weight")).first()
    share = F.col("mix_weight") / all_weights if all_weights else F.lit(0.0)
    goal = float(total if total is not None else rows or 0)
    rate = F.col("mix_share") * goal / F.col("mix_rows")
    out = weighed.withColumn("mix_share", share).withColumn("mix_rate", rate).withColumn("mix_cdf", cumulative(F.col("mix_rate")))
    return F.broadcast(out) if count <= BROADCAST_SOURCES else out


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs, each row as often as its number says, with ``copy`` (from 0) added, in a globally shuffled order.

    The number depends on the id, so rows with one id come equally often if their source is one; rows without
    id share a number per source and text. A null source is a source of its own. Empty texts are rows like
    any other, an empty table gives an empty result, and a column that is named copy is replaced.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("at_source"), F.coalesce(F.col(key).cast("string"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("at_key"), F.col(key).isNull().alias("no_id"))
    table = rates(docs, weights, total, source).select("mix_source", "mix_cdf")
    u = uniform(seed, F.col("at_key"))
    copies = F.size(F.filter("mix_cdf", lambda c: c <= u))
    out = (
        rows.join(table, F.col("at_source").eqNullSafe(F.col("mix_source")), "left")
        .withColumn("n", copies)
        .where("n > 0")
        .select("row", "at_key", "no_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
        .withColumn("place", F.xxhash64(F.lit(seed), "at_key", "copy", F.when(F.col("no_id"), F.monotonically_increasing_id())))
    )
    # Any row may go to any partition, and the order in a partition is by the same hash: a shuffle of the whole.
    # Rows without an id are told apart by where they stand, so that many of one text don't go to one task.
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "copy"]
    return out.repartition(partitions(docs), "place").sortWithinPartitions("place").select(*kept, "copy")
