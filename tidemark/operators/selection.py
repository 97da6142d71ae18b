"""Exact percentiles of few, very large groups by distributed selection.

A grouped percentile holds the distinct values of a group in one task. Here rows are counted by ranges of their value
instead, for all groups and ranks at once; the range that holds a rank, shrunk to the least and greatest value in it,
is cut up again, until it is one value or what is left in all of them is little. Only counts leave the tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import TidemarkError

#: Ranges that an interval is cut into, and values that may be fetched at the end.
RANGES, FEW = 4_096, 20_000


def percentiles(rows: DataFrame, by: tuple[str, ...], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A row for each group that has a value: ``by``, and a double for each name in wanted, (flavour, share from 0 to 1).

    Flavours: ``nearest`` is the least value that has at least that share at or below it, ``linear`` interpolates
    between the two order statistics around (n - 1) * share. Nulls and NaN don't count. Groups are few: the driver
    keeps a range for each of their ranks, and ``RANGES`` counts for each range. Runs some three to five jobs over
    the values, which are kept by then.
    """
    for name, (flavour, share) in wanted.items():
        if flavour not in ("nearest", "linear") or not 0 <= share <= 1:
            raise TidemarkError(f"{name}: a percentile is nearest or linear, of a share from 0 to 1")
    keys = [f"g{i}" for i in range(len(by))]
    held = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").persist()
    try:
        groups = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0").collect()
        found = _select(held, keys, groups, {(i, k) for i, g in enumerate(groups) for w in wanted.values() for k in _ranks(g["n"], *w)})
    finally:
        held.unpersist()
    out = [(*(g[k] for k in keys), *(_value(found, i, g["n"], *w) for w in wanted.values())) for i, g in enumerate(groups)]
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in by), *(T.StructField(n, T.DoubleType()) for n in wanted)])
    return rows.sparkSession.createDataFrame(out, schema)


def partitions(df: DataFrame, bytes_each: int) -> int:
    """Partitions for a shuffle of df: the session's count, or more if the size of the tables that it reads asks for it.

    Tables of unknown size (such as a stream's batches) don't count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(s for s in sizes if s < 2**60) // bytes_each)


def with_percentiles(grouped: DataFrame, rows: DataFrame, by: tuple[str, ...], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """grouped, which has a row for each group of rows, with percentiles of a value added."""
    found = percentiles(rows, by, value, wanted)
    renamed = found.select(*(F.col(c).alias(f"same_{c}") for c in by), *wanted, F.lit(1).alias("same_"))
    same = F.lit(1) == F.col("same_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"same_{c}"))
    return grouped.join(renamed, same, "left").drop("same_", *(f"same_{c}" for c in by))


def _ranks(n: int, flavour: str, share: float) -> set[int]:
    """Which values, in order and from 0, a percentile needs."""
    if flavour == "nearest":
        return {max(0, math.ceil(n * share) - 1)}
    at = (n - 1) * share
    return {math.floor(at), math.ceil(at)}


def _value(found: dict[tuple[int, int], float], group: int, n: int, flavour: str, share: float) -> float:
    low, high = min(_ranks(n, flavour, share)), max(_ranks(n, flavour, share))
    a, b = found[group, low], found[group, high]
    at = (n - 1) * share
    return a if a == b or low == at else (high - at) * a + (at - low) * b


def _select(held: DataFrame, keys: list[str], groups: list, ranks: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The values of some ranks of groups."""
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, float, float], tuple[int, int]] = {(i, g["low"], g["high"]): (0, g["n"]) for i, g in enumerate(groups)}  # rows before, rows in
    waiting = ranks
    fields = [T.StructField("id", T.IntegerType()), *(T.StructField(f"of_{k}", held.schema[k].dataType) for k in keys), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    while True:
        for (group, low, high), (before, n) in open_.items():
            if low == high:
                found |= {(group, k): low for g, k in waiting if g == group and before <= k < before + n}
        waiting = {r for r in waiting if r not in found}
        open_ = {of: (before, n) for of, (before, n) in open_.items() if any(g == of[0] and before <= k < before + n for g, k in waiting)}
        if not open_:
            return found
        ids = list(open_)
        table = held.sparkSession.createDataFrame([(i, *(groups[g][k] for k in keys), low, high) for i, (g, low, high) in enumerate(ids)], T.StructType(fields))
        inside = F.col("v").between(F.col("low"), F.col("high"))
        for k in keys:
            inside &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
        part = held.join(F.broadcast(table), inside)  # a row for each range that is looked at
        if sum(n for _, n in open_.values()) <= FEW:
            values: dict[int, list[float]] = {}
            for row in part.select("id", "v").collect():
                values.setdefault(row["id"], []).append(row["v"])
            for i, of in enumerate(ids):
                own, (before, n) = sorted(values[i]), open_[of]
                found |= {(g, k): own[k - before] for g, k in waiting if g == of[0] and before <= k < before + n}
            return found
        width = F.col("high") / RANGES - F.col("low") / RANGES
        infinite = F.col("low") == float("-inf")
        nth = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), RANGES - 1).when(infinite, 1).when(width == 0, RANGES - 1).otherwise(F.least(F.lit(RANGES - 1), F.floor((F.col("v") - F.col("low")) / F.when(width > 0, width))))
        counts = part.groupBy("id", nth.cast("int").alias("nth")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("id", "nth").collect()
        narrower, at = {}, dict.fromkeys(range(len(ids)), 0)
        for row in counts:
            group, start = ids[row["id"]][0], open_[ids[row["id"]]][0] + at[row["id"]]
            narrower[group, row["low"], row["high"]] = (start, row["n"])
            at[row["id"]] += row["n"]
        open_ = narrower
