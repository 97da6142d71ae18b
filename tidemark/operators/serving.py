"""Batch scoring with flagged fallbacks, what becomes of finished trips, and what the serving log says about itself."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite
from tidemark.operators.features import instant
from tidemark.operators.selection import with_percentiles
from tidemark.sources.trips import finished

#: Percentiles of latencies.
RANKS = {"p50_ms": ("nearest", 0.5), "p99_ms": ("nearest", 0.99)}


def predict(featured: DataFrame, minutes: Column, names: tuple[str, ...], version: str, variant: str = "control") -> DataFrame:
    """A prediction for each trip, as of its assignment (or as_of_us, in a replay); the promise, flagged and with the reason, where there is none to give.

    A missing feature is a failure of the store, a missing, infinite or non-positive estimate one of the model.
    """
    missing = F.coalesce(*(F.when(F.col(c).isNull(), c) for c in names)) if names else F.lit(None).cast("string")
    reason = (
        F.when(missing.isNotNull(), F.concat(F.lit("features: missing "), missing))
        .when(F.col("raw").isNull(), "model: no estimate")
        .when(~finite(F.col("raw")) | (F.col("raw") <= 0), F.concat(F.lit("model returned "), F.col("raw").cast("string")))
        .otherwise("")
    )
    scored = featured.withColumn("raw", minutes).withColumn("fallback_reason", reason)
    fallback = F.col("fallback_reason") != ""
    return scored.select(
        "trip_id",
        F.when(fallback, F.col("promised_minutes").cast("double")).otherwise(F.col("raw")).alias("pred_minutes"),
        F.lit(version).alias("model_version"),
        F.lit(variant).alias("variant"),
        instant(featured).alias("served_us"),
        fallback.alias("fallback"),
        "fallback_reason",
    )


class Observed(NamedTuple):
    """What became of trips handed back: told to the store, kept because there is no store to tell, or refused (with a reason)."""

    told: DataFrame
    unobserved: DataFrame
    refused: DataFrame


def observe(trips: DataFrame, store: str | None = None) -> Observed:
    """Hands finished trips back, so that the next prediction can see them: appended to the store's table, if there is one.

    Trips without a label are refused, and by a store those without a delivery, too: it orders history by delivery.
    Without a store labelled trips are unobserved, for whoever counts or replays them.
    """
    reason = F.when(F.col("tat").isNull(), "no duration yet")
    if store is not None:
        reason = reason.when(F.col("d_us").isNull(), "no delivery known")
    refused = trips.withColumn("reason", reason).where("reason is not null")
    labelled, none = trips.where(F.col("tat").isNotNull()), trips.limit(0)
    if store is None:
        return Observed(none, labelled, refused)
    told = finished(trips)
    told.write.mode("append").parquet(store)
    return Observed(told, none, refused)


def latency(log: DataFrame, ms: str = "ms", by: tuple[str, ...] = ()) -> DataFrame:
    """n, p50, p99, max and mean of a column of milliseconds; zeros if there are no requests."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = log.groupBy(*by).agg(F.count(ms).alias("n"), zero(F.max(ms)).alias("max_ms"), zero(F.avg(ms)).alias("mean_ms"))
    found = with_percentiles(sums, log, by, ms, RANKS)
    return found.select(*by, "n", *(zero(F.col(c)).alias(c) for c in RANKS), "max_ms", "mean_ms")


def fallback_rate(flag: str = "fallback") -> Column:
    return F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0))


def health(log: DataFrame, ms: str = "ms") -> DataFrame:
    """One row: whether the service is up (a log with a model version), requests, fallbacks, and latency."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = log.agg(
        (F.count("model_version") > 0).alias("ok"),
        F.max_by("model_version", F.struct("served_us", "model_version")).alias("model_version"),
        F.count(F.lit(1)).alias("requests"),
        F.count_if("fallback").alias("fallbacks"),
        fallback_rate().alias("fallback_rate"),
        zero(F.max(ms)).alias("max_ms"),
        zero(F.avg(ms)).alias("mean_ms"),
    )
    found = with_percentiles(sums, log, (), ms, RANKS)
    return found.select("ok", "model_version", "requests", "fallbacks", "fallback_rate", *(zero(F.col(c)).alias(c) for c in RANKS), "max_ms", "mean_ms")
