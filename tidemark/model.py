"""Row types, constants and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


class TidemarkError(RuntimeError):
    """Anything this library refuses to do."""


class LeakageError(TidemarkError):
    """A feature was about to read something that wasn't known at its instant."""


#: A trip: assigned at an instant, delivered (and labelled) later or not yet.
TRIP = T.StructType(
    [
        T.StructField("trip_id", T.StringType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("driver_id", T.StringType()),
        T.StructField("assigned_at", T.TimestampNTZType()),
        T.StructField("distance_m", T.IntegerType()),
        T.StructField("promised_minutes", T.IntegerType()),
        T.StructField("delivered_at", T.TimestampNTZType()),
        T.StructField("tat_minutes", T.DoubleType()),
    ]
)

# Fixed values that are part of the semantics.
RUSH_HOURS = (12, 13, 19, 20, 21)
NOMINAL_SPEED_M_PER_MIN = 220.0
COLD_START_PACK_MINUTES = 8.0
RETAIN_MINUTES = 1440
MINIMUM_MINUTES = 1.0
RIDGE_ALPHA = 1.0
HOLDOUT = 0.2
PIVOT_TOLERANCE = 1e-12
PSI_FLOOR = 1e-6
PSI_BINS = 10
DRIFT_WINDOW_MINUTES = 60
SIGNIFICANCE, POWER = 0.05, 0.80
VERSION_DIGITS = 12

MINUTE_US = 60_000_000


@dataclass(frozen=True)
class Guardrail:
    """When an experiment stops whatever its means say."""

    max_fallback_rate: float = 0.05
    max_error_ratio: float = 1.10
