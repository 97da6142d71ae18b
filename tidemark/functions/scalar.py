"""Column expressions for single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import MINUTE_US, NOMINAL_SPEED_M_PER_MIN, RUSH_HOURS


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def at_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def parse_timestamp(text: Column) -> Column:
    """ISO text to a timestamp without zone; a trailing Z is dropped, not converted. Null if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z", "")).cast("timestamp_ntz")


def rush_hour(hour: Column) -> Column:
    return F.when(hour.isin(*RUSH_HOURS), 1.0).otherwise(0.0)


def implied_pack(tat: Column, distance: Column) -> Column:
    """Minutes not explained by driving at nominal speed; negative if driven faster."""
    return tat.cast("double") - distance.cast("double") / NOMINAL_SPEED_M_PER_MIN


def within(moment_us: Column, as_of_us: Column, minutes: float) -> Column:
    """moment in (as_of - minutes, as_of]."""
    return (moment_us > as_of_us - int(minutes * MINUTE_US)) & (moment_us <= as_of_us)


def bucket(entity: Column, salt: str) -> Column:
    """A number in [0, 1] from the first 8 bytes of a SHA-256 of salt and id; 1.0 only by rounding of the topmost digests."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), entity), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20, 0)").cast("double") / F.lit(float(2**64))


def finite(x: Column) -> Column:
    """NaN is tested first: Spark orders it above every number."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def bin_of(edges: Column, x: Column) -> Column:
    """Number of edges below x: bins are open below and closed above, (-inf, e0], (e0, e1], ..."""
    return F.size(F.filter(edges, lambda e: e < x))


def minutes_between(later_us: Column, earlier_us: Column) -> Column:
    return (later_us - earlier_us) / F.lit(float(MINUTE_US))
