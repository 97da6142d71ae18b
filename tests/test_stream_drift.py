"""Stability on a stream, from panes of counts, against the batch's figures."""

import pytest
from pyspark.sql import functions as F

from tidemark.model import MINUTE_US, TidemarkError
from tidemark.operators import drift, monitoring
from tidemark.plans.queries import played
from tidemark.sources.trips import from_events
from tidemark.streaming.drift import sliding_psi

EVENTS = "/root/testdata/sf0.001/events.parquet"
DAY = 1440


def stream_of(spark, rows, folder, parts=3):
    """rows as a stream of files in order of time."""
    held = rows.orderBy("at_us").collect()
    size = -(-len(held) // parts)
    for i in range(parts):
        spark.createDataFrame(held[i * size : (i + 1) * size], rows.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_each_store_equals_the_batch(spark, tmp_path):
    trips = from_events(spark.read.parquet(EVENTS)).where("tat is not null")
    values = trips.select("store_id", F.col("a_us").alias("at_us"), F.col("tat").cast("double").alias("value"), F.col("a_us").alias("served_us")).persist()
    low, high = values.agg(F.min("at_us"), F.max("at_us")).first()
    earlier = values.where(F.col("at_us") < (low + high) // 2)
    got = {(r.as_of_us, r.store_id): r for r in played(sliding_psi(stream_of(spark, values.drop("served_us"), tmp_path / "in"), drift.profile(earlier, ["store_id"]), ("store_id",), DAY, 60)).collect()}
    instants = sorted({at for at, _ in got})
    assert len(instants) > 24 * 20 and max(instants) > high - 80 * MINUTE_US
    some = instants[5::97]
    recent = monitoring.in_window(values, some, DAY)
    want = {(r.as_of_us, r.store_id): r.psi for r in drift.psi(earlier, recent, ["store_id"], over=("as_of_us",)).collect()}
    counts = {(r.as_of_us, r.store_id): r["count"] for r in recent.groupBy("as_of_us", "store_id").count().collect()}
    assert {k for k in got if k[0] in some} == {k for k, n in counts.items() if n >= 2}
    for k, n in counts.items():
        if n >= 2:
            assert got[k].n == n and got[k].psi == pytest.approx(want[k], abs=1e-12)


def test_values_that_do_not_count(spark, tmp_path):
    """Nulls, groups without a reference, and windows of one value; edges of windows are closed above."""
    minute = MINUTE_US
    rows = [("a", 60 * minute, 1.0), ("a", 61 * minute, 9.0), ("a", 61 * minute, None), ("b", 62 * minute, 1.0), ("b", 63 * minute, 1.0), ("a", 10_000 * minute, 1.0)]
    values = spark.createDataFrame(rows, "k string, at_us long, value double")
    reference = drift.profile(spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", 1.0)], "k string, value double"), ["k"])
    got = {(r.as_of_us // minute, r.k): r.n for r in played(sliding_psi(stream_of(spark, values, tmp_path / "in", 1), reference, ("k",), 30, 10)).collect()}
    assert got == {(70, "a"): 2, (80, "a"): 2}


def test_refuses_odd_parameters(spark, tmp_path):
    values = spark.createDataFrame([(1, 1.0)], "at_us long, value double")
    one = spark.createDataFrame([(1.0, "x"), (2.0, "x")], "value double, of string")
    with pytest.raises(TidemarkError):
        sliding_psi(values, drift.profile(one, ["of"]), minutes=50, every=7)
    with pytest.raises(TidemarkError):
        sliding_psi(values, drift.profile(one.limit(1), ["of"]), minutes=50, every=5)
