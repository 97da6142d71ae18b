"""The store of finished trips: told in parts, asked in batches and by a stream that is restarted."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as f
from tidemark.operators.history import TripStore
from tidemark.plans.queries import FIXED, requests_of
from tidemark.sources.trips import from_events
from tidemark.streaming.requests import observe_stream, score_requests

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def trips(spark):
    return from_events(spark.read.parquet(EVENTS)).persist()


def rows(df, *more):
    return sorted(repr(r) for r in df.select(F.col("trip_id").cast("string").alias("trip_id"), *more, *(F.round(c, 9).alias(c) for c in f.FEATURE_NAMES)).collect())


def test_asked_for_each_probe(spark, trips, tmp_path):
    store = TripStore(spark, str(tmp_path), buckets=3, days=10)
    for part in range(3):
        store.tell(trips.where(F.col("trip_id") % 3 == part), f"p{part}")
    store.tell(trips.where(F.col("trip_id") % 3 == 1), "p1")  # told again
    assert rows(store.ask(trips)) == rows(f.historical(trips))


def test_nothing_told(spark, trips, tmp_path):
    found = TripStore(spark, str(tmp_path / "none")).ask(trips)
    assert found.where("driver_trips_120m > 0").count() == 0 and found.count() == trips.count()


def test_files_of_other_buckets_and_days_stay_closed(spark, trips, tmp_path):
    store = TripStore(spark, str(tmp_path), buckets=8)
    store.tell(trips, "all")
    one = trips.where("trip_id = 700")
    plan = store.history(one, "driver", 120)._jdf.queryExecution().executedPlan().toString()
    used = re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]
    assert all(c in used for c in ("part_entity", "part_bucket", "part_day"))
    assert len(store.history(one, "driver", 120).inputFiles()) > 0
    read = store.history(one, "driver", 120).select(F.input_file_name()).distinct().count()
    assert read <= 2
    assert rows(store.ask(one)) == rows(f.historical(trips).where("trip_id = 700"))


def stream(spark, table, folder, parts):
    for i in range(parts):
        table.where(F.pmod(F.xxhash64(*table.columns), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_stream_of_requests_survives_a_restart(spark, trips, tmp_path):
    class Failing(TripStore):
        asked = 0

        def ask(self, *args):
            Failing.asked += 1
            if Failing.asked == 3:
                raise RuntimeError("lost")
            return super().ask(*args)

    store = TripStore(spark, str(tmp_path / "store"), buckets=2, days=40)
    run = observe_stream(stream(spark, trips, tmp_path / "done", 2), store, str(tmp_path / "told"))
    run.awaitTermination()
    bodies = requests_of(trips).unionByName(spark.createDataFrame([("{",), ('{"trip_id": "x"}',), (None,)], "body string"))
    source = stream(spark, bodies, tmp_path / "in", 4)
    log, dead, state = (str(tmp_path / x) for x in ("log", "dead", "state"))
    start = lambda s: score_requests(source, s, FIXED.predict(), "fixed", log, dead, state).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        start(Failing(spark, store.path, buckets=2, days=40))
    assert 0 < spark.read.parquet(log).count() < trips.count()
    start(store)
    served = spark.read.parquet(log)
    want = f.historical(trips).select(F.col("trip_id").cast("string").alias("trip_id"), F.round(FIXED.predict(), 6).alias("m"))
    assert sorted((r.trip_id, round(r.pred_minutes, 6)) for r in served.collect()) == sorted((r.trip_id, r.m) for r in want.collect())
    assert served.where("fallback").count() == 0 and served.select("batch").distinct().count() == 4
    assert sorted((r.body or "", r.error) for r in spark.read.parquet(dead).collect()) == [("", "request is missing trip_id"), ("{", "request is missing trip_id"), ('{"trip_id": "x"}', "request is missing store_id")]
