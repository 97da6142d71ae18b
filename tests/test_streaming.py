"""The streams' answers against the batch's, with history that arrives out of order."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.model import TidemarkError
from tidemark.operators import features as f
from tidemark.plans.queries import played
from tidemark.sources.trips import from_events, generate, outcomes_of, predictions_of
from tidemark.streaming import store

EVENTS = "/root/testdata/sf0.001/events.parquet"


def feed(spark, trips, folder, parts, shuffled):
    """trips as a stream of files, in the order of delivery or in none."""
    rows = trips.orderBy(F.coalesce("d_us", "a_us")).collect()
    order = list(range(parts))
    if shuffled:
        random.Random(3).shuffle(order)
    size = -(-len(rows) // parts)
    for i in order:
        spark.createDataFrame(rows[i * size : (i + 1) * size], trips.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(trips.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("shuffled", [False, True])
def test_parity(spark, tmp_path, shuffled):
    trips = from_events(spark.read.parquet(EVENTS)).persist()
    own = tuple(x for x in f.TRAILING if x.entity == "store")
    # In no order at all, rows may be a month late.
    late = "40 days" if shuffled else "6 hours"
    got = {r.trip_id: r for r in played(store.online_features(feed(spark, trips, tmp_path / "in", 4, shuffled), own, late=late)).collect()}
    batch = {str(r.trip_id): r for r in f.trailing(trips, trips, own).collect()}
    if not shuffled:
        assert len(got) > 900
    for k, r in got.items():
        assert all(r[x.name] == batch[k][x.name] or abs(r[x.name] - batch[k][x.name]) < 1e-9 for x in own), k


def test_parity_with_thousandths_of_a_minute(spark, tmp_path):
    """Means of generated trips, whose times have three decimals, are the batch's to the last digit."""
    trips = generate(spark, 600, 4, days=3, drivers=6).persist()
    assert trips.where("tat * 100 != floor(tat * 100)").count() > 100
    for entity in ("driver", "store"):
        own = tuple(x for x in f.TRAILING if x.entity == entity)
        got = {r.trip_id: r for r in played(store.online_features(feed(spark, trips, tmp_path / entity, 3, False), own, late="6 hours")).collect()}
        batch = {r.trip_id: r for r in f.trailing(trips, trips, own).collect()}
        assert len(got) > 300
        for k, r in got.items():
            assert [r[x.name] for x in own if x.kind != "median"] == [batch[k][x.name] for x in own if x.kind != "median"]
            assert all(r[x.name] == pytest.approx(batch[k][x.name], abs=1e-9) for x in own if x.kind == "median")


def test_packs_that_are_not_known_are_left_out(spark, tmp_path):
    trips = from_events(spark.read.parquet(EVENTS)).withColumn("distance_m", F.when(F.col("trip_id") % 3 != 0, F.col("distance_m"))).persist()
    own = f.TRAILING[:1]
    got = {r.trip_id: r[2] for r in played(store.online_features(feed(spark, trips, tmp_path / "in", 2, False), own)).collect()}
    batch = {str(r.trip_id): r[own[0].name] for r in f.trailing(trips, trips, own).collect()}
    assert len(got) > 900 and all(v == pytest.approx(batch[k], abs=1e-9) for k, v in got.items())


def test_a_trigger_touches_what_is_new_or_due(spark, tmp_path):
    """With four times the history in the state, a trigger of as many rows updates no more of it."""
    trips = from_events(spark.read.parquet(EVENTS))
    own = tuple(x for x in f.TRAILING if x.entity == "store")
    stream = store.online_features(feed(spark, trips, tmp_path / "in", 8, False), own, retain_minutes=60 * 24 * 40)
    spark.conf.set(*store.PROVIDER)
    try:
        run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(store.PROVIDER[0])
    steps = [(p["numInputRows"], p["stateOperators"][0]) for p in run.recentProgress if p["numInputRows"]]
    updated = [s["numRowsUpdated"] for _, s in steps]
    assert len(steps) == 8 and steps[-1][1]["numRowsTotal"] > 2.5 * steps[1][1]["numRowsTotal"]
    assert max(updated[4:]) < 1.5 * max(updated[:4])


def test_retention_covers_the_windows(spark, tmp_path):
    with pytest.raises(TidemarkError):
        store.online_features(None, f.TRAILING[:1], retain_minutes=10)
    with pytest.raises(TidemarkError):
        store.online_features(None, f.TRAILING)


def test_unfinished_trips_are_kept_aside(spark, tmp_path):
    trips = from_events(spark.read.parquet(EVENTS)).withColumn("d_us", F.when(F.col("trip_id") % 9 != 0, F.col("d_us")))
    got = played(store.unfinished(feed(spark, trips, tmp_path / "in", 2, False))).groupBy("reason").count().collect()
    want = trips.groupBy((F.col("tat").isNull()).alias("open"), F.col("d_us").isNull().alias("lost")).count().collect()
    assert {r.reason: r["count"] for r in got} == {"no duration yet": sum(r["count"] for r in want if r.open), "no delivery known": sum(r["count"] for r in want if r.lost and not r.open)}


def test_labels_join_as_they_come(spark, tmp_path):
    trips = from_events(spark.read.parquet(EVENTS))
    predictions_of(trips).write.parquet(str(tmp_path / "p"))
    outcomes_of(trips).write.parquet(str(tmp_path / "o"))
    read = lambda x: spark.readStream.schema(spark.read.parquet(str(tmp_path / x)).schema).parquet(str(tmp_path / x))
    assert played(store.labelled(read("p"), read("o"))).count() == outcomes_of(trips).count()


def test_sliding_windows_close_above(spark, tmp_path):
    minute = 60_000_000
    rows = [(1, 60 * minute, 10.0, False), (2, 61 * minute, 20.0, True), (3, 10_000 * minute, 1.0, False)]
    spark.createDataFrame(rows, "trip_id long, served_us long, pred_minutes double, fallback boolean").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("trip_id long, served_us long, pred_minutes double, fallback boolean").parquet(str(tmp_path / "p"))
    got = {int(r.as_of.timestamp()) // 60: r.requests for r in played(store.sliding_health(stream)).collect()}
    assert got[60] == 1 and got[65] == 2 and got[115] == 2 and got[120] == 1


def test_rows_of_a_trigger_are_put_without_reading(spark):
    """Rows of one bucket in many parts: each part read and wrote all that came before it."""

    class State(dict):
        read = 0

        def getValue(self, key):  # noqa: N802
            State.read += 1
            return self[key]

        updateValue, removeKey = dict.__setitem__, dict.pop  # noqa: N815

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return State()

        def getValueState(self, *_):  # noqa: N802
            return type("Value", (), {"exists": lambda s: hasattr(s, "v"), "get": lambda s: s.v, "update": lambda s, v: setattr(s, "v", v)})()

        registerTimer = deleteTimer = lambda *_: None  # noqa: N815

    own = store.Store(tuple(x for x in f.TRAILING if x.entity == "store"), 100, 1440)
    own.init(Handle())
    rows = [pd.DataFrame({"key": ["a", "a"], "t": [i, i + 1], "trip_id": [str(i), None], "parts": [None, 5], "pack": [None, 1.0]}) for i in range(0, 100, 2)]
    list(own.handleInputRows(("a",), iter(rows), None))
    assert State.read == 0 and sum(len(v[1]) for v in own.waiting.values()) == 50 == sum(len(v[1]) for v in own.history.values())
    assert len(own.history) == 1
