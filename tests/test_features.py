"""Point-in-time windows: boundaries, cold starts, leaks, and a brute-force comparison."""

import random
import re
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.medians import stretch_medians
from tidemark.model import COLD_START_PACK_MINUTES, LeakageError, TidemarkError
from tidemark.operators import features as f
from tidemark.sources.trips import from_events, generate, load, with_micros

BASE = datetime(2026, 9, 1, 9)
EVENTS = "/root/testdata/sf0.001/events.parquet"


def table(spark, *rows, promised=19):
    """rows: id, minute assigned, minutes taken (or None), and distance if it matters."""
    out = []
    for id_, at, took, *more in rows:
        distance = more[0] if more else 2200
        start = BASE + timedelta(minutes=at)
        out.append((id_, "S", "D", start, distance, promised, None if took is None else start + timedelta(minutes=took), None if took is None else float(took)))
    schema = "trip_id string, store_id string, driver_id string, assigned_at timestamp_ntz, distance_m int, promised_minutes int, delivered_at timestamp_ntz, tat_minutes double"
    return with_micros(spark.createDataFrame(out, schema))


def probe(df, id_="probe"):
    return df.where(F.col("trip_id") == id_).first()


@pytest.mark.parametrize(
    ("rows", "at", "count", "mean"),
    [
        ([("a", 0, 90)], 30, 0, 19),  # still on the way
        ([("a", 0, 29)], 30, 1, 29),  # just finished
        ([("a", 0, 30)], 30, 1, 30),  # finished at that very instant
        ([("a", 0, 10), ("b", 100, 10)], 131, 1, 10),  # fell out of the window
        ([("a", 0, 10)], 130, 0, 19),  # delivered exactly a window ago
        ([("a", 0, None)], 30, 0, 19),  # without a label
        ([("a", 0, 10), ("b", 200, 10)], 30, 1, 10),  # the future is withheld
        ([], 30, 0, 19),
    ],
)
def test_window_boundaries(spark, rows, at, count, mean):
    got = probe(f.historical(table(spark, *rows, ("probe", at, 500))))
    assert (got.driver_trips_120m, got.driver_mean_tat_120m) == (count, mean)


def test_cold_starts(spark):
    got = probe(f.historical(table(spark, ("probe", 0, None), promised=23)))
    assert (got.driver_mean_tat_120m, got.store_mean_tat_120m, got.driver_trips_120m, got.store_pack_p50_60m) == (23, 23, 0, COLD_START_PACK_MINUTES)


def test_median_stands_firm_where_the_mean_moves(spark):
    rows = [(f"r{i}", i, 10, 0) for i in range(5)] + [("late", 0, 59, 0)]
    got = probe(f.historical(table(spark, *rows, ("probe", 60, 500))))
    assert got.store_pack_p50_60m == 10.0 and abs(got.store_mean_tat_120m - 109 / 6) < 1e-9


def test_pack_is_what_driving_does_not_explain(spark):
    assert probe(f.historical(table(spark, ("a", 0, 30), ("probe", 40, 500)))).store_pack_p50_60m == 20.0


def test_derived(spark):
    got = probe(f.historical(table(spark, ("probe", 0, 10, 1799))))
    assert abs(got.log_distance - 7.4956) < 1e-4 and (got.hour_of_day, got.is_rush_hour, got.day_of_week) == (9, 0, 1)


def test_a_trip_of_no_duration_sees_itself(spark):
    assert probe(f.historical(table(spark, ("probe", 0, 0)))).driver_trips_120m == 1


def test_leaky_in_flight_reads_the_unknown(spark):
    trips = table(spark, ("a", 0, 40), ("b", 59, 20), ("probe", 60, 20))
    honest, leaky = probe(f.historical(trips)), probe(f.leaky_in_flight(trips))
    assert honest.driver_mean_tat_120m == 40 and abs(leaky.driver_mean_tat_120m - 20) < abs(honest.driver_mean_tat_120m - 20)
    alone = probe(f.leaky_in_flight(table(spark, ("probe", 0, 47))))
    assert (alone.driver_trips_120m, alone.driver_mean_tat_120m) == (1, 47)


def test_leaky_lifetime_reads_the_future(spark):
    trips = table(spark, ("probe", 60, 20), ("b", 400, 4))
    assert probe(f.historical(trips)).driver_trips_120m == 0
    got = probe(f.leaky_lifetime(trips))
    assert (got.driver_trips_120m, got.driver_mean_tat_120m) == (2, 12)


def test_guard(spark):
    trips = table(spark, ("a", 0, 40), ("probe", 20, 20))
    assert f.guard(trips) is trips
    with pytest.raises(LeakageError, match="trip (a|probe): the driver window of 120 minutes at .* holds trip (a|probe)"):
        f.guard(trips, "a_us")


def test_retention(spark):
    trips = table(spark, *((f"t{i}", 30 * i, 5) for i in range(20)))
    at = trips.agg(F.max("a_us")).first()[0] + 30 * 60_000_000
    assert f.retained(trips, at, 120).first().held < 20
    assert f.online(trips, "driver", 120, at).first().n == 4
    with pytest.raises(TidemarkError):
        f.retained(trips, at, 60)


def test_unknown_entities_are_refused():
    with pytest.raises(TidemarkError):
        f.entity_column("vehicle")
    with pytest.raises(TidemarkError):
        f.trailing(None, None, f.TRAILING)


def test_store_counts_are_not_doubled(spark):
    trips = table(spark, ("a", 0, 5), ("b", 1, 5), ("probe", 30, 5))
    count = f.Trailing("store_trips", "store", 120, "count")
    assert probe(f.trailing(trips, trips, (count,))).store_trips == 2


def brute(rows, entity, minutes, kind):
    out = {}
    for p in rows:
        inside = [h for h in rows if h.d_us is not None and h[entity] == p[entity] and p.a_us - minutes * 60_000_000 < h.d_us <= p.a_us]
        pack = sorted(float(h.tat) - h.distance_m / 220.0 for h in inside)
        mid = len(pack) // 2
        median = None if not pack else pack[mid] if len(pack) % 2 else (pack[mid - 1] + pack[mid]) / 2
        out[p.trip_id] = {"count": float(len(inside)), "mean": float(sum(h.tat for h in inside)) / len(inside) if inside else None, "median": median}[kind]
    return out


def same(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


@pytest.mark.parametrize("spec", f.TRAILING, ids=lambda s: s.name)
def test_against_brute_force(spark, spec):
    trips = from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    want = brute(trips.collect(), f.ENTITY_COLUMN[spec.entity], spec.window_minutes, spec.kind)
    got = {r.trip_id: r[spec.name] for r in f.trailing(trips, trips, (spec,)).collect()}
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)


def test_running_totals_give_the_same(spark):
    trips = from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    wide = (f.Trailing("m", "store", 600, "mean"), f.Trailing("n", "store", 90, "count"))
    key = lambda df: sorted((r.trip_id, r.m and round(r.m, 9), r.n) for r in df.collect())
    assert key(f.running(trips, trips, wide, slice_minutes=300)) == key(f.trailing(trips, trips, wide))


def test_one_shuffle_for_an_entity(spark):
    trips = from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    own = tuple(x for x in f.TRAILING if x.entity == "store")
    plan = f.trailing(trips, trips, own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_repeated_ids_multiply_nothing(spark):
    trips = table(spark, ("a", 0, 5), ("probe", 30, 5), ("probe", 30, 5), ("probe", 31, 5))
    spec = (f.Trailing("n", "store", 120, "count"),)
    assert sorted((r.a_us, r.n) for r in f.running(trips, trips, spec).collect()) == sorted((r.a_us, r.n) for r in f.trailing(trips, trips, spec).collect())
    assert f.running(trips, trips, spec).count() == 4


def test_dense_windows_against_brute_force(spark):
    """Many ties, windows of several widths and slices that end within windows."""
    draw = random.Random(9)
    rows = [(f"t{i:03d}", draw.randrange(900), draw.choice([None, 0, 5, 5, 30, 61, 200]), draw.randrange(0, 5000)) for i in range(400)]
    trips = table(spark, *rows)
    specs = tuple(f.Trailing(f"{k}_{w}", "store", w, k) for k in ("mean", "count", "median") for w in (20, 60))
    specs += (f.Trailing("far", "store", 45, "custom", "", lambda: F.col("distance_m").cast("double"), F.max),)
    got, local = {r.trip_id: r for r in f.trailing(trips, trips, specs).collect()}, trips.collect()
    assert len(got) == 400
    for s in specs[:-1]:
        want = brute(local, "store_id", s.window_minutes, s.kind)
        assert all(same(got[k][s.name], v) for k, v in want.items()), s
    for p in local:
        inside = [h.distance_m for h in local if h.d_us is not None and p.a_us - 45 * 60_000_000 < h.d_us <= p.a_us]
        assert got[p.trip_id].far == (max(inside) if inside else None)


def test_catalogues_of_ones_own(spark):
    own = (f.Derived("far", "", lambda: (F.col("distance_m") > 1000).cast("double")), f.Trailing("longest", "driver", 60, "custom", "", lambda: F.col("tat").cast("double"), F.max, lambda: F.lit(-1.0)))
    trips = table(spark, ("a", 0, 10), ("b", 1, 25), ("probe", 30, 500))
    assert (probe(f.historical(trips, own)).far, probe(f.historical(trips, own)).longest) == (1.0, 25.0)
    assert probe(f.historical(trips, own), "a").longest == -1.0 and probe(f.leaky_lifetime(trips, own), "a").longest == 500.0
    assert f.vectors(f.historical(trips, own), ("far", "longest")).where("trip_id = 'b'").first()["values"] == {"far": 1.0, "longest": -1.0}
    for bad in ({"kind": "custom"}, {"kind": "mode"}, {"kind": "mean", "aggregate": F.max}):
        with pytest.raises(TidemarkError):
            f.Trailing("x", "driver", 60, **bad)


def test_replay_as_of_another_instant(spark):
    trips = table(spark, ("a", 0, 40), ("probe", 20, 500))
    assert probe(f.historical(trips)).driver_trips_120m == 0
    later = probe(f.historical(trips, as_of=F.col("a_us") + 20 * 60_000_000))
    assert later.driver_trips_120m == 1 and later.as_of_us == later.a_us + 20 * 60_000_000


def test_generator(spark):
    a, b = generate(spark, 3_000, seed=5, days=3, drivers=6), generate(spark, 3_000, seed=5, days=3, drivers=6)
    assert sorted(a.collect()) == sorted(b.repartition(3).collect()) and a.agg(F.countDistinct("driver_id")).first()[0] == 6
    assert a.where("tat_minutes < 4 or delivered_at <= assigned_at").count() == 0
    rush = F.hour("assigned_at").isin(12, 13, 19, 20, 21)
    means = {r.rush: r.t for r in a.groupBy(rush.alias("rush")).agg(F.avg("tat_minutes").alias("t")).collect()}
    assert 1.15 < means[True] / means[False] < 1.35
    by_store = {r.store_id: r.t for r in a.groupBy("store_id").agg(F.avg("tat_minutes").alias("t")).collect()}
    assert 3 < by_store["NORTHGATE"] - by_store["RIVERSIDE"] < 8


def test_one_schema_from_sources_to_operators(spark, tmp_path):
    """The warehouse's table, the generator that stands in for it, and what a user does with either."""
    made = load(spark, str(tmp_path / "nothing"), n=500)
    fact = made.drop("a_us", "d_us", "tat").withColumn("completeness", F.when(F.col("trip_id") < "T-000000000100", "partial").otherwise("complete"))
    fact.withColumn("tat_minutes", F.when(F.col("trip_id") != "T-000000000200", F.col("tat_minutes"))).write.parquet(str(tmp_path / "fact"))
    read = load(spark, str(tmp_path / "fact"))
    assert read.columns == made.columns and read.count() == 399
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "completeness,complete" in plan.replace(" ", "").replace("EqualTo(", "")
    assert f.historical(read).count() == 399
    for trips in (from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")), made):
        assert {c for c in made.columns} <= set(trips.columns)


def test_medians_leave_out_packs_that_are_not_known(spark):
    """Null distances and NaN ones."""
    rows = [("a", "s", 0, 60 + i, 10.0 + i, None if i % 3 == 0 else float("nan") if i % 3 == 1 else 220.0 * i) for i in range(30)]
    raw = spark.createDataFrame(rows, "trip_id string, store_id string, a_min long, d_min long, took double, distance_m double")
    trips = raw.select("trip_id", "store_id", F.lit("d").alias("driver_id"), (F.col("a_min") * 60_000_000 + 90 * 60_000_000).alias("a_us"), (F.col("d_min") * 60_000_000).alias("d_us"), F.col("took").cast("decimal(18,3)").alias("tat"), "distance_m")
    own = (f.Trailing("m", "store", 60, "median"),)
    found = f.trailing(trips, trips, own).select("m").distinct().collect()
    packs = [10.0 + i - i for i in range(30) if i % 3 == 2 and 60 + i <= 90]
    assert [r.m for r in found] == [pytest.approx(sum(packs) / len(packs))]
    nothing = trips.withColumn("distance_m", F.lit(None).cast("double"))
    assert f.trailing(nothing, nothing, own).where("m IS NOT NULL").count() == 0


def test_members_are_those_of_the_window(spark):
    trips = from_events(spark.read.parquet(EVENTS)).persist()
    for minutes in (20, 700):
        got = {}
        for r in f.members(trips, trips, "store", minutes).collect():
            got.setdefault(r.trip_id, []).append(r.member_id)
        own = trips.collect()
        for p in own:
            want = sorted(h.trip_id for h in own if h.store_id == p.store_id and h.d_us is not None and p.a_us - minutes * 60_000_000 < h.d_us <= p.a_us)
            assert sorted(got.get(p.trip_id, [])) == want


def test_a_guard_in_the_plan(spark):
    trips = from_events(spark.read.parquet(EVENTS)).persist()
    fair = f.historical(trips, guarded=True)
    assert sorted(map(repr, fair.collect())) == sorted(map(repr, f.historical(trips).collect()))
    with pytest.raises(Exception, match=r"trip \d+: the driver window of 120 minutes at \d+ us holds trip \d+, which is delivered at \d+ us"):
        f.leaky_in_flight(trips, guarded=True).collect()
    with pytest.raises(Exception, match="the store window of 60 minutes"):
        f.trailing(trips, trips, f.TRAILING[:1], "a_us", guarded=True).collect()


def test_python_over_a_window(spark):
    """A pandas UDF that gets the window's trips and a column of the probe."""
    trips = from_events(spark.read.parquet(EVENTS)).persist()

    @F.pandas_udf("double")
    def share(members: pd.Series, mine: pd.Series) -> pd.Series:
        return pd.Series([float(np.mean([d > m for d in ds])) if len(ds) else None for ds, m in zip(members, mine, strict=True)])

    farther = lambda m: F.when(F.size(m) > 0, F.size(F.filter(m, lambda d: d > F.col("distance_m"))) / F.size(m))
    specs = [f.Trailing("x", "driver", 2880, "custom", value=lambda: F.col("distance_m"), of_members=of) for of in (farther, lambda m: share(m, F.col("distance_m")))]
    one, two = ({r.trip_id: r.x for r in f.trailing(trips, trips, (s,)).collect()} for s in specs)
    assert one.keys() == two.keys() and all(a == b or a == pytest.approx(b) for a, b in ((one[k], two[k]) for k in one)) and any(one.values())
    with pytest.raises(TidemarkError):
        f.leaky_lifetime(trips, (specs[0],))


def test_merged_windows_against_brute_force(spark):
    """Maxima, minima and a merge of one's own over widths that do and don't divide a slice, with ties and a leak."""
    draw = random.Random(5)
    trips = table(spark, *((f"t{i:03d}", draw.randrange(1300), draw.choice([None, 0, 5, 5, 30, 61, 200]), draw.randrange(0, 5000)) for i in range(300))).persist()
    far = lambda: F.col("distance_m").cast("double")
    ways = {"max": (F.max, max, None), "min": (F.min, min, None), "sum": (F.sum, sum, lambda a, b: F.coalesce(a + b, a, b))}
    specs = tuple(f.Trailing(f"{k}_{w}", "store", w, "custom", "", far, ways[k][0], merge=ways[k][2]) for k in ways for w in (7, 45, 60))
    local = trips.collect()
    for at in ("d_us", "a_us"):
        got = {r.trip_id: r for r in f.trailing(trips, trips, specs, at).collect()}
        assert len(got) == 300
        for p in local:
            for s in specs:
                inside = [h.distance_m for h in local if h.d_us is not None and p.a_us - s.window_minutes * 60_000_000 < h[at] <= p.a_us]
                assert got[p.trip_id][s.name] == (ways[s.name[:3]][1](inside) if inside else None), (p, s)
    leaks = lambda minutes: sum(any(h.d_us is not None and p.a_us - minutes * 60_000_000 < h.a_us <= p.a_us < h.d_us for h in local) for p in local)
    audit = {r.entity: (r.probes, r.leaks) for r in f.leak_audit(trips, "a_us").collect()}
    assert audit["store"] == (300, leaks(120)) and {r.leaks for r in f.leak_audit(trips).collect()} == {0}
    with pytest.raises(TidemarkError):
        f.Trailing("x", "driver", 60, "mean", merge=F.greatest)


def test_no_frame_slides_over_a_window_that_merges(spark):
    """Frames that slide are computed anew for each row, so a busy entity's work grew with the square of its rows."""
    trips = from_events(spark.read.parquet(EVENTS))
    longest = f.Trailing("longest", "store", 60, "custom", "", lambda: F.col("tat").cast("double"), F.max)
    for df in (f.leak_audit(trips), f.leak_audit(trips, "a_us"), f.trailing(trips, trips, (longest,)), f.trailing(trips, trips, f.TRAILING[:1], guarded=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "unboundedpreceding" in plan and not re.search(r"RangeFrame, -?\d", plan)


def test_medians_of_stretches(spark):
    draw = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 300):
        values, low, high = np.round(draw.normal(size=n), 1), draw.integers(0, n + 1, 200), draw.integers(0, n + 1, 200)
        want = [np.median(values[a:b]) if a < b else np.nan for a, b in zip(low, high, strict=True)]
        assert np.array_equal(stretch_medians(values, low, high), want, equal_nan=True)


def test_medians_cost_the_same_however_long_the_windows(spark):
    """3 * 10^9 values in windows: to sort each window took minutes."""
    values, low = np.random.default_rng(2).normal(size=100_000), np.arange(100_000) // 2
    began = time.process_time()
    found = stretch_medians(values, low, low + 30_000)
    assert time.process_time() - began < 10 and found[7] == np.median(values[3:30_003])


def test_runs_that_go_on_over_batches():
    draw = np.random.default_rng(3)
    for _ in range(50):
        key = np.sort(draw.integers(0, draw.integers(1, 12), draw.integers(1, 60)))
        batches = [pa.record_batch([pa.array(x)], ["k"]) for x in np.split(key, np.sort(draw.integers(0, len(key) + 1, 6)))]
        got = [np.asarray(t.column("k"))[a:b].tolist() for t, ends in f.runs(iter(batches), ("k",)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == [key[key == x].tolist() for x in np.unique(key)]


def test_a_larger_table_has_more_partitions(spark, monkeypatch):
    """The count was the session's, so one task's rows and memory grew with the table."""
    trips = from_events(spark.read.parquet(EVENTS))
    monkeypatch.setattr(f, "LINE_BYTES", 4_000)
    assert f.trailing(trips, trips, f.TRAILING[:1]).rdd.getNumPartitions() > 8
