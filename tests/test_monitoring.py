import math
import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from tidemark.model import TidemarkError
from tidemark.operators import drift, monitoring, serving
from tidemark.sources.trips import from_payloads, latest, outcomes_of, require_unique

MINUTE = 60_000_000
LOG = "trip_id long, pred_minutes double, served_us long, fallback boolean, actual_minutes double, label_us long"


def outage(spark, n, wrong):
    """A trip a minute from 08:00, 35 minutes each; from 09:00 on a broken model answers ``wrong``. Minutes are from 08:00."""
    rows = [(i, wrong if i >= 60 and wrong else 35.5, i * MINUTE, False, 35.0, (i + 35) * MINUTE) for i in range(n)]
    return spark.createDataFrame(rows, LOG)


def test_accuracy_lags_behind_the_outage(spark):
    at = [m * MINUTE for m in (80, 100, 120)]
    out = monitoring.outage(outage(spark, 200, None), outage(spark, 200, 60.0), at).orderBy("as_of_us").collect()
    assert [(r.scored, r.labels_pending) for r in out] == [(46, 154), (66, 134), (86, 114)]
    assert [r.mae_healthy for r in out] == [0.5] * 3
    assert [r.verdict for r in out] == ["identical", "diverged", "diverged"] and out[2].mae_broken > out[1].mae_broken > 0.5
    served = monitoring.pending(outage(spark, 200, 60.0), at[:1], served_only=True).first()
    assert served.labels_pending == 81 - 46


def test_nothing_known_yet(spark):
    log = outage(spark, 5, None)
    assert monitoring.realised(log, [0]).collect() == []
    assert math.isnan(monitoring.label_lag(log, [0]).first().label_lag_minutes)
    blind = monitoring.blind(log, [0]).first()
    assert blind.scored_through_us is None and blind.blind_minutes == math.inf


def test_lag_and_blindness(spark):
    log, at = outage(spark, 200, None), [100 * MINUTE]
    assert monitoring.label_lag(log, at).first().label_lag_minutes == 35
    got = monitoring.blind(log, at).first()
    assert (got.scored_through_us, got.blind_minutes) == (65 * MINUTE, 35)


def test_optimism(spark):
    rows = [(i, 26.0, 0, False, 30.0, MINUTE) for i in range(40)]
    got = monitoring.realised(spark.createDataFrame(rows, LOG), [MINUTE]).first()
    assert (got.mae, got.breach_rate) == (4.0, 1.0)


def sample(spark, values):
    return spark.createDataFrame([("g", float(v)) for v in values], "g string, value double")


def psi(spark, ref, cur, bins=10):
    got = drift.psi(sample(spark, ref), sample(spark, cur), ["g"], bins).collect()
    return got[0].psi if got else None


def test_psi(spark):
    draw = random.Random(7)
    ref = [draw.gauss(35, 6) for _ in range(4000)]
    assert psi(spark, ref, ref) == 0
    redraw, moved, far, wide = ([draw.gauss(m, s) for _ in range(4000)] for m, s in ((35, 6), (36, 6), (41, 6), (35, 12)))
    assert psi(spark, ref, redraw) < 0.02
    assert abs(psi(spark, ref, moved) - 0.038) < 0.02 and abs(psi(spark, ref, far) - 0.90) < 0.1 and abs(psi(spark, ref, wide) - 0.44) < 0.1
    assert psi(spark, [5] * 100, [9] * 100) > 10 and psi(spark, [5] * 100, [5] * 3) == 0
    assert psi(spark, [5], [5]) is None and psi(spark, ref, []) is None
    with pytest.raises(TidemarkError):
        psi(spark, ref, ref, bins=1)


def test_values_are_not_dealt_by_their_few_groups(spark):
    """Edges go to the values, so a group's values meet in no task, whatever the optimizer thinks of the edges' size."""
    rows = spark.range(1000).selectExpr("CAST(id % 3 AS STRING) AS feature", "CAST(id AS DOUBLE) AS value")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = drift.psi(rows, rows, ["feature"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin [feature") == 2
        assert [r.psi for r in out.collect()] == [0.0] * 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bins_close_above(spark):
    """Half of the reference lies on the edge, in the lower bin."""
    got = psi(spark, [1, 2, 2, 3], [2, 2, 2, 2], bins=2)
    low, high = math.log((1 / 1.0) / 0.75) * 0.25, math.log(1e-6 / 0.25) * (1e-6 - 0.25)
    assert abs(got - (low + high)) < 1e-9


def test_features_drift_alone(spark):
    ref = spark.range(500).select(F.col("id").alias("trip_id"), (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 30).cast("double").alias("b"))
    cur = ref.withColumn("a", F.col("a") + 40).drop("b").withColumn("c", F.lit(1.0))
    got = {r.feature: r.psi for r in drift.feature_drift(ref, cur).collect()}
    assert set(got) == {"a"} and got["a"] > 1
    assert drift.missing_features(ref, cur) == ["b"] and drift.missing_features(ref, cur.limit(0)) == []


def test_latency(spark):
    log = spark.createDataFrame([(10.0,)] * 950 + [(2000.0,)] * 50, "ms double")
    got = serving.latency(log).first()
    assert (got.n, got.p50_ms, got.p99_ms, got.max_ms, got.mean_ms) == (1000, 10, 2000, 2000, 109.5)
    assert tuple(serving.latency(log.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_fallbacks(spark):
    rows = spark.createDataFrame([(1, 19, 1.0, 30.0), (2, 19, None, 30.0), (3, 19, 1.0, float("nan")), (4, 19, 1.0, -1.0), (5, 19, 1.0, None), (6, 19, 1.0, float("inf"))], "trip_id long, promised_minutes int, x double, m double").withColumn("a_us", F.lit(0).cast("long"))
    got = {r.trip_id: r for r in serving.predict(rows, F.col("m"), ("x",), "v").collect()}
    assert (got[1].pred_minutes, got[1].fallback, got[1].fallback_reason) == (30, False, "")
    assert all(got[i].pred_minutes == 19 and got[i].fallback for i in range(2, 7))
    assert got[2].fallback_reason.startswith("features") and all(got[i].fallback_reason.startswith("model") for i in range(3, 7))


def test_predictions_of_a_replay(spark):
    rows = spark.createDataFrame([(1, 19, 5, 9, 1.0)], "trip_id long, promised_minutes int, a_us long, as_of_us long, x double")
    assert serving.predict(rows, F.col("x"), ("x",), "v").first().served_us == 9
    assert serving.predict(rows.drop("as_of_us"), F.col("x"), ("x",), "v").first().served_us == 5


def test_payloads(spark):
    good = '{"trip_id": "t", "store_id": "s", "driver_id": "d", "assigned_at": "2026-09-01T09:00:00Z", "distance_m": "1200", "promised_minutes": 19}'
    bodies = [good, good.replace('"1200"', '"far"'), good.replace('"driver_id": "d", ', ""), "{", good.replace("2026-09-01T09", "yesterday")]
    got = from_payloads(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")).orderBy("i").collect()
    assert got[0].error is None and got[0].distance_m == 1200 and str(got[0].assigned_at) == "2026-09-01 09:00:00"
    assert [r.error for r in got[1:]] == ["request field is unreadable: distance_m", "request is missing driver_id", "request is missing trip_id", "request field is unreadable: assigned_at"]
    assert all(r.trip_id is None for r in got[1:])
    assert serving.observe(from_payloads(spark.createDataFrame([(0, good)], "i int, body string"))).refused.first().reason == "no duration yet"


def test_observed_trips(spark, tmp_path):
    trips = spark.createDataFrame([(1, 0, 5 * MINUTE, 5.0), (2, 0, None, 6.0), (3, 0, 7 * MINUTE, None), (4, 0, None, None)], "trip_id long, a_us long, d_us long, tat double").withColumn("tat", F.col("tat").cast("decimal(18,3)"))
    ids = lambda df: sorted(r.trip_id for r in df.collect())
    alone = serving.observe(trips)
    assert (ids(alone.told), ids(alone.unobserved), ids(alone.refused)) == ([], [1, 2], [3, 4])
    store = str(tmp_path / "store")
    for times in (1, 2):
        kept = serving.observe(trips, store)
        assert ids(spark.read.parquet(store)) == [1] * times
    assert (ids(kept.unobserved), {r.trip_id: r.reason for r in kept.refused.collect()}) == ([], {2: "no delivery known", 3: "no duration yet", 4: "no duration yet"})
    assert {r.trip_id: r.delivered_us for r in outcomes_of(trips).collect()} == {1: 5 * MINUTE, 2: 6 * MINUTE}


def test_served_takes_the_last_prediction(spark):
    log = spark.createDataFrame([(1, 30.0, 5), (1, 40.0, 9), (2, 20.0, 1), (2, 21.0, 1)], "trip_id long, pred_minutes double, served_us long")
    outcomes = spark.createDataFrame([(1, 33.0, 60), (7, 1.0, 1)], "trip_id long, actual_minutes double, delivered_us long")
    rows = [sorted(map(tuple, monitoring.served(log.repartition(n), outcomes, 0).collect())) for n in (1, 3)]
    assert rows[0] == rows[1] and len(rows[0]) == 2 and rows[0][0] == (1, 40.0, 9, 33.0, 60)


def test_health(spark):
    """Before anything, before any label, and later: with a feature that drifts and one that is gone."""
    log = outage(spark, 200, 60.0)
    vector = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array((F.col("id") % 50).cast("double"), F.lit(1.0)))
    now = spark.range(200).select((F.col("id") * MINUTE).alias("a_us"), F.map_filter(vector, lambda k, v: k == "a").alias("values"))
    then = spark.range(500).select((F.col("id") * MINUTE).alias("a_us"), F.transform_values(vector, lambda k, v: v + 40).alias("values"))
    early, first, later = monitoring.health(log, log.where(F.col("served_us") < 60 * MINUTE), [-5 * MINUTE, 0, 120 * MINUTE], 60, now, then).orderBy("as_of_us").collect()
    assert math.isnan(early.label_lag_minutes) and early.blind_minutes == math.inf and early.scored_through_us is None
    assert (early.n_served, early.labels_pending, early.realised_n, early.realised_mae, early.feature_psi, early.missing_features) == (200, 200, 0, None, {}, [])
    assert first.feature_psi == {} and first.missing_features == ["b"]
    assert (later.realised_n, later.labels_pending, later.label_lag_minutes, later.blind_minutes, later.fallback_rate) == (86, 114, 35, 35, 0)
    assert set(later.feature_psi) == {"a"} and later.feature_psi["a"] > 1 and later.missing_features == ["b"] and later.prediction_psi is not None
    nothing = monitoring.health(log.limit(0), log, [0]).first()
    assert nothing.n_served == 0 and nothing.fallback_rate == 0 and math.isnan(nothing.label_lag_minutes)


def test_counts_against_each_row(spark):
    draw = random.Random(4)
    rows = [(i, 1.0, draw.randrange(100), draw.random() < 0.2, draw.choice([None, 2.0]), draw.choice([None, draw.randrange(140)])) for i in range(300)]
    at = [70, 10, 0, 139, 70]
    got = {r.as_of_us: r for r in monitoring.counted(spark.createDataFrame(rows, LOG), at).collect()}
    assert set(got) == set(at)
    for t, r in got.items():
        known = [a is not None and x is not None and x <= t for *_, a, x in rows]
        assert r.labels_pending == known.count(False) and r.n == 300
        assert r.pending_served == sum(not k and row[2] <= t for k, row in zip(known, rows, strict=True))
        assert r.scored_through_us == max((row[2] for k, row in zip(known, rows, strict=True) if k), default=None)


def test_the_last_prediction_counts(spark):
    log = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "trip_id long, served_us long, v string")
    assert sorted(r.v for r in latest(log).collect()) == ["b", "c"]
    with pytest.raises(TidemarkError):
        require_unique(log)


def test_edges_from_a_sketch(spark):
    """Shares of the reference in the bins of a sketch are even within its error, and so is the index."""
    made = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.exp(F.randn(7) + F.col("id") % 3).alias("value")).persist()
    now = made.where("value < 3").union(made.where("value > 2"))
    exact = {r.g: r.psi for r in drift.psi(made, now, ["g"]).collect()}
    for size in (200, 2_000):
        off = 2.3 / size**0.9
        got = {r.g: r.psi for r in drift.psi(made, now, ["g"], sketch=size).collect()}
        # A bin's share is off by two edges' errors at most, each bin's term by as much times its slope.
        assert got.keys() == exact.keys() and all(abs(got[g] - exact[g]) < 20 * off for g in got)
        made_of = made.groupBy("g").agg(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("value", size), F.array(*(F.lit(i / 10) for i in range(1, 10)))).alias("e")).collect()
        for row in made_of:
            values = sorted(r.value for r in made.where(F.col("g") == row.g).collect())
            assert all(abs(bisect_left(values, e) / len(values) - i / 10) < 1.5 * off for i, e in enumerate(row.e, 1))
