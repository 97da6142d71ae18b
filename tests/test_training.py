import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.model import TidemarkError
from tidemark.operators import experiment, monitoring, registry, serving, training
from tidemark.plans.runs import report, train
from tidemark.sources.trips import generate


@pytest.fixture(scope="module")
def trips(spark):
    return generate(spark, 2000, seed=21, days=10, drivers=8).persist()


@pytest.fixture(scope="module")
def run(trips):
    return train(trips)


def test_split_is_chronological(trips):
    split = training.chronological(trips)
    early, late = split.where("is_train"), split.where("not is_train")
    assert early.count() == 1600 and late.count() == 400
    key = F.struct("a_us", "trip_id")
    assert early.agg(F.max(key)).first()[0] < late.agg(F.min(key)).first()[0]


def test_split_refuses_empty_sides(trips):
    for holdout in (0.0, 1.0, -1, 1.5):
        with pytest.raises(TidemarkError):
            training.chronological(trips, holdout)
    with pytest.raises(TidemarkError):
        training.chronological(trips.limit(1))


def test_split_among_ties(spark):
    rows = spark.createDataFrame([(i, 5) for i in range(10)], "trip_id long, a_us long")
    assert sorted(r.trip_id for r in training.chronological(rows, 0.3).where("is_train").collect()) == list(range(7))


def test_ridge_recovers_a_line(spark):
    rows = spark.range(400).select((F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    rows = rows.withColumn("label", 3 * F.col("x") - 2 * F.col("z") + 10)
    model = training.Ridge.fit(rows, ("x", "z"), alpha=0.001)
    got = spark.createDataFrame([(10.0, 3.0)], "x double, z double").select(model.predict()).first()[0]
    assert abs(got - 34.0) < 0.1


def test_collinear_features_are_refused_without_penalty(spark):
    rows = spark.range(50).select(F.col("id").cast("double").alias("x"), (2 * F.col("id")).cast("double").alias("y"), F.lit(1.0).alias("label"))
    with pytest.raises(TidemarkError):
        training.Ridge.fit(rows, ("x", "y"), alpha=0.0)


def test_constant_features_have_unit_scale(spark):
    rows = spark.range(50).select(F.lit(4.0).alias("x"), F.col("id").cast("double").alias("label"))
    got = training.normal_equations(rows, ("x",))
    assert (got.scales[0], got.means[0], got.gram[0, 0], got.n) == (1.0, 4.0, 1.0, 50)


def test_features_far_from_zero(spark):
    """Where sums about zero would lose all digits, and where a feature that isn't a binary fraction doesn't vary."""
    rows = spark.range(400).select((F.lit(1.7e9) + F.col("id") % 40).alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.lit(0.1).alias("same"))
    rows = rows.withColumn("label", 3 * (F.col("x") - 1.7e9) - 2 * F.col("z") + 10)
    model = training.Ridge.fit(rows, ("x", "z", "same"), alpha=0.001)
    assert abs(model.scales[0] - np.std(np.arange(400) % 40)) < 1e-6 and model.scales[2] == 1.0 and abs(model.means[2] - 0.1) < 1e-12 and model.weights[2] == 0
    got = spark.createDataFrame([(1.7e9 + 10, 3.0, 0.1)], "x double, z double, same double").select(model.predict()).first()[0]
    assert abs(got - 34.0) < 0.1


def test_normal_equations_against_numpy(spark):
    draw = np.random.default_rng(3)
    x, y = draw.standard_normal((300, 3)) * [1, 50, 0.2] + [5, -100, 3], draw.standard_normal(300) + 30
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, label double")
    z = (x - x.mean(0)) / x.std(0)
    for about in (None, (5.0, -100.0, 3.0)):
        got = training.normal_equations(rows, ("a", "b", "c"), 2.0, about)
        assert np.allclose(got.gram, z.T @ z + 2.0 * np.eye(3), atol=1e-7) and np.allclose(got.right, z.T @ (y - y.mean()), atol=1e-7)
        assert np.allclose(got.means, x.mean(0)) and np.allclose(got.scales, x.std(0)) and abs(got.mean_label - y.mean()) < 1e-9


def test_predictions_have_a_floor(spark):
    model = training.Ridge(("x",), (-100.0,), 0.0, (0.0,), (1.0,))
    assert spark.createDataFrame([(5.0,)], "x double").select(model.predict()).first()[0] == 1.0


def test_metrics(spark):
    rows = spark.createDataFrame([(float(i), 10.0) for i in range(1, 11)], "label double, prediction double")
    got, monitor = training.metrics(rows).first(), training.metrics(rows, median="nearest").first()
    assert got.n == 10 and got.mae == 4.5 and got.p50_error == 4.5 and got.p90_error == 8 and got.breach_rate == 0
    assert monitor.p50_error == 4


def test_ridge_beats_the_promise_and_the_leak_flatters(run):
    mae = {r.model: r.mae for r in run.metrics.collect()}
    assert mae["honest"] < mae["baseline"]
    assert mae["leaky_in_flight"] < 0.98 * mae["honest"]
    gap = run.gaps().first()
    assert abs(gap.honest_lift - (mae["baseline"] - mae["honest"])) < 1e-9
    assert "| honest |" in report(run) and "held-out" in report(run)


def test_report_parts(run, spark):
    minute = 60_000_000
    log = lambda wrong: spark.createDataFrame([(i, wrong if i >= 60 else 35.5, i * minute, False, 35.0, (i + 35) * minute) for i in range(200)], "trip_id long, pred_minutes double, served_us long, fallback boolean, actual_minutes double, label_us long")
    outage = monitoring.outage(log(35.5), log(70.0), [m * minute for m in (80, 100, 120)])
    latency = serving.latency(spark.createDataFrame([(10.0,)] * 95 + [(2000.0,)] * 5, "ms double"))
    outcomes = spark.range(400).select(F.concat(F.lit("d"), "id").alias("entity_id"), (F.col("id") % 9).cast("double").alias("error"), F.lit(False).alias("fallback"))
    page = report(run, outage, latency, experiment.analyse(outcomes, "eta"))
    assert "after 20 minutes" in page and "2000.0 ms" in page and "an effect of" in page
    assert page.count("## ") == 3


def test_unlabelled_sides_are_refused(spark):
    none = spark.createDataFrame([], "promised double, x double, label double")
    with pytest.raises(TidemarkError):
        training.Baseline.fit(none)
    with pytest.raises(TidemarkError):
        training.Ridge.fit(none, ("x",))


def test_a_fit_reads_its_rows_once(spark):
    plan = training.products(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, z double, label double"), ("x", "z"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_registry(run, tmp_path, spark):
    root, model, window = str(tmp_path / "models"), run.models["honest"], run.training_window
    with pytest.raises(TidemarkError):
        registry.latest(spark, root)
    version = registry.save(spark, model, {"mae": 1.0}, window, root)
    assert len(version) == 12 and registry.save(spark, model, {"mae": 2.0}, window, root) == version
    assert registry.read_card(spark, version, root)["metrics"] == {"mae": 1.0}
    assert registry.load(spark, version, root) == model
    second = registry.save(spark, run.models["baseline"], {}, window, root)
    assert registry.versions(spark, root) == [version, second] and registry.latest(spark, root) == second
    assert registry.load(spark, second, root) == run.models["baseline"]
    path = tmp_path / "models" / version / registry.CARD
    card = json.loads(path.read_text())
    path.with_name(f".{registry.CARD}.crc").unlink(missing_ok=True)
    path.write_text(json.dumps(card | {"payload": card["payload"].replace("ridge", "other")}))
    with pytest.raises(TidemarkError):
        registry.save(spark, model, {}, window, root)
    with pytest.raises(TidemarkError):
        registry.load(spark, "nothing", root)
    with pytest.raises(TidemarkError):
        training.from_payload({"kind": "forest"})


def test_versions_tell_models_and_windows_apart(spark, tmp_path):
    start, root = datetime(2026, 9, 1), str(tmp_path)
    september, october = (start, start + timedelta(days=7)), (start + timedelta(days=30), start + timedelta(days=37))
    of = lambda minutes, window: registry.version_of(training.Baseline(minutes).payload(), window)
    assert of(19.0, september) == of(19.0, september) and of(19.0, september) != of(21.0, september)
    assert of(19.0, september) != of(19.0, october)
    saved = [registry.save(spark, training.Baseline(19.0), {}, w, root) for w in (september, october)]
    assert registry.versions(spark, root) == saved and len(set(saved)) == 2
