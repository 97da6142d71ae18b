"""Whole runs: training with its negative controls, and a report of the figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import HOLDOUT
from tidemark.operators.features import FEATURE_NAMES, historical, leaky_in_flight, leaky_lifetime
from tidemark.operators.training import Baseline, Ridge, TrainingRun, chronological, metrics

VARIANTS = {"honest": historical, "leaky_in_flight": leaky_in_flight, "leaky_lifetime": leaky_lifetime}


def train(trips: DataFrame, holdout: float = HOLDOUT) -> TrainingRun:
    """Baseline, honest and leaky models on one chronological split. Features are built over the whole table before it is split.

    Each variant's table is kept and read twice: once for the fit, an aggregation to one row, and once for the scores.
    """
    split = chronological(trips, holdout)
    label, promised = F.col("tat").cast("double").alias("label"), F.col("promised_minutes").cast("double").alias("promised")
    tables = {name: build(split).where("tat is not null").select("trip_id", "assigned_at", "is_train", *FEATURE_NAMES, label, promised).persist() for name, build in VARIANTS.items()}
    models = {name: Ridge.fit(rows.where("is_train")) for name, rows in tables.items()}
    models["baseline"] = Baseline.fit(tables["honest"].where("is_train"))
    held_out = {name: tables.get(name, tables["honest"]).where("not is_train") for name in models}
    scores = [held_out[name].select(F.lit(name).alias("model"), "label", model.predict().alias("prediction")) for name, model in models.items()]
    count = tables["honest"].agg(F.count_if("is_train"), F.count_if(~F.col("is_train"))).first()
    window = split.where("is_train").agg(F.min("assigned_at"), F.max("assigned_at")).first()
    return TrainingRun(models, metrics(reduce(DataFrame.unionByName, scores), ("model",)), tuple(window), *count, tables)


def markdown(rows: DataFrame) -> str:
    """A table of a few rows as Markdown."""
    shown = rows.select(*(F.format_string("%.3f", F.col(c)).alias(c) if t == "double" else F.col(c).cast("string") for c, t in rows.dtypes))
    lines = [rows.columns, ["---"] * len(rows.columns), *([x or "" for x in r] for r in shown.collect())]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def report(run: TrainingRun, outage: DataFrame | None = None, latency: DataFrame | None = None, experiment: DataFrame | None = None) -> str:
    """A Markdown page; its sentences follow from the figures.

    Parts are added for what is given: rows of ``monitoring.outage``, ``serving.latency`` and ``experiment.analyse``.
    """
    gap = run.gaps().first()
    leak = "more than" if gap["in_flight_gap"] > gap["honest_lift"] else "less than"
    page = [
        "# Report",
        f"{run.n_train} training and {run.n_test} held-out trips; trained on {run.training_window[0]} to {run.training_window[1]}.",
        markdown(run.metrics.orderBy("mae")),
        f"The honest model is {gap['honest_lift']:.3f} minutes better than the flat promise. Reading trips in flight would add a "
        f"seeming {gap['in_flight_gap']:.3f} minutes, {leak} that lift; reading whole histories {gap['lifetime_gap']:.3f}.",
    ]
    if outage is not None:
        rows = outage.orderBy("as_of_us").collect()
        apart = [r for r in rows if r["verdict"] == "diverged"]
        seen = f"after {(apart[0]['as_of_us'] - rows[0]['as_of_us']) / 6e7:.0f} minutes of those shown" if apart else "at none of the instants shown"
        page += ["## Outage", markdown(outage.orderBy("as_of_us")), f"Accuracy tells the broken model from the healthy one {seen}."]
    if latency is not None:
        one = latency.first()
        page += ["## Latency", markdown(latency), f"The mean, {one['mean_ms']:.1f} ms, says little of the slowest hundredth, {one['p99_ms']:.1f} ms and more."]
    if experiment is not None:
        page += ["## Experiment", markdown(experiment.select("name", "n_control", "n_treatment", "effect", "mde")), "; ".join(r["verdict"] for r in experiment.select("verdict").collect()) + "."]
    return "\n\n".join(page)


def main() -> None:
    from tidemark.session import session
    from tidemark.sources.trips import load

    print(report(train(load(session("tidemark-train")))))


if __name__ == "__main__":
    main()
