"""Chronological split, baseline and ridge models, and their scores."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import HOLDOUT, MINIMUM_MINUTES, PIVOT_TOLERANCE, RIDGE_ALPHA, TidemarkError
from tidemark.operators.features import FEATURE_NAMES
from tidemark.operators.selection import percentiles, with_percentiles


#: Deviation of a feature, as a share of its mean, from which on sums about zero keep ten digits or so.
SPREAD = 1e-3
#: Ranges of time that one round of the search for the boundary counts.
SPLIT_RANGES = 20_000


def split_key(trips: DataFrame, holdout: float = HOLDOUT) -> tuple[int, object]:
    """Instant and id of the last training trip in the order of (assigned, id).

    The instant comes from counts by instant, added up over ranges; only the trips of that one instant are then
    looked at by id. No global row number and so no single task for all rows.
    """
    if not 0.0 < holdout < 1.0:
        raise TidemarkError("the holdout is a share between 0 and 1")
    n, low, high = trips.agg(F.count(F.lit(1)), F.min("a_us"), F.max("a_us")).first()
    cut, before = int(n * (1.0 - holdout)), 0
    if cut == 0 or cut == n:
        raise TidemarkError("one side of the split would be empty")
    while low < high:  # a round looks at a 20,000th of the range that is left: two or three do
        width = -(-(high - low + 1) // SPLIT_RANGES)
        part = trips.where(F.col("a_us").between(low, high)).groupBy(F.floor((F.col("a_us") - low) / width).alias("i")).count().orderBy("i").collect()
        for row in part:
            if before + row["count"] >= cut:
                low, high = low + row["i"] * width, min(high, low + (row["i"] + 1) * width - 1)
                break
            before += row["count"]
    last = trips.where(F.col("a_us") == low).select("trip_id").orderBy("trip_id").limit(cut - before).agg(F.max("trip_id")).first()[0]
    return low, last


def chronological(trips: DataFrame, holdout: float = HOLDOUT) -> DataFrame:
    """trips with is_train: the first share of them in time."""
    at, last = split_key(trips, holdout)
    return trips.withColumn("is_train", (F.col("a_us") < at) | ((F.col("a_us") == at) & (F.col("trip_id") <= F.lit(last))))


def dataset(featured: DataFrame, trips: DataFrame) -> DataFrame:
    """Labelled trips with their features: vectors joined to labels by trip."""
    labels = trips.where(F.col("tat").isNotNull()).select("trip_id", F.col("tat").cast("double").alias("label"), F.col("promised_minutes").cast("double").alias("promised"))
    return featured.select("trip_id", *FEATURE_NAMES).join(labels, "trip_id")


@dataclass(frozen=True)
class Baseline:
    """The median promise, for every trip."""

    flat_minutes: float
    feature_names: tuple[str, ...] = ()
    kind = "baseline"

    @classmethod
    def fit(cls, train: DataFrame) -> Baseline:
        found = percentiles(train, (), "promised", {"middle": ("linear", 0.5)}).first()
        middle = found["middle"] if found else None
        if middle is None:
            raise TidemarkError("there are no labelled rows")
        return cls(middle)

    def predict(self) -> Column:
        return F.lit(self.flat_minutes)

    def payload(self) -> dict:
        return {"kind": self.kind, "flat_minutes": self.flat_minutes}


@dataclass(frozen=True)
class Ridge:
    """Linear in standardised features; the intercept isn't penalised."""

    feature_names: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    means: tuple[float, ...]
    scales: tuple[float, ...]
    alpha: float = RIDGE_ALPHA
    kind = "ridge"

    @classmethod
    def fit(cls, train: DataFrame, names: tuple[str, ...] = FEATURE_NAMES, alpha: float = RIDGE_ALPHA) -> Ridge:
        """One aggregation over the rows; the small system is solved here."""
        names = tuple(names)
        eq = normal_equations(train, names, alpha)
        return cls(names, tuple(solve(eq.gram, eq.right)), eq.mean_label, tuple(eq.means.tolist()), tuple(eq.scales.tolist()), alpha)

    def predict(self) -> Column:
        """One expression, inside code generation; never below the least time."""
        total = F.lit(self.intercept)
        for name, w, m, s in zip(self.feature_names, self.weights, self.means, self.scales, strict=True):
            total = total + F.lit(w) * ((F.col(name) - F.lit(m)) / F.lit(s))
        return F.when(F.isnan(total), total).otherwise(F.greatest(F.lit(MINIMUM_MINUTES), total))

    def payload(self) -> dict:
        return {"kind": self.kind, "feature_names": list(self.feature_names), "weights": list(self.weights), "intercept": self.intercept, "means": list(self.means), "scales": list(self.scales), "alpha": self.alpha}


def from_payload(payload: dict) -> Baseline | Ridge:
    if payload.get("kind") == Baseline.kind:
        return Baseline(payload["flat_minutes"])
    if payload.get("kind") == Ridge.kind:
        return Ridge(*(tuple(payload[f]) if isinstance(payload[f], list) else payload[f] for f in ("feature_names", "weights", "intercept", "means", "scales", "alpha")))
    raise TidemarkError(f"a model of kind {payload.get('kind')!r} is unknown")


def products(train: DataFrame, names: tuple[str, ...], about: tuple[float, ...] | None = None) -> DataFrame:
    """The sums that a fit needs, from one aggregation to one row: of the label, of each feature, of their products.

    Sums of products cost a sixth of covariances. ``about`` gives the features' centres where values lie so far from
    zero that such sums lose digits.
    """
    k = range(len(names))
    x = [F.col(c).cast("double") - F.lit(float(about[i])) if about else F.col(c).cast("double") for i, c in enumerate(names)]
    y = F.col("label").cast("double")
    sums = [f(x[i]).alias(f"{name}_{i}") for i in k for name, f in (("x", F.sum), ("lo", F.min), ("hi", F.max))]
    sums += [F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i in k for j in k if i <= j] + [F.sum(x[i] * y).alias(f"l_{i}") for i in k]
    return train.agg(F.count("label").alias("n"), F.sum(y).alias("y"), *sums)


class Equations(NamedTuple):
    """The normal equations of standardised features against the centred label, and what standardises them."""

    n: int
    mean_label: float
    means: np.ndarray
    scales: np.ndarray
    gram: np.ndarray
    right: np.ndarray


def normal_equations(train: DataFrame, names: tuple[str, ...], alpha: float = RIDGE_ALPHA, about: tuple[float, ...] | None = None) -> Equations:
    """From ``products``: one pass over the rows, or a second one about the means if a feature varies little around a large one.

    Deviations are those of the population, and 1 where a feature doesn't vary.
    """
    row, k = products(train, names, about).first(), range(len(names))
    n = row["n"]
    if not n:
        raise TidemarkError("there are no labelled rows")
    x, left = np.array([row[f"x_{i}"] for i in k]), np.array([row[f"l_{i}"] for i in k])
    square = np.array([[row[f"q_{min(i, j)}_{max(i, j)}"] for j in k] for i in k])
    fixed = np.array([row[f"lo_{i}"] == row[f"hi_{i}"] for i in k])
    centred, right = square - np.outer(x, x) / n, left - x * row["y"] / n
    centred[fixed], centred[:, fixed], right[fixed] = 0.0, 0.0, 0.0
    means, scales = x / n + np.array(about or 0.0), np.sqrt(np.maximum(np.diag(centred), 0) / n)
    if about is None and (scales[~fixed] <= SPREAD * np.abs(means[~fixed])).any():
        return normal_equations(train, names, alpha, tuple(means.tolist()))
    scales = np.where(scales > 0, scales, 1.0)
    return Equations(n, row["y"] / n, means, scales, centred / np.outer(scales, scales) + alpha * np.eye(len(names)), right / scales)


def solve(a: np.ndarray, b: np.ndarray) -> list[float]:
    """A small linear system. One whose smallest singular value is next to nothing is refused."""
    if np.linalg.svd(a, compute_uv=False).min() < PIVOT_TOLERANCE * max(1.0, np.abs(a).max()):
        raise TidemarkError("the system is singular: a feature is a combination of others")
    return np.linalg.solve(a, b).tolist()


def metrics(rows: DataFrame, by: tuple[str, ...] = (), median: str = "interpolated") -> DataFrame:
    """n, mae, rmse, p50_error, p90_error and breach_rate of prediction against label.

    Training reports take the interpolated median, monitoring the nearest rank; p90 is by nearest rank in both.
    A trip breaches if it took longer than predicted.
    """
    rows = rows.where("label is not null and prediction is not null").withColumn("err", F.abs(F.col("prediction") - F.col("label")))
    scores = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("err").alias("mae"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.avg((F.col("label") > F.col("prediction")).cast("double")).alias("breach_rate"),
    )
    wanted = {"p50_error": ("linear" if median == "interpolated" else "nearest", 0.5), "p90_error": ("nearest", 0.9)}
    return with_percentiles(scores, rows, by, "err", wanted).select(*by, "n", "mae", "rmse", "p50_error", "p90_error", "breach_rate")


@dataclass
class TrainingRun:
    """Models by name, their metrics on the held-out trips, and what they were trained on."""

    models: dict[str, Baseline | Ridge]
    metrics: DataFrame
    training_window: tuple
    n_train: int
    n_test: int
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def gaps(self) -> DataFrame:
        return gaps(self.metrics)


def gaps(scores: DataFrame) -> DataFrame:
    """Honest lift over the flat promise, and how much better each leak looks than it is."""
    mae = lambda name: F.max(F.when(F.col("model") == name, F.col("mae")))
    return scores.agg((mae("baseline") - mae("honest")).alias("honest_lift"), (mae("honest") - mae("leaky_in_flight")).alias("in_flight_gap"), (mae("honest") - mae("leaky_lifetime")).alias("lifetime_gap"))
