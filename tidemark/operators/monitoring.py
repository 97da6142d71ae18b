"""Monitoring under late labels: what was known at an instant, and what wasn't yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import minutes_between, within
from tidemark.model import DRIFT_WINDOW_MINUTES, MINUTE_US
from tidemark.operators.drift import psi
from tidemark.operators.selection import percentiles, with_percentiles
from tidemark.sources.trips import latest


NAN, INF = float("nan"), float("inf")


def served(predictions: DataFrame, outcomes: DataFrame, label_delay_minutes: float = 10.0) -> DataFrame:
    """The prediction log, a row for each trip (its last prediction), with the outcome where there is one.

    A label arrives so many minutes after delivery. Outcomes of trips that were never predicted are left out.
    """
    late = outcomes.select("trip_id", "actual_minutes", (F.col("delivered_us") + int(label_delay_minutes * MINUTE_US)).alias("label_us"))
    return latest(predictions).join(late, "trip_id", "left")


def grid(instants: list[int]) -> Column:
    return F.array(*(F.lit(i).cast("long") for i in instants))


def _rows(log: DataFrame, instants: list[int]) -> DataFrame:
    return log.sparkSession.createDataFrame([(i,) for i in instants], "as_of_us long")


def known_at(log: DataFrame, instants: list[int]) -> DataFrame:
    """The rows whose label had arrived, once for each instant by which it had: no others are made."""
    labelled = log.where(F.col("actual_minutes").isNotNull() & (F.col("label_us") <= max(instants)))
    return labelled.withColumn("as_of_us", F.explode(F.filter(grid(instants), lambda i: i >= F.col("label_us"))))


def in_window(log: DataFrame, instants: list[int], minutes: float = DRIFT_WINDOW_MINUTES, moment: str = "served_us") -> DataFrame:
    """The rows of each instant's window. What is in none of them goes before anything is copied."""
    at, width = F.col(moment), int(minutes * MINUTE_US)
    near = log.where((at > min(instants) - width) & (at <= max(instants)))
    return near.withColumn("as_of_us", F.explode(F.filter(grid(instants), lambda i: within(at, i, minutes))))


def counted(log: DataFrame, instants: list[int]) -> DataFrame:
    """For each instant: n, labels_pending, pending_served (of predictions made by then) and scored_through_us.

    Rows are mapped to the first instant by which they are served and labelled and counted by these two numbers,
    in one pass that combines before the shuffle; the small table of counts is then looked at from each instant.
    """
    times = sorted(set(instants))
    first = lambda at: F.size(F.filter(grid(times), lambda i: i < at))
    label = F.when(F.col("actual_minutes").isNotNull() & F.col("label_us").isNotNull(), first(F.col("label_us"))).otherwise(len(times))
    flag = F.coalesce(F.col("fallback").cast("long"), F.lit(0)) if "fallback" in log.columns else F.lit(0)
    by_first = log.groupBy(first(F.col("served_us")).alias("made"), label.alias("known")).agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("fallbacks"), F.max("served_us").alias("last"))
    seen = by_first.select("*", F.posexplode(grid(times)).alias("j", "as_of_us"))
    pending = F.col("known") > F.col("j")
    total = lambda c, x="n": F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    out = seen.groupBy("as_of_us").agg(
        F.sum("n").alias("n"),
        F.sum("fallbacks").alias("fallbacks"),
        total(pending).alias("labels_pending"),
        total(pending & (F.col("made") <= F.col("j"))).alias("pending_served"),
        F.max(F.when(~pending, F.col("last"))).alias("scored_through_us"),
    )
    return _rows(log, times).join(out, "as_of_us", "left").fillna(0, ["n", "fallbacks", "labels_pending", "pending_served"])


#: Percentiles of errors, and of the minutes from serving to label.
ERRORS = {"p50_error": ("nearest", 0.5), "p90_error": ("nearest", 0.9)}
LAG = {"label_lag_minutes": ("linear", 0.5)}


def accuracy(known: DataFrame) -> DataFrame:
    """n, mae, rmse, p50_error, p90_error and breach_rate for each instant of rows whose label had arrived."""
    rows = known.withColumn("err", F.abs(F.col("pred_minutes") - F.col("actual_minutes")))
    sums = rows.groupBy("as_of_us").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("err").alias("mae"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.avg((F.col("actual_minutes") > F.col("pred_minutes")).cast("double")).alias("breach_rate"),
    )
    return with_percentiles(sums, rows, ("as_of_us",), "err", ERRORS).select("as_of_us", "n", "mae", "rmse", "p50_error", "p90_error", "breach_rate")


def lags(known: DataFrame) -> DataFrame:
    """Median minutes from serving to label for each instant."""
    return percentiles(known.withColumn("lag", minutes_between(F.col("label_us"), F.col("served_us"))), ("as_of_us",), "lag", LAG)


def realised(log: DataFrame, instants: list[int]) -> DataFrame:
    """Accuracy at each instant over the predictions with a label by then; no row where there is none."""
    return accuracy(known_at(log, instants))


def pending(log: DataFrame, instants: list[int], served_only: bool = False) -> DataFrame:
    """Predictions without a label at each instant. served_only leaves out those that hadn't been made yet."""
    return counted(log, instants).select("as_of_us", F.col("pending_served" if served_only else "labels_pending").alias("labels_pending"))


def label_lag(log: DataFrame, instants: list[int]) -> DataFrame:
    """Median minutes from serving to label, of labels that have arrived; NaN if none has."""
    return _rows(log, instants).join(lags(known_at(log, instants)), "as_of_us", "left").select("as_of_us", F.coalesce("label_lag_minutes", F.lit(NAN)).alias("label_lag_minutes"))


def _blind() -> Column:
    return F.coalesce(minutes_between(F.col("as_of_us"), F.col("scored_through_us")), F.lit(INF)).alias("blind_minutes")


def blind(log: DataFrame, instants: list[int]) -> DataFrame:
    """The latest prediction that has a label, and the minutes since then; infinite if there is none."""
    return counted(log, instants).select("as_of_us", "scored_through_us", _blind())


def _enough(recent: DataFrame) -> DataFrame:
    """The rows of instants whose windows hold two at least."""
    many = recent.groupBy("as_of_us").agg(F.count(F.lit(1)).alias("n_now")).where("n_now >= 2").select("as_of_us")
    return recent.join(many, "as_of_us", "left_semi")


def prediction_drift(log: DataFrame, reference: DataFrame, instants: list[int], minutes: float = DRIFT_WINDOW_MINUTES) -> DataFrame:
    """psi of the predictions in each instant's window against reference predictions; two are needed in the window."""
    value = [F.lit("pred_minutes").alias("of"), F.col("pred_minutes").alias("value")]
    recent = _enough(in_window(log, instants, minutes)).select("as_of_us", *value)
    return psi(reference.select(*value), recent, ["of"], over=("as_of_us",)).drop("of")


def feature_drift(vectors: DataFrame, reference: DataFrame, instants: list[int], minutes: float = DRIFT_WINDOW_MINUTES) -> DataFrame:
    """psi of each feature in each instant's window against reference vectors; two vectors are needed in the window.

    Vectors have a_us and a map ``values``. Features that one side lacks have no row; see ``missing_at``.
    """
    each = F.explode("values").alias("feature", "value")
    return psi(reference.select(each), _enough(in_window(vectors, instants, minutes, "a_us")).select("as_of_us", each), ["feature"], over=("as_of_us",))


def missing_at(vectors: DataFrame, reference: DataFrame, instants: list[int], minutes: float = DRIFT_WINDOW_MINUTES) -> DataFrame:
    """as_of_us and the sorted names of features that the reference has and the window lacks; a row for each window with a vector."""
    names = reference.select(F.explode(F.map_keys("values")).alias("feature")).agg(F.sort_array(F.collect_set("feature"))).first()[0]  # a catalogue's names
    seen = in_window(vectors, instants, minutes, "a_us").select("as_of_us", F.explode(F.map_keys("values")).alias("feature"))
    wanted = F.array(*map(F.lit, names)).cast("array<string>")
    return seen.groupBy("as_of_us").agg(F.array_except(wanted, F.collect_set("feature")).alias("missing_features"))


def health(log: DataFrame, reference: DataFrame, instants: list[int], minutes: float = DRIFT_WINDOW_MINUTES, vectors: DataFrame | None = None, reference_vectors: DataFrame | None = None) -> DataFrame:
    """A row for each instant with everything above: NaN where no label has arrived, infinite blindness, null figures of no rows.

    With vectors there are feature_psi, a map, and missing_features; both are empty where the window is.
    """
    made = counted(log, instants)
    rate = F.when(F.col("n") > 0, F.col("fallbacks") / F.col("n")).otherwise(0.0)
    out = made.select("as_of_us", F.col("n").alias("n_served"), rate.alias("fallback_rate"), "labels_pending", "scored_through_us", _blind())
    arrived = known_at(log, instants)
    figures = accuracy(arrived)
    known = figures.select("as_of_us", *(F.col(c).alias(f"realised_{c}") for c in figures.columns[1:])).join(lags(arrived), "as_of_us", "left")
    drift = prediction_drift(log, reference, instants, minutes).withColumnRenamed("psi", "prediction_psi")
    out = out.join(known, "as_of_us", "left").join(drift, "as_of_us", "left")
    out = out.withColumns({"realised_n": F.coalesce("realised_n", F.lit(0)), "label_lag_minutes": F.coalesce("label_lag_minutes", F.lit(NAN))})
    if vectors is None:
        return out
    base = vectors if reference_vectors is None else reference_vectors
    each = feature_drift(vectors, base, instants, minutes).groupBy("as_of_us").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "psi")))).alias("feature_psi"))
    out = out.join(each, "as_of_us", "left").join(missing_at(vectors, base, instants, minutes), "as_of_us", "left")
    none = F.create_map().cast("map<string,double>")
    return out.withColumns({"feature_psi": F.coalesce("feature_psi", none), "missing_features": F.coalesce("missing_features", F.array().cast("array<string>"))})


def outage(healthy: DataFrame, broken: DataFrame, instants: list[int]) -> DataFrame:
    """Both logs' accuracy side by side at each instant, and whether they can be told apart yet."""
    a = realised(healthy, instants).select("as_of_us", F.col("n").alias("scored"), F.col("mae").alias("mae_healthy"))
    b = realised(broken, instants).select("as_of_us", F.col("mae").alias("mae_broken"))
    wait = pending(broken, instants)
    same = F.abs(F.col("mae_healthy") - F.col("mae_broken")) < 1e-9
    return a.join(b, "as_of_us").join(wait, "as_of_us").withColumn("verdict", F.when(same, "identical").otherwise("diverged"))
