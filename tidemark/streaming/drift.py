"""Population stability over sliding windows of a stream, from counts by bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import bin_of
from tidemark.model import DRIFT_WINDOW_MINUTES, PSI_BINS, TidemarkError
from tidemark.operators.drift import index


def sliding_psi(values: DataFrame, reference: DataFrame, by: tuple[str, ...] = (), minutes: int = DRIFT_WINDOW_MINUTES, every: int = 5, late: str = "10 minutes", least: int = 2, bins: int = PSI_BINS) -> DataFrame:
    """A stream of as_of_us, by, n and psi for each window (as_of - minutes, as_of] that has closed and holds ``least`` values.

    values: a stream of by, value and at_us; nulls don't count, NaN is in the last bin. reference: the static
    ``operators.drift.profile`` of a reference with no more bins than ``bins``; values of groups that it lacks are left
    out. Without by, all values are one group, and the profile's single row becomes part of the plan. Values are counted by bin in panes of ``every`` minutes, and windows are sums of panes: a value is counted
    once however much windows overlap, and state is a row of counts for each group and open pane or window.
    """
    if minutes % every:
        raise TidemarkError(f"windows of {minutes} minutes aren't made of panes of {every}")
    if reference.isStreaming:
        raise TidemarkError("the reference is a static profile")
    # Spark's windows are closed below and open above, so values are put one microsecond earlier to turn that round.
    timed = values.where("value IS NOT NULL").withColumn("at", F.timestamp_micros(F.col("at_us") - 1)).withWatermark("at", late)
    keys = list(by)
    if by:
        with_reference = lambda df, *names: df.join(reference.select(*keys, *names), keys)
    else:
        rows = reference.select("edges", "n_ref", "ref").head(2)
        if len(rows) != 1:
            raise TidemarkError("without groups, the reference has one row, of two values at least")
        literals = {"edges": F.lit(rows[0]["edges"]), "n_ref": F.lit(rows[0]["n_ref"]), "ref": F.map_from_arrays(*(F.lit(list(x)) for x in (rows[0]["ref"].keys(), rows[0]["ref"].values())))}
        with_reference = lambda df, *names: df.withColumns({n: literals[n] for n in names})
    binned = with_reference(timed, "edges").withColumn("bin", bin_of(F.col("edges"), F.col("value")))
    panes = binned.groupBy(F.window("at", f"{every} minutes"), *keys).agg(*(F.count_if(F.col("bin") == i).alias(f"bin_{i}") for i in range(bins)))
    over = F.window(F.window_time("window"), f"{minutes} minutes", f"{every} minutes")
    windows = panes.groupBy(over, *keys).agg(*(F.sum(f"bin_{i}").alias(f"bin_{i}") for i in range(bins)))
    counts = [F.col(f"bin_{i}") for i in range(bins)]
    shaped = windows.select(F.unix_micros(F.col("window.end")).alias("as_of_us"), *keys, sum(counts[1:], counts[0]).alias("n_cur"), F.map_from_arrays(F.array(*map(F.lit, range(bins))), F.array(*counts)).alias("cur"))
    return with_reference(shaped.where(F.col("n_cur") >= least), "edges", "n_ref", "ref").select("as_of_us", *by, F.col("n_cur").alias("n"), index().alias("psi"))
