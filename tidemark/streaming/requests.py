"""Requests scored as they come: bodies to trips, features from the store, a prediction for each, and a log without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.features import CATALOGUE, FEATURE_NAMES
from tidemark.operators.history import TripStore
from tidemark.operators.serving import predict
from tidemark.sources.trips import from_payloads


def score_requests(
    bodies: DataFrame, store: TripStore, minutes: Column, version: str, log: str, dead: str, checkpoint: str, names: tuple[str, ...] = FEATURE_NAMES, features: tuple = CATALOGUE, variant: str = "control"
) -> StreamingQuery:
    """Starts a stream that scores JSON bodies (column ``body``) and ends when it has read what is there.

    Predictions go to the log, bodies that can't be used to the dead letters, with the reason. Both are written into
    a folder for each batch, which is replaced if the batch runs again after a failure: nothing is served twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        parsed = from_payloads(rows).persist()
        try:
            good = parsed.where("error IS NULL").drop("error", "body")
            served = predict(store.ask(good, features), minutes, names, version, variant)
            served.write.mode("overwrite").parquet(f"{log}/batch={number}")
            parsed.where("error IS NOT NULL").select("body", "error").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            parsed.unpersist()

    return bodies.select("body").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observe_stream(trips: DataFrame, store: TripStore, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts a stream that tells the store of finished trips, a batch at a time; a batch that runs again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        store.tell(rows, f"stream-{number}")
        if then:
            then(number)

    return trips.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

