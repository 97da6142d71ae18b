"""The online side of the features as streams: keyed state over event time, late labels, sliding health.

A trip enters twice: as a probe at its assignment, and as history at its delivery. State is kept for groups of entities, in
maps of which a trigger touches what is new or due; a probe is answered once the watermark has passed its instant, so that history which arrives late, but within the
allowed delay, is in. Answers depend on event times alone, never on the order in which rows come, and equal the batch ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.medians import stretch_medians
from tidemark.functions.scalar import implied_pack
from tidemark.model import MINUTE_US, RETAIN_MINUTES, TidemarkError
from tidemark.operators.features import Trailing, entity_column

#: The state store that the stream of features needs; set it before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Buckets of time that the widest window is cut into.
WINDOW_BUCKETS = 2
#: Rows of a trigger that are gathered before they are written to the state, and keys of the state that entities share.
GATHERED, STATE_KEYS = 200_000, 256


def time_line(trips: DataFrame, entity: str) -> DataFrame:
    """Probes and history of a stream of trips on one line: key, at, t, trip_id, parts (of a minute), pack (history has no trip_id)."""
    none = lambda kind: F.lit(None).cast(kind)
    probe = F.struct(F.col("a_us").alias("t"), F.col("trip_id").cast("string").alias("trip_id"), none("long").alias("parts"), none("double").alias("pack"))
    known = F.col("tat").isNotNull()
    history = F.struct(F.when(known, F.col("d_us")).alias("t"), none("string").alias("trip_id"), (F.col("tat") * parts_of_a_minute(trips)).cast("long").alias("parts"), implied_pack(F.col("tat"), F.col("distance_m")).alias("pack"))
    line = trips.select(F.col(entity_column(entity)).cast("string").alias("key"), F.explode(F.array(probe, history)).alias("e")).select("key", "e.*")
    return line.where("t is not null").withColumn("at", F.timestamp_micros("t"))


def parts_of_a_minute(trips: DataFrame) -> int:
    """The unit that times are whole multiples of: 1,000 for decimals of three places."""
    return 10 ** trips.schema["tat"].dataType.scale


def unfinished(trips: DataFrame) -> DataFrame:
    """A stream of the trips that can't become history, with the reason: for a dead-letter table, beside the features' stream.

    They are probes all the same. A row that comes again, finished, counts then.
    """
    reason = F.when(F.col("tat").isNull(), "no duration yet").when(F.col("d_us").isNull(), "no delivery known")
    return trips.withColumn("reason", reason).where("reason is not null")


class Store(StatefulProcessor):
    """The finished trips of some entities and the probes that wait for the watermark, as maps from buckets of time in the state.

    Rows are gathered up to ``GATHERED`` and written as a new part of their bucket: none is read for it. An answer
    reads the buckets of its windows, those of one bucket of probes at a time; of the others only the numbers are
    read. A key of the state has one timer, at the first instant at which a probe is due or a bucket's retention is over.
    """

    def __init__(self, features: tuple[Trailing, ...], unit: int, retain_minutes: int):
        self.features, self.unit, self.retain_ms = features, unit, retain_minutes * 60_000
        self.bucket_ms = max(1, max(f.window_minutes for f in features) // WINDOW_BUCKETS) * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getMapState("history", "bucket long, part int", "key array<string>, t array<long>, parts array<long>, pack array<double>")
        self.waiting = handle.getMapState("waiting", "bucket long, part int", "key array<string>, t array<long>, trip_id array<string>")
        self.buckets = handle.getValueState("buckets", "timer long, waiting array<long>, waiting_parts array<int>, history array<long>, history_parts array<int>")

    def known(self) -> tuple[int | None, dict[int, int], dict[int, int]]:
        """The timer, and the number of parts of each bucket."""
        timer, *held = self.buckets.get() if self.buckets.exists() else (None, [], [], [], [])
        return timer, dict(zip(*held[:2], strict=True)), dict(zip(*held[2:], strict=True))

    def expiry(self, bucket: int) -> int:
        return (bucket + 1) * self.bucket_ms + self.retain_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timer, waiting, history = self.known()
        due, held = [] if timer is None else [timer], []
        for part in rows:
            held.append(part)
            if sum(map(len, held)) >= GATHERED:
                due.append(self.put(pd.concat(held), waiting, history))
                held = []
        if held:
            due.append(self.put(pd.concat(held), waiting, history))
        self.set(timer, min(due), waiting, history)
        yield self.table([], [], [], [])

    def put(self, rows: pd.DataFrame, waiting: dict[int, int], history: dict[int, int]) -> int:
        """Writes rows to their buckets; the first instant at which one of them is due."""
        t, probe = rows.t.to_numpy(np.int64), rows.trip_id.notna().to_numpy()
        bucket = t // 1000 // self.bucket_ms
        order = np.lexsort((t, bucket, probe))
        t, probe, bucket = t[order], probe[order], bucket[order]
        key, ids = rows.key.to_numpy()[order], rows.trip_id.to_numpy()[order]
        parts, pack = rows.parts.to_numpy(float, na_value=0)[order].astype(np.int64), rows.pack.to_numpy(float, na_value=np.nan)[order]
        starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (probe[1:] != probe[:-1])]))
        due = []
        for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
            number, own = int(bucket[a]), slice(a, b)
            state, counts, values = (self.waiting, waiting, (ids,)) if probe[a] else (self.history, history, (parts, pack))
            state.updateValue((number, counts.get(number, 0)), tuple(v[own].tolist() for v in (key, t, *values)))
            counts[number] = counts.get(number, 0) + 1
            due.append(int(t[a]) // 1000 if probe[a] else self.expiry(number))
        return min(due)

    def set(self, before: int | None, timer: int, waiting: dict[int, int], history: dict[int, int]) -> None:
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        self.remember(timer, waiting, history)

    def remember(self, timer: int, waiting: dict[int, int], history: dict[int, int]) -> None:
        self.buckets.update((timer, list(waiting), list(waiting.values()), list(history), list(history.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        _, waiting, history = self.known()
        later, widest = [], max(f.window_minutes for f in self.features) * MINUTE_US
        near: dict[int, tuple] = {}
        for bucket in sorted(b for b in waiting if b * self.bucket_ms < passed):
            keys, at, ids = map(np.array, self.read(self.waiting, bucket, waiting.pop(bucket)))
            ready = at < passed * 1000
            first = (int(at.min()) - widest) // 1000 // self.bucket_ms
            near = {b: near.get(b) or self.read(self.history, b, history[b]) for b in history if first <= b <= bucket}
            yield self.table(keys[ready], at[ready], ids[ready], list(near.values()))
            if not ready.all():
                self.waiting.updateValue((bucket, 0), (keys[~ready].tolist(), at[~ready].tolist(), ids[~ready].tolist()))
                waiting[bucket] = 1
                later.append(int(at[~ready].min()) // 1000)
        for bucket in [b for b in history if self.expiry(b) < passed]:
            self.remove(self.history, bucket, 0, history.pop(bucket))
        later += [b * self.bucket_ms for b in waiting if b * self.bucket_ms >= passed] + [self.expiry(b) for b in history]
        if later:
            self.handle.registerTimer(min(later))
            self.remember(min(later), waiting, history)
        else:
            self.buckets.clear()
        yield self.table([], [], [], [])

    def read(self, state, bucket: int, parts: int) -> tuple[list, ...]:
        """All parts of a bucket; probes that are read go, and come back if they have to wait."""
        held = [state.getValue((bucket, i)) for i in range(parts)]
        if state is self.waiting:
            self.remove(state, bucket, 0, parts)
        return tuple([x for part in column for x in part] for column in zip(*held, strict=True))

    @staticmethod
    def remove(state, bucket: int, first: int, parts: int) -> None:
        for i in range(first, parts):
            state.removeKey((bucket, i))

    def table(self, keys, at, ids, held: list[tuple]) -> pd.DataFrame:
        """The answers of probes, from buckets of history."""
        at = np.array(at, np.int64)
        out = {"trip_id": pd.Series(ids, dtype=object), "t": at} | {f.name: np.full(len(at), 0.0 if f.kind == "count" else np.nan) for f in self.features}
        known = np.array([x for h in held for x in h[0]], object)
        if len(at) and len(known):
            t, parts, pack = (np.array([x for h in held for x in h[i]], kind) for i, kind in ((1, np.int64), (2, np.int64), (3, float)))
            code, names = pd.factorize(np.concatenate([known, np.asarray(keys, object)]), use_na_sentinel=False)
            own, asked = code[: len(known)], code[len(known) :]
            # Entities one after the other on one line of time, so far apart that no window reaches from one to the next.
            start = min(t.min(), at.min()) - max(f.window_minutes for f in self.features) * MINUTE_US
            span = max(t.max(), at.max()) - start + 1
            place, probe = own * span + (t - start), asked * span + (at - start)
            order = np.argsort(place, kind="stable")
            place, pack, total = place[order], pack[order], np.concatenate([[0], np.cumsum(parts[order])])
            there = ~np.isnan(pack)
            packs = np.concatenate([[0], np.cumsum(there)])
            for f in self.features:
                low, high = np.searchsorted(place, probe - f.window_minutes * MINUTE_US, side="right"), np.searchsorted(place, probe, side="right")
                n = high - low
                if f.kind == "median":
                    out[f.name] = stretch_medians(pack[there], packs[low], packs[high])
                else:
                    out[f.name] = n.astype(float) if f.kind == "count" else np.where(n > 0, (total[high] - total[low]) / self.unit / np.maximum(n, 1), np.nan)
        return pd.DataFrame(out)


def online_features(trips: DataFrame, features: tuple[Trailing, ...], late: str = "2 hours", retain_minutes: int = RETAIN_MINUTES) -> DataFrame:
    """A stream of trip_id, t, and the features (null where the window is empty) of probes that the watermark has passed.

    Its state needs the store that ``PROVIDER`` names.
    """
    if len({f.entity for f in features}) != 1:
        raise TidemarkError("features of one entity at a time")
    if retain_minutes < (widest := max(f.window_minutes for f in features)):
        raise TidemarkError(f"a retention of {retain_minutes} minutes is less than the widest window, {widest}")
    if any(f.kind == "custom" for f in features):
        raise TidemarkError("the stream's state serves means, counts and medians")
    names = [f.name for f in features]
    line = time_line(trips, features[0].entity).withWatermark("at", late)
    schema = ", ".join(["trip_id string", "t long", *(f"{n} double" for n in names)])
    line = line.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(STATE_KEYS)))  # an entity alone costs a trigger as much as hundreds together
    found = line.groupBy("share").transformWithStateInPandas(Store(features, parts_of_a_minute(trips), retain_minutes), schema, "Append", "EventTime")
    return found.select("trip_id", "t", *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in names))


def labelled(predictions: DataFrame, outcomes: DataFrame, late: str = "1 hour", within_hours: int = 24, how: str = "inner") -> DataFrame:
    """Predictions joined to the outcomes that follow within a bound, both streams with a watermark, so that state is let go.

    With how = "left", a prediction whose outcome hasn't come when both watermarks have passed the bound comes without one.
    """
    p = predictions.withColumn("served_at", F.timestamp_micros("served_us")).withWatermark("served_at", late)
    o = outcomes.select(F.col("trip_id").alias("o_trip"), "actual_minutes", F.timestamp_micros("delivered_us").alias("delivered_at")).withWatermark("delivered_at", late)
    bound = F.expr(f"trip_id = o_trip AND delivered_at >= served_at AND delivered_at <= served_at + INTERVAL {within_hours} HOURS")
    return p.join(o, bound, how).drop("o_trip")


def sliding_health(predictions: DataFrame, minutes: int = 60, every: int = 5, late: str = "10 minutes") -> DataFrame:
    """Requests, mean prediction and fallback rate of (end - minutes, end] for each ``every`` minutes.

    Spark's windows are closed below and open above, so events are put one microsecond earlier to turn that round.
    """
    shifted = predictions.withColumn("at", F.timestamp_micros(F.col("served_us") - 1)).withWatermark("at", late)
    by_window = shifted.groupBy(F.window("at", f"{minutes} minutes", f"{every} minutes")).agg(F.count(F.lit(1)).alias("requests"), F.avg("pred_minutes").alias("mean_minutes"), F.avg(F.col("fallback").cast("double")).alias("fallback_rate"))
    return by_window.select(F.col("window.end").alias("as_of"), "requests", "mean_minutes", "fallback_rate")
