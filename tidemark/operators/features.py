"""Point-in-time features: a catalogue of declarations, compiled to columns and windows over time.

Every window aggregate of a trip is over trips of the same entity *delivered* in (as_of - W, as_of], where
as_of is the instant the trip was assigned, or another one to replay it at. History is ordered by delivery and
probes by as_of, so both are put on one time line, and each probe looks back over it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.medians import stretch_medians
from tidemark.functions.scalar import implied_pack, rush_hour
from tidemark.model import COLD_START_PACK_MINUTES, MINUTE_US, RETAIN_MINUTES, LeakageError, TidemarkError
from tidemark.operators.selection import partitions
from tidemark.sources.trips import finished

ENTITY_COLUMN = {"driver": "driver_id", "store": "store_id"}


def entity_column(entity: str) -> str:
    if entity not in ENTITY_COLUMN:
        raise TidemarkError(f"there is no entity {entity!r}; known: {', '.join(ENTITY_COLUMN)}")
    return ENTITY_COLUMN[entity]


@dataclass(frozen=True)
class Derived:
    """A feature of the trip alone: of() is an expression over its columns."""

    name: str
    description: str
    of: Callable[[], Column]

    entity = "trip"
    window_minutes = None


@dataclass(frozen=True)
class Trailing:
    """An aggregate over the trailing window of an entity.

    kind: mean (of the time taken), count, median (of the pack time), or custom: aggregate(column) of value(), an
    expression over a finished trip's columns; or, if it has to see the probe, of_members(array) of the values of the
    window's trips, an expression (a pandas UDF, too) that may use the probe's columns. cold() stands for the value if the window is empty; the built-in
    kinds have one of their own. merge(a, b) gives the aggregate of a window from those of two parts of it, either of which
    may hold no trip; with it a row costs the same however much its window holds. Maxima and minima have one.
    """

    name: str
    entity: str
    window_minutes: int
    kind: str
    description: str = ""
    value: Callable[[], Column] | None = None
    aggregate: Callable[[Column], Column] | None = None
    cold: Callable[[], Column] | None = None
    of_members: Callable[[Column], Column] | None = None
    merge: Callable[[Column, Column], Column] | None = None

    def __post_init__(self) -> None:
        ways = (self.aggregate is not None) + (self.of_members is not None)
        if self.kind not in ("mean", "count", "median", "custom") or (self.kind == "custom") != (ways == 1):
            raise TidemarkError(f"{self.name}: a kind is mean, count, median, or custom with an aggregate")
        if self.merge is not None and self.aggregate is None:
            raise TidemarkError(f"{self.name}: only an aggregate of its own is merged")

    def merged(self) -> Callable[[Column, Column], Column] | None:
        """What merges two parts of a custom aggregate, if that is known."""
        return self.merge or {F.max: F.greatest, F.min: F.least}.get(self.aggregate)

    def whole(self) -> Column:
        """The aggregate over all rows of a group, for history columns as _history names them."""
        if self.of_members is not None:
            raise TidemarkError(f"{self.name} needs a probe and a window")
        if self.kind == "custom":
            return self.aggregate(F.col(f"h_{self.name}"))
        return {"mean": F.sum("h_tat").cast("double") / F.count("h_tat"), "count": F.count("h_tat").cast("double"), "median": F.percentile("h_pack", 0.5)}[self.kind]

    def warm(self, value: Column) -> Column:
        """The value, or what stands for it when the window is empty."""
        usual = {"mean": lambda: F.col("promised_minutes").cast("double"), "count": lambda: F.lit(0.0), "median": lambda: F.lit(COLD_START_PACK_MINUTES), "custom": lambda: F.lit(None).cast("double")}[self.kind]
        return F.coalesce(value, (self.cold or usual)())


def _hour() -> Column:
    return F.hour("assigned_at")


DERIVED = (
    Derived("distance_m", "metres to the customer", lambda: F.col("distance_m").cast("double")),
    Derived("log_distance", "logarithm of one plus the metres", lambda: F.log1p(F.col("distance_m").cast("double"))),
    Derived("hour_of_day", "hour of assignment", lambda: _hour().cast("double")),
    Derived("is_rush_hour", "1 at lunch and dinner", lambda: rush_hour(_hour())),
    Derived("day_of_week", "0 on Mondays", lambda: F.weekday("assigned_at").cast("double")),
)
TRAILING = (
    Trailing("store_pack_p50_60m", "store", 60, "median", "median implied packing time of the store"),
    Trailing("driver_mean_tat_120m", "driver", 120, "mean", "mean time taken by the driver"),
    Trailing("driver_trips_120m", "driver", 120, "count", "trips that the driver finished"),
    Trailing("store_mean_tat_120m", "store", 120, "mean", "mean time taken from the store"),
)
CATALOGUE = DERIVED + TRAILING
FEATURE_NAMES = tuple(f.name for f in CATALOGUE)


def trailing_of(catalogue: tuple) -> dict[str, tuple[Trailing, ...]]:
    """The windowed features of a catalogue by entity."""
    own = [f for f in catalogue if isinstance(f, Trailing)]
    return {e: tuple(f for f in own if f.entity == e) for e in dict.fromkeys(f.entity for f in sorted(own, key=lambda f: f.entity))}


def catalogue(spark: SparkSession, features: tuple = CATALOGUE) -> DataFrame:
    rows = [(i, f.name, f.entity, f.window_minutes, "double", f.description) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "position int, name string, entity string, window_minutes int, dtype string, description string")


def derived(trips: DataFrame, features: tuple = DERIVED) -> DataFrame:
    return trips.withColumns({f.name: f.of() for f in features if isinstance(f, Derived)})


def instant(trips: DataFrame) -> Column:
    """What a row is seen as of: as_of_us where it has one (a replay), its assignment otherwise."""
    return F.col("as_of_us" if "as_of_us" in trips.columns else "a_us")


def _history(trips: DataFrame, entity: str, at: str, features: tuple[Trailing, ...] = ()) -> DataFrame:
    """Finished trips as values at an instant (delivery, or assignment for the leaky variant)."""
    own = [f.value().alias(f"h_{f.name}") for f in features if f.kind == "custom"]
    return finished(trips).select(F.col(entity_column(entity)).alias("h_key"), F.col(at).alias("h_t"), F.col("tat").alias("h_tat"), implied_pack(F.col("tat"), F.col("distance_m")).alias("h_pack"), F.col("d_us").alias("h_d"), F.col("trip_id").alias("h_trip"), *own)


#: Widths of the widest window in a slice of time. History that a later slice looks back on is copied there.
SLICE_WINDOWS = 4
#: Bytes of input that one partition of a time line should hold.
LINE_BYTES = 4 * 2**20


def _line(probes: DataFrame, known: DataFrame, entity: str, widest: int, leaves: list[int], halved: tuple[int, ...] = ()) -> DataFrame:
    """Probes and history on one time line for each entity and slice of time, in order; at one instant history comes first.

    One shuffle serves all features of an entity, and an entity with a third of all rows is spread over as many
    tasks as it has slices. A trip enters at h_t (h_w is 0) and, for each width in ``leaves``, leaves once more
    when it falls out of a window of that width (h_w is the width), unless the slice ends before; for the widths in
    ``halved`` (see ``_sliding``) after its end, too.
    """
    width = widest * SLICE_WINDOWS
    known = known.withColumn("h_slice", F.explode(F.sequence(F.floor(F.col("h_t") / width), F.floor((F.col("h_t") + (widest - 1)) / width))))
    steps = F.array(*(F.struct((F.col("h_t") + w).alias("h_t"), F.lit(w).cast("long").alias("h_w")) for w in sorted({0, *leaves, *halved})))
    in_time = lambda s: s["h_t"] < (F.col("h_slice") + 1) * width
    step = F.explode(F.filter(steps, lambda s: in_time(s) | s["h_w"].isin(*halved) if halved else in_time(s))).alias("step")
    known = known.select(*(c for c in known.columns if c != "h_t"), step).select("*", "step.*").drop("step").withColumn("h_probe", F.lit(False))
    at = instant(probes)
    asked = probes.withColumns({"h_key": F.col(entity_column(entity)), "h_t": at, "h_slice": F.floor(at / width), "h_probe": F.lit(True)})
    line = asked.unionByName(known, allowMissingColumns=True)
    n = partitions(line, LINE_BYTES)  # the session's count is left to be coalesced
    return line.repartition(*([n] if n > int(line.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []), "h_key", "h_slice").sortWithinPartitions("h_key", "h_slice", "h_t", "h_probe")


def _sliding(aggregate: Callable[[Column], Column], merge: Callable[[Column, Column], Column], value: Column, width: int) -> Column:
    """An aggregate over (h_t - width, h_t] of a time line, at the same cost for each row however much a window holds.

    Time is cut into stretches of one width. A window is the beginning of its own stretch and the end of the one
    before, whose trips leave (h_w is the width) in the window's own stretch. Both are running aggregates, from either side.
    """
    stretch = Window.partitionBy("h_key", "h_slice", F.floor(F.col("h_t") / width))
    begun = aggregate(F.when(F.col("h_w") == 0, value)).over(stretch.orderBy("h_t").rangeBetween(Window.unboundedPreceding, 0))
    ending = aggregate(F.when(F.col("h_w") == width, value)).over(stretch.orderBy(F.col("h_t").desc()).rangeBetween(Window.unboundedPreceding, -1))
    return merge(begun, ending)


def trailing(probes: DataFrame, trips: DataFrame, features: tuple[Trailing, ...], history_at: str = "d_us", guarded: bool = False) -> DataFrame:
    """probes with a column for each feature (null where its window is empty); all features of one entity.

    Means and counts are running totals along the time line, of trips that enter and leave, so a row costs the same
    however much its window holds; they are exact, because times are decimals. Medians look at a row once for each
    binary digit of a slice's size (see ``_medians``). Custom aggregates that merge are running ones, too (see ``_sliding``); others use RANGE frames, whose
    work grows with the window. guarded: the job fails with the
    message of ``guard`` if a window holds a trip delivered after the probe's instant; no job of its own is needed.
    """
    if len({f.entity for f in features}) != 1:
        raise TidemarkError("features of one entity at a time")
    entity, us = features[0].entity, lambda f: f.window_minutes * MINUTE_US
    summed = [f for f in features if f.kind in ("mean", "count")]
    widest = max(map(us, features))
    halved = {us(f) for f in features if f.merged()} | ({widest} if guarded else set())
    line = _line(probes, _history(trips, entity, history_at, features), entity, widest, sorted({us(f) for f in summed}), tuple(sorted(halved)))
    place = Window.partitionBy("h_key", "h_slice")
    so_far = place.orderBy("h_t", "h_probe").rangeBetween(Window.unboundedPreceding, 0)
    inside = lambda f, v: F.sum(F.when(F.col("h_w") == 0, v).when(F.col("h_w") == us(f), -v)).over(so_far)
    columns = {}
    for f in features:
        if f in summed:
            n = inside(f, F.lit(1))
            columns[f.name] = F.when(n > 0, inside(f, F.col("h_tat")).cast("double") / n) if f.kind == "mean" else F.coalesce(n, F.lit(0)).cast("double")
        elif f.merged():
            columns[f.name] = _sliding(f.aggregate, f.merged(), F.col(f"h_{f.name}"), us(f))
        elif f.kind == "custom":
            frame = place.orderBy("h_t").rangeBetween(1 - us(f), 0)
            value = F.when(F.col("h_w") == 0, F.col(f"h_{f.name}"))
            columns[f.name] = f.aggregate(value).over(frame) if f.aggregate else F.when(F.col("h_probe"), f.of_members(F.collect_list(value).over(frame)))
    if guarded:
        last = _sliding(F.max, F.greatest, F.struct("h_d", "h_trip"), widest)
        columns["h_fair"] = F.when(F.col("h_probe") & (last["h_d"] > F.col("h_t")), F.raise_error(_leak(entity, widest // MINUTE_US, F.col("trip_id"), F.col("h_t"), last["h_trip"], last["h_d"])).cast("boolean")).otherwise(True)
    out = line.withColumns(columns) if columns else line
    middle = [f for f in features if f.kind == "median"]
    if middle:
        needed = out.where(F.col("h_probe") | (F.col("h_w") == 0)).select(*probes.columns, *columns, "h_key", "h_slice", "h_t", "h_probe", "h_pack")
        out = _medians(needed.sortWithinPartitions("h_key", "h_slice", "h_t", "h_probe"), {f.name: us(f) for f in middle})
    return out.where("h_probe AND h_fair" if guarded else "h_probe").select(*probes.columns, *(f.name for f in features))


def _leak(entity: str, minutes: int, trip: Column, at: Column, held: Column, delivered: Column) -> Column:
    """What is wrong with a window that holds a trip delivered after its probe's instant."""
    return F.concat(F.lit("trip "), trip.cast("string"), F.lit(f": the {entity} window of {minutes} minutes at "), at.cast("string"), F.lit(" us holds trip "), held.cast("string"), F.lit(", which is delivered at "), delivered.cast("string"), F.lit(" us"))


def members(probes: DataFrame, trips: DataFrame, entity: str, minutes: int, history_at: str = "d_us") -> DataFrame:
    """A row for each probe and finished trip in its window: trip_id and as_of_us of the probe, member_id and member_us.

    An interval join: a trip is filed under the bins of time, as wide as the window, from which a probe can look back
    on it (two at most), a probe under its own; the exact check follows. A busy entity is spread over its bins. Probes
    with an empty window have no row.
    """
    key, width, at = entity_column(entity), minutes * MINUTE_US, instant(probes)
    asked = probes.select("trip_id", F.col(key).alias("m_key"), at.alias("as_of_us"), F.floor(at / width).alias("m_bin"))
    bins = F.sequence(F.floor(F.col("member_us") / width), F.floor((F.col("member_us") + (width - 1)) / width))
    known = finished(trips).select(F.col("trip_id").alias("member_id"), F.col(key).alias("m_key"), F.col(history_at).alias("member_us")).withColumn("m_bin", F.explode(bins))
    inside = (F.col("member_us") > F.col("as_of_us") - width) & (F.col("member_us") <= F.col("as_of_us"))
    return asked.join(known, ["m_key", "m_bin"]).where(inside).select("trip_id", "as_of_us", "member_id", "member_us")


def _medians(line: DataFrame, widths: dict[str, int]) -> DataFrame:
    """The probes of a time line with the interpolated median of h_pack over each width. Null and NaN packs don't count.

    Runs of one key and slice are handled whole, in numpy; at most one of them is held. A probe's window is a stretch of
    the run's values in the order of time; see ``stretch_medians``.
    """
    schema = T.StructType([*line.schema, *(T.StructField(n, T.DoubleType()) for n in widths)])

    def medians(t: np.ndarray, pack: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        return stretch_medians(pack, np.searchsorted(t, at - width, side="right"), np.searchsorted(t, at, side="right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in runs(batches, ("h_key", "h_slice")):
            probe = np.asarray(table.column("h_probe").to_numpy(zero_copy_only=False), bool)
            t, pack = np.asarray(table.column("h_t")), table.column("h_pack").to_numpy(zero_copy_only=False).astype(float)
            found = {n: np.full(len(t), np.nan) for n in widths}
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                ask = a + np.flatnonzero(probe[a:b])
                known = a + np.flatnonzero(~probe[a:b] & ~np.isnan(pack[a:b]))
                for name, width in widths.items():
                    if len(ask) and len(known):
                        found[name][ask] = medians(t[known], pack[known], t[ask], width)
            kept = table.filter(pa.array(probe))
            columns = [pa.array(v[probe], pa.float64(), mask=np.isnan(v[probe])) for v in found.values()]
            for batch in pa.table([*kept.columns, *columns], schema.names).to_batches():
                yield batch

    return line.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by key as tables that hold whole runs of it, with the runs' offsets."""
    held: list[pa.Table] = []  # parts of one run, but for the last, which may hold the end of it and whole others

    def whole() -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(held)
        return table, _edges(table, key)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        last = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), new]) if held else new  # a run that goes on is looked at once
        cut = int(_edges(last, key)[-2]) - bool(held)
        if cut > 0 or (held and cut == 0):
            held.append(new.slice(0, cut))
            yield whole()
            held = []
        held.append(new.slice(max(cut, 0)))
    if held:
        yield whole()


def _edges(table: pa.Table, key: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in key:
        code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code.indices if isinstance(code, pa.DictionaryArray) else code.combine_chunks().indices
        code = np.asarray(code)
        new[1:] |= code[1:] != code[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def running(probes: DataFrame, trips: DataFrame, features: tuple[Trailing, ...], slice_minutes: int = 1440) -> DataFrame:
    """As ``trailing``, for means and counts over windows that are long against the table's span.

    Slices there are as long as windows, here as short as one likes: each probe asks twice for totals up to an
    instant, at as_of and at as_of - W, and subtracts. The totals of whole slices before are added from a small table.
    Rows that share an id, entity and instant get the same answer each.
    """
    if any(f.kind not in ("mean", "count") for f in features) or len({f.entity for f in features}) != 1:
        raise TidemarkError("running totals serve means and counts of one entity")
    key, width = entity_column(features[0].entity), slice_minutes * MINUTE_US
    known = _history(trips, features[0].entity, "d_us").select("h_key", "h_t", "h_tat").withColumn("h_slice", F.floor(F.col("h_t") / width))
    totals = known.groupBy("h_key", "h_slice").agg(F.sum("h_tat").alias("s"), F.count("h_tat").alias("n"))
    before = Window.partitionBy("h_key").orderBy("h_slice").rowsBetween(Window.unboundedPreceding, -1)
    # The slices of a probe may hold no history: the line of slices has those as well.
    at_us = instant(probes)
    asks = F.array(F.struct(F.lit(0).alias("w"), at_us.alias("h_t")), *(F.struct(F.lit(w).alias("w"), (at_us - w * MINUTE_US).alias("h_t")) for w in sorted({f.window_minutes for f in features})))
    asked = probes.select(F.col("trip_id").alias("p_id"), F.col(key).alias("h_key"), at_us.alias("p_us"), F.explode(asks).alias("ask")).select("p_id", "h_key", "p_us", "ask.*").withColumn("h_slice", F.floor(F.col("h_t") / width))
    slices = asked.select("h_key", "h_slice").distinct().unionByName(totals.select("h_key", "h_slice")).distinct().join(totals, ["h_key", "h_slice"], "left")
    opening = slices.select("h_key", "h_slice", F.sum("s").over(before).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    line = asked.unionByName(known, allowMissingColumns=True).unionByName(opening.withColumn("h_t", F.col("h_slice") * width - 1), allowMissingColumns=True)
    so_far = Window.partitionBy("h_key", "h_slice").orderBy("h_t").rangeBetween(Window.unboundedPreceding, 0)
    upto = line.select("p_id", "h_key", "p_us", "w", (F.coalesce(F.sum("h_tat").over(so_far), F.lit(0)) + F.coalesce(F.sum("s0").over(so_far), F.lit(0))).alias("s"), (F.count("h_tat").over(so_far) + F.coalesce(F.sum("n0").over(so_far), F.lit(0))).alias("n")).where(F.col("w").isNotNull())
    at = lambda what, w: F.max(F.when(F.col("w") == w, F.col(what)))
    columns = []
    for f in features:
        n = at("n", 0) - at("n", f.window_minutes)
        mean = F.when(n > 0, (at("s", 0) - at("s", f.window_minutes)).cast("double") / n)
        columns.append((mean if f.kind == "mean" else n.cast("double")).alias(f.name))
    answers = upto.groupBy("p_id", "h_key", "p_us").agg(*columns)
    same = probes["trip_id"].eqNullSafe(answers["p_id"]) & probes[key].eqNullSafe(answers["h_key"]) & at_us.eqNullSafe(answers["p_us"])
    return probes.join(answers, same).drop("p_id", "h_key", "p_us")


def historical(trips: DataFrame, features: tuple = CATALOGUE, as_of: Column | None = None, guarded: bool = False) -> DataFrame:
    """Every trip with all features of a catalogue, as of its own assignment or, to replay it, of another instant (as_of_us).

    guarded: see ``trailing``.
    """
    return _vectors(trips, "d_us", features, as_of, guarded)


def leaky_in_flight(trips: DataFrame, features: tuple = CATALOGUE, guarded: bool = False) -> DataFrame:
    """The wrong way: finished trips count from their assignment on, before anyone could know how they end; the trip itself, too."""
    return _vectors(trips, "a_us", features, guarded=guarded)


def _warm(trips: DataFrame, features: tuple) -> DataFrame:
    return derived(trips.withColumns({f.name: f.warm(F.col(f.name)) for f in features if isinstance(f, Trailing)}), features)


def _vectors(trips: DataFrame, history_at: str, features: tuple, as_of: Column | None = None, guarded: bool = False) -> DataFrame:
    out = trips if as_of is None else trips.withColumn("as_of_us", as_of)
    for own in trailing_of(features).values():
        out = trailing(out, trips, own, history_at, guarded)
    return _warm(out, features)


def leaky_lifetime(trips: DataFrame, features: tuple = CATALOGUE) -> DataFrame:
    """The other wrong way: an entity's whole history, the future included."""
    out = trips
    for entity, own in trailing_of(features).items():
        whole = _history(trips, entity, "d_us", own).groupBy("h_key").agg(*(f.whole().alias(f.name) for f in own))
        out = out.join(whole, out[entity_column(entity)] == whole.h_key, "left").drop("h_key")
    return _warm(out, features)


def vectors(featured: DataFrame, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """Trip, instant and the features as a map, for edges that want vectors; a missing column is an analysis error."""
    return featured.select("trip_id", F.col("assigned_at").alias("as_of"), instant(featured).alias("a_us"), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names))).alias("values"))


def online(trips: DataFrame, entity: str, window_minutes: int, as_of_us: int) -> DataFrame:
    """What a store answers at one instant: for each key, the aggregates of (as_of - W, as_of]."""
    recent = finished(trips).where((F.col("d_us") > as_of_us - window_minutes * MINUTE_US) & (F.col("d_us") <= as_of_us))
    pack = implied_pack(F.col("tat"), F.col("distance_m"))
    return recent.groupBy(F.col(entity_column(entity)).alias("key")).agg(F.count("tat").alias("n"), (F.sum("tat").cast("double") / F.count("tat")).alias("mean_tat"), F.percentile(pack, 0.5).alias("pack_p50"))


def retained(trips: DataFrame, as_of_us: int, retain_minutes: int = RETAIN_MINUTES) -> DataFrame:
    """How many trips a store holds for each driver if it keeps what was delivered after (newest - retention)."""
    widest = max(f.window_minutes for f in TRAILING)
    if retain_minutes < widest:
        raise TidemarkError(f"a retention of {retain_minutes} minutes is less than the widest window, {widest}")
    seen = finished(trips).where(F.col("d_us") <= as_of_us)
    newest = seen.agg(F.max("d_us")).first()[0] or 0
    held = seen.where(F.col("d_us") > newest - retain_minutes * MINUTE_US)
    return held.groupBy("driver_id").agg(F.countDistinct("trip_id").alias("held"))


def _latest(trips: DataFrame, entity: str, widest: int, history_at: str) -> DataFrame:
    """trips with ``latest``: delivery and id of the trip in their window that was delivered last."""
    line = _line(trips, _history(trips, entity, history_at), entity, widest, [], (widest,))
    last = _sliding(F.max, F.greatest, F.struct("h_d", "h_trip"), widest)
    return line.withColumn("latest", last).where("h_probe").select(*trips.columns, "latest")


def leak_audit(trips: DataFrame, history_at: str = "d_us", features: tuple = CATALOGUE) -> DataFrame:
    """For each entity: probes, and probes whose widest window holds a trip delivered after the probe's instant."""
    parts = []
    for entity, own in sorted(trailing_of(features).items()):
        seen = _latest(trips, entity, max(f.window_minutes for f in own) * MINUTE_US, history_at)
        parts.append(seen.agg(F.lit(entity).alias("entity"), F.count(F.lit(1)).alias("probes"), F.count_if(F.col("latest.h_d") > instant(trips)).alias("leaks")))
    return reduce(DataFrame.unionByName, parts)


def guard(trips: DataFrame, history_at: str = "d_us", features: tuple = CATALOGUE) -> DataFrame:
    """trips, if no feature of theirs would read the future; LeakageError names a trip that would, the window and the trip that it holds."""
    for entity, own in sorted(trailing_of(features).items()):
        minutes = max(f.window_minutes for f in own)
        at = instant(trips)
        found = _latest(trips, entity, minutes * MINUTE_US, history_at).where(F.col("latest.h_d") > at).select("trip_id", at.alias("at"), "latest.*").first()
        if found:
            raise LeakageError(f"trip {found['trip_id']}: the {entity} window of {minutes} minutes at {found['at']} us holds trip {found['h_trip']}, which is delivered at {found['h_d']} us")
    return trips
