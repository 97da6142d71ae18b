"""The registered queries, each with the SQL that gives the same rows.

Floats are rounded on both sides; sums of times are exact, as times are decimals.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.quantiles import nearest_rank
from tidemark.functions.scalar import bucket, parse_timestamp
from tidemark.model import MINUTE_US, PSI_BINS, RIDGE_ALPHA, TidemarkError
from tidemark.operators import drift, experiment, features, monitoring, serving, training
from tidemark.operators.history import TripStore
from tidemark.plans.runs import train
from tidemark.sources import trips as sources
from tidemark.streaming.drift import sliding_psi
from tidemark.streaming.requests import score_requests
from tidemark.streaming.store import PROVIDER, online_features
from tidemark.streaming.store import labelled as labelled_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- Tables ---------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_events(table(spark, sf_dir, "events"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def us(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp()) * 1_000_000


SWITCH_US = us("2024-01-20T00:00:00")
INSTANTS = [SWITCH_US + m * MINUTE_US for m in (20, 40, 60, 360)]
AS_OF_US = INSTANTS[-1]
SPLIT, SALT = 0.5, "eta-v2"
DAY = 1440

TRIPS = """trips AS (SELECT event_id AS trip_id, user_id AS driver_id, event_type AS store_id, ts AS assigned_at, epoch_us(ts) AS a_us,
        CASE WHEN event_id % 17 <> 0 THEN CAST(value AS DECIMAL(18,2)) END AS tat,
        CASE WHEN event_id % 17 <> 0 THEN epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 END AS d_us,
        CAST(props->>'$.k' AS INTEGER) * 100 AS distance_m, 36 AS promised_minutes FROM events)"""
PACK = "(CAST(tat AS DOUBLE) - CAST(distance_m AS DOUBLE) / 220::DOUBLE)"
DERIVED_SQL = """CAST(distance_m AS DOUBLE) AS distance_m, round(ln(1 + distance_m::DOUBLE), 6) AS log_distance, CAST(hour(assigned_at) AS DOUBLE) AS hour_of_day,
        CASE WHEN hour(assigned_at) IN (12, 13, 19, 20, 21) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_rush_hour, CAST(isodow(assigned_at) - 1 AS DOUBLE) AS day_of_week"""


def line_sql(name: str, key: str, at: str = "d_us") -> str:
    """The time line of an entity, probes and history, with window columns; names one CTE."""
    f = lambda minutes: f"(PARTITION BY k ORDER BY t RANGE BETWEEN {minutes * MINUTE_US - 1} PRECEDING AND CURRENT ROW)"
    return f"""{name} AS (SELECT * FROM (SELECT trip_id, probe,
        sum(tat) OVER {f(120)} AS sum_120, count(tat) OVER {f(120)} AS n_120, quantile_cont(pack, 0.5) OVER {f(60)} AS p50_60, max(d) OVER {f(120)} AS latest, t
        FROM (SELECT {key} AS k, a_us AS t, trip_id, true AS probe, NULL::DECIMAL(18,2) AS tat, NULL::DOUBLE AS pack, NULL::BIGINT AS d FROM trips
              UNION ALL SELECT {key}, {at}, trip_id, false, tat, {PACK}, d_us FROM trips WHERE d_us IS NOT NULL)) WHERE probe)"""


def features_sql(at: str = "d_us") -> str:
    return f"""{line_sql("by_driver", "driver_id", at)}, {line_sql("by_store", "store_id", at)},
        feats AS (SELECT trip_id, {DERIVED_SQL}, coalesce(round(s.p50_60, 6), 8.0::DOUBLE) AS store_pack_p50_60m,
        coalesce(round(d.sum_120::DOUBLE / d.n_120, 6), promised_minutes::DOUBLE) AS driver_mean_tat_120m, d.n_120::DOUBLE AS driver_trips_120m,
        coalesce(round(s.sum_120::DOUBLE / s.n_120, 6), promised_minutes::DOUBLE) AS store_mean_tat_120m
        FROM trips JOIN by_driver d USING (trip_id) JOIN by_store s USING (trip_id))"""


RAW_FEATURES = features_sql().replace("round(s.p50_60, 6)", "s.p50_60").replace("round(d.sum_120::DOUBLE / d.n_120, 6)", "d.sum_120::DOUBLE / d.n_120").replace("round(s.sum_120::DOUBLE / s.n_120, 6)", "s.sum_120::DOUBLE / s.n_120").replace("round(ln(1 + distance_m::DOUBLE), 6)", "ln(1 + distance_m::DOUBLE)")
SPLIT_SQL = "split AS (SELECT *, row_number() OVER (ORDER BY a_us, trip_id) <= CAST(floor((SELECT count(*) FROM trips) * (1.0::DOUBLE - 0.2::DOUBLE)) AS BIGINT) AS is_train FROM trips)"
LATE = "assigned_at >= TIMESTAMP '2024-01-20 00:00:00'"
PREDICTIONS = f"""predictions AS (SELECT trip_id, CASE WHEN trip_id % 20 = 0 THEN 36.0::DOUBLE ELSE (36.0::DOUBLE + 0.5::DOUBLE * ((trip_id % 7) - 3)) * (CASE WHEN {LATE} THEN 2 ELSE 1 END) END AS pred_minutes,
        a_us AS served_us, trip_id % 20 = 0 AS fallback, CASE WHEN {LATE} THEN 'v1-bad' ELSE 'v1' END AS model_version,
        CASE WHEN trip_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, promised_minutes::DOUBLE AS promised_minutes, tat::DOUBLE AS actual_minutes, coalesce(CASE WHEN trip_id % 13 <> 1 THEN d_us END, a_us + CAST(tat * {MINUTE_US} AS BIGINT)) + {10 * MINUTE_US} AS label_us, driver_id FROM trips)"""
SEEN = f"""seen AS (SELECT p.*, g.as_of_us, actual_minutes IS NOT NULL AND label_us <= g.as_of_us AS known, abs(pred_minutes - actual_minutes) AS err
        FROM predictions p, (SELECT unnest([{", ".join(map(str, INSTANTS))}]) AS as_of_us) g)"""
OUTCOMES = "outcomes AS (SELECT CAST(driver_id AS VARCHAR) AS entity_id, abs(pred_minutes - actual_minutes) AS error, fallback FROM predictions WHERE actual_minutes IS NOT NULL)"
BUCKET = f"(('0x' || substr(sha256('{SALT}:' || entity_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE)"
ARM = f"CASE WHEN {BUCKET} < {SPLIT}::DOUBLE THEN 'treatment' ELSE 'control' END"
ARMS = f"""arms AS (SELECT {ARM} AS arm, count(*) AS n, avg(error) AS mean, coalesce(stddev_samp(error), 0) AS std, coalesce(var_samp(error), 0) AS variance, avg(fallback::INT::DOUBLE) AS fallback_rate FROM outcomes GROUP BY 1),
        both_arms AS (SELECT coalesce(max(n) FILTER (WHERE arm = 'control'), 0) AS c_n, max(mean) FILTER (WHERE arm = 'control') AS c_mean, max(variance) FILTER (WHERE arm = 'control') AS c_var,
        coalesce(max(n) FILTER (WHERE arm = 'treatment'), 0) AS t_n, max(mean) FILTER (WHERE arm = 'treatment') AS t_mean, max(variance) FILTER (WHERE arm = 'treatment') AS t_var,
        coalesce(max(fallback_rate) FILTER (WHERE arm = 'treatment'), 0) AS t_fallback FROM arms),
        pooled AS (SELECT *, CASE WHEN c_n >= 2 AND t_n >= 2 THEN sqrt(((c_n - 1) * c_var + (t_n - 1) * t_var) / (c_n + t_n - 2)) END AS pooled_std FROM both_arms)"""
Z = experiment.z_sum()


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# --- Sources and functions ------------------------------------------------------------------------------------


@query(sql(TRIPS, select="SELECT trip_id, driver_id, store_id, a_us, tat::DOUBLE AS tat, d_us, distance_m, promised_minutes FROM trips WHERE tat IS NOT NULL"))
def src_trips(spark, sf_dir):
    """Labelled trips of the adapter, through the filters of the warehouse scan."""
    trips = trips_of(spark, sf_dir)
    kept = trips.where(F.col("tat").isNotNull() & F.col("distance_m").isNotNull())
    return kept.select("trip_id", "driver_id", "store_id", "a_us", F.col("tat").cast("double").alias("tat"), "d_us", "distance_m", "promised_minutes")


@query(sql(TRIPS, select="SELECT trip_id, tat::DOUBLE AS tat, a_us, d_us FROM trips WHERE tat IS NOT NULL AND trip_id % 7 <> 0"))
def src_dispatch(spark, sf_dir):
    """The scan of a warehouse's fact table, some of whose trips aren't complete."""
    fact = trips_of(spark, sf_dir).withColumn("completeness", F.when(F.col("trip_id") % 7 == 0, "partial").otherwise("complete"))
    return sources.from_dispatch(fact).select("trip_id", F.col("tat").cast("double").alias("tat"), "a_us", "d_us")


@query(sql(TRIPS, select="SELECT trip_id, d_us FROM trips WHERE d_us IS NOT NULL AND tat IS NOT NULL"))
def src_finished(spark, sf_dir):
    return sources.finished(trips_of(spark, sf_dir)).select("trip_id", "d_us")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS trip_key, o_custkey AS driver_id, l_suppkey AS store_id,
        epoch_us(o_orderdate::TIMESTAMP) AS a_us, epoch_us(l_shipdate::TIMESTAMP) AS d_us FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate"""
)
def src_day_trips(spark, sf_dir):
    """Trips by the day, with many ties and some of no duration."""
    trips = sources.from_orders(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    return trips.select(F.substring_index("trip_id", "-", 4).alias("trip_key"), "driver_id", "store_id", "a_us", "d_us")


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def fn_ts_parse(spark, sf_dir):
    """Text with a trailing Z, read back without conversion."""
    text = table(spark, sf_dir, "events").select("event_id", F.concat(F.regexp_replace(F.col("ts").cast("string"), " ", "T"), F.lit("Z")).alias("text"))
    return text.select("event_id", F.unix_micros(parse_timestamp(F.col("text")).cast("timestamp")).alias("us"))


@query(
    """SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE event_id END AS trip_number, CASE WHEN event_id % 10 IN (3, 4, 5) THEN NULL ELSE 100 END AS distance_m,
        CASE event_id % 10 WHEN 3 THEN 'request is missing trip_id' WHEN 4 THEN 'request is missing distance_m' WHEN 5 THEN 'request field is unreadable: distance_m' END AS error
        FROM (SELECT * FROM events WHERE event_id % 10 NOT IN (4, 5)) UNION ALL
        SELECT event_id, NULL, NULL, CASE event_id % 10 WHEN 4 THEN 'request is missing distance_m' ELSE 'request field is unreadable: distance_m' END FROM events WHERE event_id % 10 IN (4, 5)"""
)
def fn_payload_parse(spark, sf_dir):
    """Request bodies, some of which lack a field or hold one that can't be read."""
    last = F.col("event_id") % 10
    field = lambda name, value, bad: F.when(bad, F.lit("")).otherwise(F.concat(F.lit(f'"{name}": '), value, F.lit(", ")))
    distance = F.when(last == 5, F.lit('"far"')).otherwise(F.lit("100"))
    rest = F.lit('"store_id": "S", "driver_id": "D", "assigned_at": "2024-01-01T09:00:00Z", "promised_minutes": 19}')
    body = F.concat(F.lit("{"), field("trip_id", F.col("event_id").cast("string"), last == 3), field("distance_m", distance, last == 4), rest)
    parsed = sources.from_payloads(table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return parsed.select("event_id", F.col("trip_id").cast("bigint").alias("trip_number"), "distance_m", "error")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.9), 6) AS p90, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY user_id")
def fn_nearest_rank(spark, sf_dir):
    by_user = table(spark, sf_dir, "events").groupBy("user_id")
    return rounded(by_user.agg(F.count("value").alias("n"), *(nearest_rank("value", q).alias(f"p{q}") for q in (50, 90, 99))))


# --- Features -------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f.name}', '{f.entity}', {f.window_minutes or 'NULL'})" for i, f in enumerate(features.CATALOGUE)) + ") t(position, name, entity, window_minutes)")
def feat_catalog(spark, sf_dir):
    return features.catalogue(spark).select("position", "name", "entity", "window_minutes")


@query(sql(TRIPS, select=f"SELECT trip_id, {DERIVED_SQL} FROM trips"))
def feat_derived(spark, sf_dir):
    return rounded(features.derived(trips_of(spark, sf_dir)).select("trip_id", *(f.name for f in features.DERIVED)))


def one_feature(name: str, kind: str) -> None:
    spec = next(f for f in features.TRAILING if f.name == name)
    key = features.ENTITY_COLUMN[spec.entity]
    value = {"mean": "coalesce(round(sum_120::DOUBLE / n_120, 6), 36.0::DOUBLE)", "count": "n_120::DOUBLE", "median": "coalesce(round(p50_60, 6), 8.0::DOUBLE)"}[spec.kind]

    def run(spark, sf_dir):
        trips = trips_of(spark, sf_dir)
        seen = features.trailing(trips, trips, (spec,))
        return rounded(seen.select("trip_id", spec.warm(F.col(name)).alias("value")))

    run.__name__ = kind
    query(sql(TRIPS, line_sql("line", key), select=f"SELECT trip_id, {value} AS value FROM line"))(run)


for _name, _key in (("driver_mean_tat_120m", "feat_driver_mean"), ("store_mean_tat_120m", "feat_store_mean"), ("driver_trips_120m", "feat_driver_count"), ("store_pack_p50_60m", "feat_store_pack")):
    one_feature(_name, _key)


@query(
    sql(
        TRIPS.replace("CAST(props->>'$.k' AS INTEGER) * 100 AS distance_m", "CASE WHEN event_id % 3 <> 1 THEN CAST(props->>'$.k' AS INTEGER) * 100 END AS distance_m"),
        line_sql("by_store", "store_id"),
        select="SELECT trip_id, coalesce(round(p50_60, 6), 8.0::DOUBLE) AS store_pack_p50_60m FROM by_store",
    )
)
def feat_store_pack_unknown(spark, sf_dir):
    """Median pack times where a third of all distances isn't known: such trips have no pack time and don't count."""
    trips = trips_of(spark, sf_dir).withColumn("distance_m", F.when(F.col("trip_id") % 3 != 1, F.col("distance_m")))
    own = tuple(f for f in features.TRAILING if f.kind == "median")
    return rounded(features.historical(trips, own).select("trip_id", "store_pack_p50_60m"))


@query(sql(TRIPS, features_sql(), select="SELECT * FROM feats"))
def feat_historical(spark, sf_dir):
    """Every trip with all nine features, as of its own assignment."""
    return rounded(features.historical(trips_of(spark, sf_dir)).select("trip_id", *features.FEATURE_NAMES))


@query(sql(TRIPS, features_sql("a_us"), select="SELECT * FROM feats"))
def feat_leaky_in_flight(spark, sf_dir):
    return rounded(features.leaky_in_flight(trips_of(spark, sf_dir)).select("trip_id", *features.FEATURE_NAMES))


_REPLAY = 30 * MINUTE_US


@query(sql(TRIPS, line_sql("by_driver", "driver_id").replace("a_us AS t", f"a_us + {_REPLAY} AS t"), select="SELECT trip_id, coalesce(round(sum_120::DOUBLE / n_120, 6), 36.0::DOUBLE) AS driver_mean_tat_120m, n_120::DOUBLE AS driver_trips_120m, t AS as_of_us FROM by_driver"))
def feat_replay(spark, sf_dir):
    """Features as of half an hour after the assignment."""
    own = tuple(f for f in features.TRAILING if f.entity == "driver")
    seen = features.historical(trips_of(spark, sf_dir), own, as_of=F.col("a_us") + _REPLAY)
    return rounded(seen.select("trip_id", *(f.name for f in own), "as_of_us"))


_HOUR = f"(PARTITION BY k ORDER BY t RANGE BETWEEN {60 * MINUTE_US - 1} PRECEDING AND CURRENT ROW)"


@query(
    sql(
        TRIPS,
        f"line AS (SELECT trip_id, probe, max(m) OVER {_HOUR} AS far FROM (SELECT store_id AS k, a_us AS t, trip_id, true AS probe, NULL::BIGINT AS m FROM trips UNION ALL SELECT store_id, d_us, trip_id, false, distance_m FROM trips WHERE d_us IS NOT NULL))",
        select="SELECT l.trip_id, coalesce(far, 0)::DOUBLE AS store_farthest_60m, (promised_minutes * 60)::DOUBLE AS promised_seconds FROM line l JOIN trips USING (trip_id) WHERE probe",
    )
)
def feat_custom(spark, sf_dir):
    """A catalogue of the user's own: an aggregate and a derived feature that are column functions."""
    own = (
        features.Trailing("store_farthest_60m", "store", 60, "custom", "farthest trip from the store", lambda: F.col("distance_m").cast("double"), F.max, lambda: F.lit(0.0)),
        features.Derived("promised_seconds", "the promise", lambda: (F.col("promised_minutes") * 60).cast("double")),
    )
    return features.historical(trips_of(spark, sf_dir), own).select("trip_id", "store_farthest_60m", "promised_seconds")


@query(
    sql(
        TRIPS,
        "d AS (SELECT driver_id, sum(tat)::DOUBLE / count(tat) AS mean, count(tat)::DOUBLE AS n FROM trips WHERE d_us IS NOT NULL GROUP BY 1)",
        f"s AS (SELECT store_id, sum(tat)::DOUBLE / count(tat) AS mean, quantile_cont({PACK}, 0.5) AS pack FROM trips WHERE d_us IS NOT NULL GROUP BY 1)",
        select=f"""SELECT trip_id, {DERIVED_SQL}, coalesce(round(s.pack, 6), 8.0::DOUBLE) AS store_pack_p50_60m, coalesce(round(d.mean, 6), 36.0::DOUBLE) AS driver_mean_tat_120m,
        coalesce(d.n, 0.0::DOUBLE) AS driver_trips_120m, coalesce(round(s.mean, 6), 36.0::DOUBLE) AS store_mean_tat_120m FROM trips LEFT JOIN d USING (driver_id) LEFT JOIN s USING (store_id)""",
    )
)
def feat_leaky_lifetime(spark, sf_dir):
    return rounded(features.leaky_lifetime(trips_of(spark, sf_dir)).select("trip_id", *features.FEATURE_NAMES))


_WIDE = f"(PARTITION BY k ORDER BY t RANGE BETWEEN {DAY * MINUTE_US - 1} PRECEDING AND CURRENT ROW)"


@query(
    sql(
        TRIPS,
        f"line AS (SELECT trip_id, probe, sum(tat) OVER {_WIDE} AS s, count(tat) OVER {_WIDE} AS n FROM (SELECT store_id AS k, a_us AS t, trip_id, true AS probe, NULL::DECIMAL(18,2) AS tat FROM trips UNION ALL SELECT store_id, d_us, trip_id, false, tat FROM trips WHERE d_us IS NOT NULL))",
        select="SELECT trip_id, round(s::DOUBLE / n, 6) AS store_mean_1d, n::DOUBLE AS store_trips_1d FROM line WHERE probe",
    )
)
def feat_wide_window(spark, sf_dir):
    """A day's window of a store, by differences of running totals."""
    trips = trips_of(spark, sf_dir)
    wide = (features.Trailing("store_mean_1d", "store", DAY, "mean"), features.Trailing("store_trips_1d", "store", DAY, "count"))
    return rounded(features.running(trips, trips, wide).select("trip_id", "store_mean_1d", "store_trips_1d"))


@query(
    """WITH trips AS (SELECT row_number() OVER () AS r, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trip_key, l_suppkey AS k, epoch_us(o_orderdate::TIMESTAMP) AS a_us, epoch_us(l_shipdate::TIMESTAMP) AS d_us,
        date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS tat FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate),
        line AS (SELECT *, sum(v) OVER w AS s, count(v) OVER w AS n FROM (SELECT r, trip_key, k, a_us AS t, NULL::BIGINT AS v FROM trips UNION ALL SELECT NULL, NULL, k, d_us, tat FROM trips)
        WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW))
        SELECT trip_key, round(s::DOUBLE / n, 6) AS store_mean_30d, n::DOUBLE AS store_trips_30d FROM line WHERE r IS NOT NULL"""
)
def feat_day_windows(spark, sf_dir):
    """30-day windows over trips by the day: ties, and trips that end as they begin and so see themselves."""
    trips = sources.from_orders(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    wide = (features.Trailing("store_mean_30d", "store", 30 * DAY, "mean"), features.Trailing("store_trips_30d", "store", 30 * DAY, "count"))
    seen = features.trailing(trips, trips, wide)
    return rounded(seen.select(F.substring_index("trip_id", "-", 4).alias("trip_key"), "store_mean_30d", "store_trips_30d"))


@query(
    sql(
        TRIPS,
        f"near AS (SELECT driver_id AS key, count(tat) AS n, sum(tat)::DOUBLE / count(tat) AS mean_tat, quantile_cont({PACK}, 0.5) AS pack_p50 FROM trips WHERE d_us > {AS_OF_US - 120 * MINUTE_US} AND d_us <= {AS_OF_US} GROUP BY 1)",
        select="SELECT key, n, round(mean_tat, 6) AS mean_tat, round(pack_p50, 6) AS pack_p50 FROM near",
    )
)
def feat_online_asof(spark, sf_dir):
    """What an online store answers for each driver at one instant."""
    return rounded(features.online(trips_of(spark, sf_dir), "driver", 120, AS_OF_US))


@query(
    sql(
        TRIPS,
        f"seen AS (SELECT driver_id, trip_id, d_us FROM trips WHERE d_us <= {AS_OF_US})",
        select=f"SELECT driver_id, count(DISTINCT trip_id) AS held FROM seen WHERE d_us > (SELECT max(d_us) FROM seen) - {1440 * MINUTE_US} GROUP BY 1",
    )
)
def feat_retention(spark, sf_dir):
    return features.retained(trips_of(spark, sf_dir), AS_OF_US)


@query(sql(TRIPS, line_sql("d", "driver_id"), line_sql("s", "store_id"), select="SELECT 'driver' AS entity, count(*) AS probes, count(*) FILTER (WHERE latest > t) AS leaks FROM d UNION ALL SELECT 'store', count(*), count(*) FILTER (WHERE latest > t) FROM s"))
def feat_leak_audit(spark, sf_dir):
    """No window holds a trip that was delivered after the probe."""
    return features.leak_audit(trips_of(spark, sf_dir))


@query(sql(TRIPS, line_sql("d", "driver_id", "a_us"), line_sql("s", "store_id", "a_us"), select="SELECT 'driver' AS entity, count(*) AS probes, count(*) FILTER (WHERE latest > t) AS leaks FROM d UNION ALL SELECT 'store', count(*), count(*) FILTER (WHERE latest > t) FROM s"))
def feat_leak_audit_leaky(spark, sf_dir):
    """The audit finds the leak of the in-flight variant."""
    return features.leak_audit(trips_of(spark, sf_dir), "a_us")

def member_sql(key: str, minutes: int) -> str:
    """Probes joined to the trips in their window, as p and h."""
    return f"trips p LEFT JOIN trips h ON h.{key} = p.{key} AND h.d_us IS NOT NULL AND h.d_us <= p.a_us AND h.d_us > p.a_us - {minutes * MINUTE_US}"


@query(sql(TRIPS, select=f"SELECT p.trip_id, count(h.trip_id) AS n, max(h.d_us) AS last_us, arg_max(h.trip_id, (h.d_us, h.trip_id)) AS last_id FROM {member_sql('driver_id', 1440)} GROUP BY p.trip_id HAVING count(h.trip_id) > 0"))
def feat_members(spark, sf_dir):
    """How many trips each window of a day holds, and which was delivered last."""
    trips = trips_of(spark, sf_dir)
    found = features.members(trips, trips, "driver", 1440).groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("member_us", "member_id")).alias("last"))
    return found.select("trip_id", "n", F.col("last.member_us").alias("last_us"), F.col("last.member_id").alias("last_id"))


@query(sql(TRIPS, select=f"SELECT p.trip_id, round(avg(CASE WHEN h.trip_id IS NOT NULL THEN (h.distance_m > p.distance_m)::INT::DOUBLE END), 6) AS farther FROM {member_sql('driver_id', 1440)} GROUP BY p.trip_id"))
def feat_seen_by_probe(spark, sf_dir):
    """An aggregate that sees its probe: the share of the window's trips that went farther."""
    farther = lambda m: F.when(F.size(m) > 0, F.size(F.filter(m, lambda d: d > F.col("distance_m"))) / F.size(m))
    own = (features.Trailing("farther", "driver", 1440, "custom", value=lambda: F.col("distance_m"), of_members=farther),)
    return rounded(features.historical(trips_of(spark, sf_dir), own, guarded=True).select("trip_id", "farther"))



# --- Training -------------------------------------------------------------------------------------------------


def split_trips(spark, sf_dir):
    return training.chronological(trips_of(spark, sf_dir))


@query(sql(TRIPS, SPLIT_SQL, select="SELECT trip_id, is_train FROM split"))
def split_chrono(spark, sf_dir):
    return split_trips(spark, sf_dir).select("trip_id", "is_train")


@query(sql(TRIPS, SPLIT_SQL, select="SELECT trip_id, a_us FROM split WHERE is_train"))
def split_semi(spark, sf_dir):
    """Training trips by membership."""
    train_ids = split_trips(spark, sf_dir).where("is_train").select("trip_id")
    return trips_of(spark, sf_dir).join(train_ids, "trip_id", "left_semi").select("trip_id", "a_us")


@query(sql(TRIPS, SPLIT_SQL, select="SELECT trip_id, a_us FROM split WHERE NOT is_train"))
def split_anti(spark, sf_dir):
    train_ids = split_trips(spark, sf_dir).where("is_train").select("trip_id")
    return trips_of(spark, sf_dir).join(train_ids, "trip_id", "left_anti").select("trip_id", "a_us")


@query(sql(TRIPS, SPLIT_SQL, select="SELECT min(a_us) AS first_us, max(a_us) AS last_us, count(*) AS n FROM split WHERE is_train"))
def train_window(spark, sf_dir):
    return split_trips(spark, sf_dir).where("is_train").agg(F.min("a_us").alias("first_us"), F.max("a_us").alias("last_us"), F.count(F.lit(1)).alias("n"))


def labelled(spark, sf_dir):
    trips = split_trips(spark, sf_dir)
    return features.historical(trips).where("tat is not null").select("trip_id", "is_train", *features.FEATURE_NAMES, F.col("tat").cast("double").alias("label"), F.col("promised_minutes").cast("double").alias("promised"))


@query(sql(TRIPS, features_sql(), select="SELECT feats.*, tat::DOUBLE AS label, promised_minutes::DOUBLE AS promised FROM feats JOIN trips USING (trip_id) WHERE tat IS NOT NULL"))
def train_dataset(spark, sf_dir):
    trips = trips_of(spark, sf_dir)
    return rounded(training.dataset(features.historical(trips), trips))


@query(sql(TRIPS, SPLIT_SQL, select="SELECT quantile_cont(promised_minutes::DOUBLE, 0.5) AS flat_minutes FROM split WHERE is_train AND tat IS NOT NULL"))
def base_fit(spark, sf_dir):
    rows = split_trips(spark, sf_dir).where("is_train AND tat IS NOT NULL")
    return rows.agg(F.percentile(F.col("promised_minutes").cast("double"), 0.5).alias("flat_minutes"))


_METRICS = """count(*) AS n, round(avg(err), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse, round({p50}(err, 0.5), 6) AS p50_error, round(quantile_disc(err, 0.9), 6) AS p90_error, round(avg((label > prediction)::INT::DOUBLE), 6) AS breach_rate"""


@query(sql(TRIPS, SPLIT_SQL, select=f"SELECT {_METRICS.format(p50='quantile_cont')} FROM (SELECT tat::DOUBLE AS label, 36.0::DOUBLE AS prediction, abs(36.0::DOUBLE - tat::DOUBLE) AS err FROM split WHERE NOT is_train AND tat IS NOT NULL)"))
def score_baseline(spark, sf_dir):
    trips = split_trips(spark, sf_dir).where("tat IS NOT NULL").select("is_train", F.col("tat").cast("double").alias("label"), F.col("promised_minutes").cast("double").alias("promised"))
    model = training.Baseline.fit(trips.where("is_train"))
    return rounded(training.metrics(trips.where("not is_train").withColumn("prediction", model.predict())))


#: A model of fixed weights, for predictions that SQL can repeat.
FIXED = training.Ridge(features.FEATURE_NAMES, (0.5, -0.25, 0.125, 1.0, -0.5, 2.0, 3.5, -1.5, 0.75), 60.0, (5000.0, 8.0, 12.0, 0.2, 3.0, 40.0, 60.0, 1.0, 60.0), (3000.0, 1.0, 7.0, 0.4, 2.0, 30.0, 40.0, 2.0, 25.0))
_FIXED_SQL = "greatest(1.0::DOUBLE, 60.0::DOUBLE" + "".join(f" + {w}::DOUBLE * (({n} - {m}::DOUBLE) / {s}::DOUBLE)" for n, w, m, s in zip(FIXED.feature_names, FIXED.weights, FIXED.means, FIXED.scales, strict=True)) + ")"


@query(sql(TRIPS, RAW_FEATURES, select=f"SELECT trip_id, round({_FIXED_SQL}, 5) AS pred_minutes FROM feats"))
def ridge_predict(spark, sf_dir):
    return rounded(features.historical(trips_of(spark, sf_dir)).select("trip_id", FIXED.predict().alias("pred_minutes")), 5)


@query(
    sql(
        TRIPS,
        SPLIT_SQL,
        RAW_FEATURES,
        f"scored AS (SELECT tat::DOUBLE AS label, {_FIXED_SQL.replace('distance_m', 'feats.distance_m')} AS prediction FROM feats JOIN split USING (trip_id) WHERE NOT is_train AND tat IS NOT NULL)",
        select=f"SELECT {_METRICS.format(p50='quantile_cont').replace(', 6)', ', 5)')} FROM (SELECT *, abs(prediction - label) AS err FROM scored)",
    )
)
def score_ridge(spark, sf_dir):
    rows = labelled(spark, sf_dir).where("not is_train").withColumn("prediction", FIXED.predict())
    return rounded(training.metrics(rows), 5)


@query(
    sql(
        TRIPS,
        SPLIT_SQL,
        RAW_FEATURES,
        "used AS (SELECT feats.* FROM feats JOIN split USING (trip_id) WHERE is_train AND tat IS NOT NULL)",
        select=" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS scale FROM used" for c in features.FEATURE_NAMES),
    )
)
def ridge_moments(spark, sf_dir):
    eq = training.normal_equations(labelled(spark, sf_dir).where("is_train"), features.FEATURE_NAMES)
    rows = [(c, float(m), float(v)) for c, m, v in zip(features.FEATURE_NAMES, eq.means, eq.scales, strict=True)]
    return rounded(spark.createDataFrame(rows, "feature string, mean double, scale double"))


_PAIRS = [(i, j) for i in range(9) for j in range(i, 9)]


@query(
    sql(
        TRIPS,
        SPLIT_SQL,
        RAW_FEATURES,
        "used AS (SELECT feats.*, tat::DOUBLE AS label FROM feats JOIN split USING (trip_id) WHERE is_train AND tat IS NOT NULL)",
        select=" UNION ALL ".join(
            [f"SELECT 'g_{i}_{j}' AS cell, round(count(*) * covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) + {RIDGE_ALPHA if i == j else 0.0}::DOUBLE, 4) AS value FROM used" for i, j in _PAIRS for a, b in [(features.FEATURE_NAMES[i], features.FEATURE_NAMES[j])]]
            + [f"SELECT 'b_{i}', round(count(*) * covar_pop({a}, label) / stddev_pop({a}), 4) FROM used" for i, a in enumerate(features.FEATURE_NAMES)]
            + ["SELECT 'mean_label', round(avg(label), 4) FROM used"]
        ),
    )
)
def ridge_gram(spark, sf_dir):
    """The normal equations of the honest model, a row for each cell."""
    eq = training.normal_equations(labelled(spark, sf_dir).where("is_train"), features.FEATURE_NAMES)
    cells = [(f"g_{i}_{j}", float(eq.gram[i, j])) for i, j in _PAIRS] + [(f"b_{i}", float(x)) for i, x in enumerate(eq.right)] + [("mean_label", eq.mean_label)]
    return rounded(spark.createDataFrame(cells, "cell string, value double"), 4)


@query()
def ridge_weights(spark, sf_dir):
    """The fitted weights; SQL has no solver."""
    model = training.Ridge.fit(labelled(spark, sf_dir).where("is_train"))
    rows = [*zip(model.feature_names, model.weights, strict=True), ("intercept", model.intercept)]
    return rounded(spark.createDataFrame(rows, "feature string, weight double"))


@query()
def train_comparison(spark, sf_dir):
    """Held-out scores of the flat promise, the honest model and both leaky ones."""
    return rounded(train(trips_of(spark, sf_dir)).metrics)


@query()
def train_gaps(spark, sf_dir):
    return rounded(train(trips_of(spark, sf_dir)).gaps())


# --- Serving --------------------------------------------------------------------------------------------------


@query(sql(TRIPS, RAW_FEATURES, select=f"SELECT feats.trip_id, round({_FIXED_SQL.replace('distance_m', 'feats.distance_m')}, 5) AS pred_minutes, 'fixed' AS model_version, 'control' AS variant, a_us AS served_us, false AS fallback FROM feats JOIN trips USING (trip_id)"))
def srv_predict(spark, sf_dir):
    served = serving.predict(features.historical(trips_of(spark, sf_dir)), FIXED.predict(), features.FEATURE_NAMES, "fixed")
    return rounded(served.drop("fallback_reason"), 5)


@query(
    sql(
        TRIPS,
        select="""SELECT trip_id, CASE WHEN trip_id % 5 = 4 AND trip_id % 3 <> 0 THEN 25.5::DOUBLE ELSE 36.0::DOUBLE END AS pred_minutes, NOT (trip_id % 5 = 4 AND trip_id % 3 <> 0) AS fallback,
        CASE WHEN trip_id % 3 = 0 THEN 'features: missing driver_trips_120m' WHEN trip_id % 5 = 0 THEN 'model: no estimate' WHEN trip_id % 5 = 1 THEN 'model returned -3.0'
        WHEN trip_id % 5 = 2 THEN 'model returned NaN' WHEN trip_id % 5 = 3 THEN 'model returned Infinity' ELSE '' END AS fallback_reason FROM trips""",
    )
)
def srv_fallback(spark, sf_dir):
    """Each way of having no estimate, and the reason given."""
    trips = trips_of(spark, sf_dir).withColumn("driver_trips_120m", F.when(F.col("trip_id") % 3 != 0, 1.0))
    kind = F.col("trip_id") % 5
    raw = F.when(kind == 1, -3.0).when(kind == 2, float("nan")).when(kind == 3, float("inf")).when(kind == 4, 25.5)
    return serving.predict(trips, raw, ("driver_trips_120m",), "v").select("trip_id", "pred_minutes", "fallback", "fallback_reason")


@query(sql(TRIPS, select="SELECT trip_id, CASE WHEN tat IS NULL THEN 'no duration yet' ELSE 'unobserved' END AS fate FROM trips"))
def srv_observe(spark, sf_dir):
    """Trips handed back where there is no store to tell."""
    out = serving.observe(trips_of(spark, sf_dir))
    return out.unobserved.select("trip_id", F.lit("unobserved").alias("fate")).unionByName(out.refused.select("trip_id", F.col("reason").alias("fate")))


def request_log(spark, sf_dir):
    """The prediction log with a latency for each request."""
    return sources.predictions_of(trips_of(spark, sf_dir)).withColumn("ms", F.when(F.col("trip_id") % 20 == 0, 2000.0).otherwise(10.0) + (F.col("trip_id") % 13).cast("double"))


_LOG = "log AS (SELECT *, CASE WHEN trip_id % 20 = 0 THEN 2000.0::DOUBLE ELSE 10.0::DOUBLE END + (trip_id % 13) AS ms FROM predictions)"
_LATENCY = "round(quantile_disc(ms, 0.5), 6) AS p50_ms, round(quantile_disc(ms, 0.99), 6) AS p99_ms, max(ms) AS max_ms, round(avg(ms), 6) AS mean_ms"


@query(sql(TRIPS, PREDICTIONS, _LOG, select=f"SELECT count(ms) AS n, {_LATENCY} FROM log"))
def srv_latency(spark, sf_dir):
    return rounded(serving.latency(request_log(spark, sf_dir)))


@query(sql(TRIPS, PREDICTIONS, select="SELECT model_version, round(avg(fallback::INT::DOUBLE), 6) AS fallback_rate FROM predictions GROUP BY 1"))
def srv_fallback_rate(spark, sf_dir):
    return rounded(request_log(spark, sf_dir).groupBy("model_version").agg(serving.fallback_rate().alias("fallback_rate")))


@query(sql(TRIPS, PREDICTIONS, _LOG, select=f"SELECT count(model_version) > 0 AS ok, arg_max(model_version, served_us) AS model_version, count(*) AS requests, count(*) FILTER (WHERE fallback) AS fallbacks, round(avg(fallback::INT::DOUBLE), 6) AS fallback_rate, {_LATENCY} FROM log"))
def srv_health(spark, sf_dir):
    return rounded(serving.health(request_log(spark, sf_dir)))


@query(sql(TRIPS, features_sql(), select="SELECT * FROM feats"))
def srv_store_asked(spark, sf_dir):
    """The store is told of trips in parts, and asked for every trip: the features are the batch's."""
    trips, store = trips_of(spark, sf_dir), TripStore(spark, folder_of(spark, "store"), buckets=4, days=7)
    for part in range(3):
        store.tell(trips.where(F.col("trip_id") % 3 == part), f"part-{part}")
    return rounded(store.ask(trips).select("trip_id", *features.FEATURE_NAMES))


@query(sql(TRIPS, RAW_FEATURES, select=f"SELECT feats.trip_id, round({_FIXED_SQL.replace('distance_m', 'feats.distance_m')}, 5) AS pred_minutes, 'fixed' AS model_version, 'control' AS variant, a_us AS served_us, false AS fallback FROM feats JOIN trips USING (trip_id)"))
def srv_stream_predict(spark, sf_dir):
    """Every trip as a request on a stream, scored from the store: the log is that of the batch."""
    store, folder = TripStore(spark, folder_of(spark, "store"), buckets=4, days=7), folder_of(spark, "requests")
    store.tell(trips_of(spark, sf_dir), "all")
    run = score_requests(requests_of(stream_of(spark, sf_dir)), store, FIXED.predict(), "fixed", f"{folder}/log", f"{folder}/dead", f"{folder}/state")
    run.awaitTermination()
    served = spark.read.parquet(f"{folder}/log").drop("batch", "fallback_reason")
    return rounded(served.withColumn("trip_id", F.col("trip_id").cast("bigint")), 5)


def requests_of(trips: DataFrame) -> DataFrame:
    """Trips as the bodies of requests."""
    fields = (F.col("trip_id").cast("string").alias("trip_id"), F.col("store_id").cast("string").alias("store_id"), F.col("driver_id").cast("string").alias("driver_id"), F.col("assigned_at").cast("string").alias("assigned_at"), "distance_m", "promised_minutes")
    return trips.select(F.to_json(F.struct(*fields)).alias("body"))


# --- Monitoring -----------------------------------------------------------------------------------------------


def log_of(spark, sf_dir):
    """The prediction log with outcomes; of some labelled trips the delivery isn't known."""
    trips = trips_of(spark, sf_dir).withColumn("d_us", F.when(F.col("trip_id") % 13 != 1, F.col("d_us")))
    return monitoring.served(sources.predictions_of(trips), sources.outcomes_of(trips))


@query(sql(TRIPS, PREDICTIONS, select="SELECT trip_id, pred_minutes, served_us, model_version, variant, fallback, promised_minutes, actual_minutes, CASE WHEN actual_minutes IS NOT NULL THEN label_us END AS label_us FROM predictions"))
def mon_served(spark, sf_dir):
    return log_of(spark, sf_dir).select("trip_id", "pred_minutes", "served_us", "model_version", "variant", "fallback", "promised_minutes", "actual_minutes", "label_us")


@query(sql(TRIPS, PREDICTIONS, SEEN, select=f"SELECT as_of_us, {_METRICS.format(p50='quantile_disc')} FROM (SELECT as_of_us, err, actual_minutes AS label, pred_minutes AS prediction FROM seen WHERE known) GROUP BY 1"))
def mon_realised(spark, sf_dir):
    return rounded(monitoring.realised(log_of(spark, sf_dir), INSTANTS))


@query(sql(TRIPS, PREDICTIONS, SEEN, select="SELECT as_of_us, count(*) FILTER (WHERE NOT coalesce(known, false)) AS labels_pending, count(*) FILTER (WHERE NOT coalesce(known, false) AND served_us <= as_of_us) AS pending_served FROM seen GROUP BY 1"))
def mon_pending(spark, sf_dir):
    """Predictions without a label yet: of the whole log, and of those that had been served."""
    log = log_of(spark, sf_dir)
    served_only = monitoring.pending(log, INSTANTS, served_only=True).withColumnRenamed("labels_pending", "pending_served")
    return monitoring.pending(log, INSTANTS).join(served_only, "as_of_us")


@query(sql(TRIPS, PREDICTIONS, SEEN, select="SELECT as_of_us, round(quantile_cont((label_us - served_us) / 60000000::DOUBLE, 0.5) FILTER (WHERE known), 6) AS label_lag_minutes FROM seen GROUP BY 1"))
def mon_lag(spark, sf_dir):
    return rounded(monitoring.label_lag(log_of(spark, sf_dir), INSTANTS))


@query(sql(TRIPS, PREDICTIONS, SEEN, select="SELECT as_of_us, max(served_us) FILTER (WHERE known) AS scored_through_us, round((as_of_us - max(served_us) FILTER (WHERE known)) / 60000000::DOUBLE, 6) AS blind_minutes FROM seen GROUP BY 1"))
def mon_blind(spark, sf_dir):
    return rounded(monitoring.blind(log_of(spark, sf_dir), INSTANTS))


@query(sql(TRIPS, PREDICTIONS, SEEN, select=f"SELECT as_of_us, count(*) AS n FROM seen WHERE served_us > as_of_us - {60 * MINUTE_US} AND served_us <= as_of_us GROUP BY 1"))
def mon_window_filter(spark, sf_dir):
    return monitoring.in_window(log_of(spark, sf_dir), INSTANTS).groupBy("as_of_us").agg(F.count(F.lit(1)).alias("n"))


def psi_sql(values: str, by: str, name: str = "psi") -> str:
    """values: a CTE v of by, value and side (r or c)."""
    steps = ", ".join(f"{i / PSI_BINS}::DOUBLE" for i in range(1, PSI_BINS))
    by = by.strip()
    return sql(
        *([values] if isinstance(values, str) else values),
        f"e AS (SELECT {by}, list_sort(list_distinct(quantile_cont(value, [{steps}]))) AS edges FROM v WHERE side = 'r' GROUP BY ALL HAVING count(*) >= 2)",
        f"b AS (SELECT {by}, len(list_filter(edges, lambda x: x < value)) AS bin, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'c') AS c, len(edges) AS k FROM v JOIN e USING ({by}) GROUP BY ALL)",
        f"g AS (SELECT DISTINCT {by}, unnest(range(0, k + 1)) AS bin FROM b)",
        f"t AS (SELECT {by}, sum(r) AS nr, sum(c) AS nc FROM b GROUP BY ALL)",
        f"s AS (SELECT {by}, greatest(coalesce(r, 0) / nr::DOUBLE, 1e-6::DOUBLE) AS pr, greatest(coalesce(c, 0) / nc::DOUBLE, 1e-6::DOUBLE) AS pc FROM g JOIN t USING ({by}) LEFT JOIN b USING ({by}, bin) WHERE nc > 0)",
        select=f"SELECT {by}, round(sum((pc - pr) * ln(pc / pr)), 6) AS {name} FROM s GROUP BY {by}",
    )


MID_US = us("2024-01-15T00:00:00")
_SIDE = f"CASE WHEN a_us < {MID_US} THEN 'r' ELSE 'c' END AS side"


@query(psi_sql((TRIPS, f"v AS (SELECT store_id, tat::DOUBLE AS value, {_SIDE} FROM trips WHERE tat IS NOT NULL)"), "store_id"))
def mon_psi(spark, sf_dir):
    """Stability of the time taken in each store, later trips against earlier ones."""
    values = trips_of(spark, sf_dir).where("tat is not null").select("store_id", "a_us", F.col("tat").cast("double").alias("value"))
    return rounded(drift.psi(values.where(F.col("a_us") < MID_US), values.where(F.col("a_us") >= MID_US), ["store_id"]))


@query(
    psi_sql(
        (TRIPS, RAW_FEATURES, "wide AS (SELECT feats.*, " + _SIDE + " FROM feats JOIN trips USING (trip_id))", "v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, side FROM wide" for c in features.FEATURE_NAMES) + ")"),
        "feature",
    )
)
def mon_feature_psi(spark, sf_dir):
    """Stability of all features in one job."""
    wide = features.historical(trips_of(spark, sf_dir)).select("trip_id", "a_us", *features.FEATURE_NAMES).persist()
    return rounded(drift.feature_drift(wide.where(F.col("a_us") < MID_US).drop("a_us"), wide.where(F.col("a_us") >= MID_US).drop("a_us")))


_PRED_PSI = (
    TRIPS,
    PREDICTIONS,
    f"""v AS (SELECT as_of_us, pred_minutes AS value, 'c' AS side FROM (SELECT *, count(*) OVER (PARTITION BY as_of_us) AS m FROM (SELECT g.as_of_us, pred_minutes FROM predictions, (SELECT unnest([{", ".join(map(str, INSTANTS))}]) AS as_of_us) g
        WHERE served_us > g.as_of_us - {DAY * MINUTE_US} AND served_us <= g.as_of_us)) WHERE m >= 2
        UNION ALL SELECT g.as_of_us, pred_minutes, 'r' FROM predictions, (SELECT unnest([{", ".join(map(str, INSTANTS))}]) AS as_of_us) g WHERE served_us < {MID_US})""",
)


@query(psi_sql(_PRED_PSI, "as_of_us"))
def mon_pred_psi(spark, sf_dir):
    """Stability of predictions in the day before each instant."""
    log = log_of(spark, sf_dir)
    return rounded(monitoring.prediction_drift(log, log.where(F.col("served_us") < MID_US), INSTANTS, DAY))




def windows_sql(instants: list[int], minutes: int) -> str:
    """Vectors v of as_of_us, feature, value and side: current ones of each instant's window that holds two, reference ones before MID_US."""
    names = ", ".join(features.FEATURE_NAMES)
    grid = f"(SELECT unnest([{', '.join(map(str, instants))}]) AS as_of_us) g"
    return f"""wide AS (SELECT feats.*, a_us FROM feats JOIN trips USING (trip_id)),
        now AS (SELECT * FROM (SELECT g.as_of_us, {names}, count(*) OVER (PARTITION BY as_of_us) AS m FROM wide, {grid} WHERE a_us > as_of_us - {minutes * MINUTE_US} AND a_us <= as_of_us) WHERE m >= 2),
        v AS (""" + " UNION ALL ".join(f"SELECT as_of_us, '{c}' AS feature, {c} AS value, 'c' AS side FROM now UNION ALL SELECT as_of_us, '{c}', {c}, 'r' FROM wide, {grid} WHERE a_us < {MID_US}" for c in features.FEATURE_NAMES) + ")"


_FEATURE_PSI = (TRIPS, RAW_FEATURES, windows_sql(INSTANTS, DAY))


def vectors_of(spark, sf_dir):
    """Vectors, kept: monitoring reads them more than once."""
    return features.vectors(features.historical(trips_of(spark, sf_dir))).persist()


@query(psi_sql(_FEATURE_PSI, "as_of_us, feature"))
def mon_feature_drift(spark, sf_dir):
    """Stability of each feature in the day before each instant."""
    vectors = vectors_of(spark, sf_dir)
    return rounded(monitoring.feature_drift(vectors, vectors.where(F.col("a_us") < MID_US), INSTANTS, DAY))


@query("SELECT * FROM (VALUES ('driver_trips_120m')) t(feature)")
def mon_missing(spark, sf_dir):
    """Features that the reference's vectors have and current ones lack."""
    vectors = vectors_of(spark, sf_dir)
    now = vectors.where(F.col("a_us") >= MID_US).withColumn("values", F.map_filter("values", lambda k, v: k != "driver_trips_120m"))
    return drift.missing_keys(vectors.where(F.col("a_us") < MID_US), now)


#: An instant before any label, besides the others.
EARLY_US = us("2023-12-01T00:00:00")


@query(
    sql(
        TRIPS,
        PREDICTIONS,
        SEEN.replace("unnest([", f"unnest([{EARLY_US}, "),
        "drift AS (" + psi_sql(_PRED_PSI, "as_of_us", "prediction_psi") + ")",
        "features_now AS (" + psi_sql(_FEATURE_PSI, "as_of_us, feature") + ")",
        "joined AS (SELECT as_of_us, string_agg(printf('%s=%.3f', feature, psi), ',' ORDER BY feature) AS feature_psi FROM features_now GROUP BY 1)",
        """h AS (SELECT as_of_us, count(*) AS n_served, round(avg(fallback::INT::DOUBLE), 6) AS fallback_rate, count(*) FILTER (WHERE NOT coalesce(known, false)) AS labels_pending,
        coalesce(round(quantile_cont((label_us - served_us) / 60000000::DOUBLE, 0.5) FILTER (WHERE known), 6), 'NaN'::DOUBLE) AS label_lag_minutes, max(served_us) FILTER (WHERE known) AS scored_through_us,
        count(*) FILTER (WHERE known) AS realised_n, round(avg(err) FILTER (WHERE known), 6) AS realised_mae, round(sqrt(avg(err * err) FILTER (WHERE known)), 6) AS realised_rmse,
        round(quantile_disc(err, 0.5) FILTER (WHERE known), 6) AS realised_p50_error, round(quantile_disc(err, 0.9) FILTER (WHERE known), 6) AS realised_p90_error,
        round(avg((actual_minutes > pred_minutes)::INT::DOUBLE) FILTER (WHERE known), 6) AS realised_breach_rate,
        coalesce(round((as_of_us - max(served_us) FILTER (WHERE known)) / 60000000::DOUBLE, 6), 'inf'::DOUBLE) AS blind_minutes FROM seen GROUP BY 1)""",
        select="SELECT h.*, prediction_psi, coalesce(feature_psi, '') AS feature_psi, '' AS missing_features FROM h LEFT JOIN drift USING (as_of_us) LEFT JOIN joined USING (as_of_us)",
    )
)
def mon_health(spark, sf_dir):
    """A row of everything for each instant: also one before any label, where there is no lag and blindness has no end."""
    log, vectors = log_of(spark, sf_dir).persist(), vectors_of(spark, sf_dir)
    out = monitoring.health(log, log.where(F.col("served_us") < MID_US), [EARLY_US, *INSTANTS], DAY, vectors, vectors.where(F.col("a_us") < MID_US))
    each = F.transform(F.sort_array(F.map_entries("feature_psi")), lambda e: F.format_string("%s=%.3f", e["key"], e["value"]))
    return rounded(out.withColumns({"feature_psi": F.array_join(each, ","), "missing_features": F.array_join("missing_features", ",")}))


@query(
    sql(
        TRIPS,
        PREDICTIONS,
        SEEN,
        f"broken AS (SELECT as_of_us, count(*) FILTER (WHERE known) AS scored, avg(abs(CASE WHEN served_us >= {SWITCH_US} AND NOT fallback THEN pred_minutes / 2 ELSE pred_minutes END - actual_minutes)) FILTER (WHERE known) AS healthy, avg(err) FILTER (WHERE known) AS bad, count(*) FILTER (WHERE NOT coalesce(known, false)) AS labels_pending FROM seen GROUP BY 1)",
        select="SELECT as_of_us, scored, round(healthy, 6) AS mae_healthy, round(bad, 6) AS mae_broken, labels_pending, CASE WHEN abs(healthy - bad) < 1e-9 THEN 'identical' ELSE 'diverged' END AS verdict FROM broken",
    )
)
def mon_blind_window(spark, sf_dir):
    """A broken model against a healthy one: they can't be told apart until labels of broken predictions arrive."""
    broken = log_of(spark, sf_dir)
    wrong = (F.col("served_us") >= SWITCH_US) & ~F.col("fallback")
    healthy = broken.withColumn("pred_minutes", F.when(wrong, F.col("pred_minutes") / 2).otherwise(F.col("pred_minutes")))
    return rounded(monitoring.outage(healthy, broken, INSTANTS))


# --- Experiment -----------------------------------------------------------------------------------------------


def outcomes(spark, sf_dir):
    trips = trips_of(spark, sf_dir)
    rows = trips.where("tat is not null").select("trip_id", F.col("driver_id").cast("string").alias("entity_id"), F.col("tat").cast("double").alias("tat"))
    log = sources.predictions_of(trips).select("trip_id", "pred_minutes", "fallback")
    return rows.join(log, "trip_id").select("entity_id", F.abs(F.col("pred_minutes") - F.col("tat")).alias("error"), "fallback")


def entities(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity_id")).distinct()


_ENTITIES = "ids AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id FROM events)"


@query(sql(_ENTITIES, select=f"SELECT entity_id, round({BUCKET}, 9) AS bucket FROM ids"))
def exp_bucket(spark, sf_dir):
    return entities(spark, sf_dir).select("entity_id", F.round(bucket(F.col("entity_id"), SALT), 9).alias("bucket"))


@query(sql(_ENTITIES, select=f"SELECT entity_id, {ARM} AS arm FROM ids"))
def exp_assign(spark, sf_dir):
    return entities(spark, sf_dir).select("entity_id", experiment.assign(F.col("entity_id"), SPLIT, SALT).alias("arm"))


@query(sql(_ENTITIES, select=f"SELECT round(avg(({ARM} = 'treatment')::INT::DOUBLE), 6) AS treatment_share FROM ids"))
def exp_split(spark, sf_dir):
    return rounded(experiment.split_observed(entities(spark, sf_dir), SPLIT, SALT))


@query(sql(TRIPS, PREDICTIONS, OUTCOMES, ARMS, select="SELECT arm, n, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 6) AS variance, round(fallback_rate, 6) AS fallback_rate FROM arms"))
def exp_arms(spark, sf_dir):
    return rounded(experiment.arms(outcomes(spark, sf_dir), SPLIT, SALT))


def pooled(spark, sf_dir):
    return experiment.side_by_side(experiment.arms(outcomes(spark, sf_dir), SPLIT, SALT)).withColumn("pooled_std", experiment.pooled_std())


@query(sql(TRIPS, PREDICTIONS, OUTCOMES, ARMS, select="SELECT round(pooled_std, 6) AS pooled_std FROM pooled"))
def exp_pooled(spark, sf_dir):
    return rounded(pooled(spark, sf_dir).select("pooled_std"))


@query(sql(TRIPS, PREDICTIONS, OUTCOMES, ARMS, select=f"SELECT round({Z!r}::DOUBLE * pooled_std * sqrt(1 / c_n::DOUBLE + 1 / t_n::DOUBLE), 6) AS mde FROM pooled"))
def exp_mde(spark, sf_dir):
    return rounded(pooled(spark, sf_dir).select(experiment.detectable().alias("mde")))


@query(sql(TRIPS, PREDICTIONS, OUTCOMES, ARMS, select=f"SELECT CAST(ceil(2 * {Z!r}::DOUBLE * {Z!r}::DOUBLE * pooled_std * pooled_std) AS BIGINT) AS per_arm FROM pooled"))
def exp_sample_size(spark, sf_dir):
    return pooled(spark, sf_dir).select(experiment.needed(1.0).alias("per_arm"))


_TIGHT = experiment.Guardrail(max_fallback_rate=0.01, max_error_ratio=0.5)


@query(
    sql(
        TRIPS,
        PREDICTIONS,
        OUTCOMES,
        ARMS,
        select="""SELECT printf('treatment falls back on %.1f%% of trips, more than 1.0%%', t_fallback * 100) AS reason FROM pooled WHERE t_fallback > 0.01
        UNION ALL SELECT printf('treatment''s error is %.2f times control''s, more than 0.50', t_mean / c_mean) FROM pooled WHERE t_mean / c_mean > 0.5""",
    )
)
def exp_guardrail(spark, sf_dir):
    """Reasons to stop under limits that this data breaks."""
    return pooled(spark, sf_dir).select(F.explode(experiment.breaches(_TIGHT)).alias("reason"))


@query(
    sql(
        TRIPS,
        PREDICTIONS,
        OUTCOMES,
        ARMS,
        f"m AS (SELECT *, c_mean - t_mean AS effect, {Z!r}::DOUBLE * pooled_std * sqrt(1 / c_n::DOUBLE + 1 / t_n::DOUBLE) AS mde, t_fallback > 0.5 OR t_mean / c_mean > 1.5 AS stop FROM pooled)",
        select="""SELECT 'eta-v2' AS name, 0.5::DOUBLE AS split, c_n AS n_control, t_n AS n_treatment, round(c_mean, 6) AS mean_control, round(t_mean, 6) AS mean_treatment, round(effect, 6) AS effect, round(mde, 6) AS mde,
        round(pooled_std, 6) AS pooled_std, abs(effect) >= mde AS conclusive, stop AS should_stop,
        (CASE WHEN abs(effect) < mde THEN 'inconclusive: an effect of ' WHEN effect > 0 THEN 'treatment wins by ' ELSE 'control wins by ' END) || printf('%.2f minutes, detectable from %.2f', abs(effect), mde) AS verdict FROM m""",
    )
)
def exp_analyse(spark, sf_dir):
    loose = experiment.Guardrail(max_fallback_rate=0.5, max_error_ratio=1.5)
    return rounded(experiment.analyse(outcomes(spark, sf_dir), SALT, SPLIT, guardrail=loose).drop("breaches"))


# --- Streams --------------------------------------------------------------------------------------------------


def stream_of(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return sources.from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def folder_of(spark: SparkSession, name: str) -> str:
    """A new folder in the session's checkpoint folder. Only a local session may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise TidemarkError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid4().hex}"


def played(stream: DataFrame) -> DataFrame:
    """A stream run to its end into Parquet, and that read back."""
    spark = stream.sparkSession
    folder = folder_of(spark, "stream")
    name, provider = PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)  # read when the stream starts
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    spark.conf.set(name, before)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_MARK = f"mark AS (SELECT (greatest(max(a_us), max(d_us)) // 1000) * 1000 - {120 * MINUTE_US} AS wm FROM trips)"


@query(
    sql(
        TRIPS,
        line_sql("line", "driver_id"),
        _MARK,
        select="SELECT CAST(trip_id AS VARCHAR) AS trip_id, t, round(sum_120::DOUBLE / n_120, 6) AS driver_mean_tat_120m, n_120::DOUBLE AS driver_trips_120m FROM line, mark WHERE t < wm",
    )
)
def stream_driver_features(spark, sf_dir):
    """The stateful stream's answers, for probes that its watermark has passed, equal the batch features."""
    own = tuple(f for f in features.TRAILING if f.entity == "driver")
    return rounded(played(online_features(stream_of(spark, sf_dir), own)))


@query(
    sql(
        TRIPS,
        line_sql("line", "store_id"),
        _MARK,
        select="SELECT CAST(trip_id AS VARCHAR) AS trip_id, t, round(p50_60, 6) AS store_pack_p50_60m, round(sum_120::DOUBLE / n_120, 6) AS store_mean_tat_120m FROM line, mark WHERE t < wm",
    )
)
def stream_store_features(spark, sf_dir):
    """The same for stores, whose windows hold hundreds of trips, with their medians."""
    own = tuple(f for f in features.TRAILING if f.entity == "store")
    return rounded(played(online_features(stream_of(spark, sf_dir), own)))


_SETTLED_MINUTES = (1 + 24) * 60 + 1  # what may be late, the bound, and one more


@query(
    sql(
        TRIPS,
        PREDICTIONS,
        f"mark AS (SELECT least(max(a_us), max(coalesce(d_us, a_us + CAST(tat * 60000000 AS BIGINT))) FILTER (WHERE tat IS NOT NULL)) - {_SETTLED_MINUTES * MINUTE_US} AS us FROM trips)",
        select="SELECT p.trip_id, pred_minutes, served_us, model_version, variant, fallback, p.promised_minutes, tat::DOUBLE AS actual_minutes FROM predictions p JOIN trips USING (trip_id), mark WHERE served_us < us",
    )
)
def stream_labels(spark, sf_dir):
    """Predictions of the stream that are settled, those without a label included: their outcome came, or can't come any more."""
    predictions, outcomes_ = sources.predictions_of(stream_of(spark, sf_dir)), sources.outcomes_of(stream_of(spark, sf_dir))
    found = played(labelled_stream(predictions, outcomes_, how="left")).drop("served_at", "delivered_at")
    trips = trips_of(spark, sf_dir)
    served, delivered = trips.agg(F.max("a_us")).scalar(), sources.outcomes_of(trips).agg(F.max("delivered_us")).scalar()
    return found.where(F.col("served_us") < F.least(served, delivered) - _SETTLED_MINUTES * MINUTE_US)


_EVERY, _PSI_LATE = 20, 10
_EDGES = ", ".join(f"{i / PSI_BINS}::DOUBLE" for i in range(1, PSI_BINS))
_PANE_US = _EVERY * MINUTE_US


@query(
    sql(
        TRIPS,
        PREDICTIONS,
        f"mark AS (SELECT ((max(served_us) - 1) // 1000) * 1000 - {_PSI_LATE * MINUTE_US} AS wm FROM predictions)",
        f"e AS (SELECT list_sort(list_distinct(quantile_cont(pred_minutes, [{_EDGES}]))) AS edges FROM predictions WHERE served_us < {MID_US})",
        "binned AS (SELECT served_us, len(list_filter(edges, lambda x: x < pred_minutes)) AS bin FROM predictions, e)",
        f"r AS (SELECT bin, count(*) AS n FROM binned WHERE served_us < {MID_US} GROUP BY 1)",
        f"""panes AS (SELECT ((served_us - 1) // {_PANE_US} + 1) * {_PANE_US} AS pane_us, bin, count(*) AS n FROM binned GROUP BY ALL)""",
        f"""c AS (SELECT as_of_us, bin, CAST(sum(n) AS BIGINT) AS n FROM (SELECT pane_us + unnest(range(0, {DAY // _EVERY})) * {_PANE_US} AS as_of_us, bin, n FROM panes), mark WHERE as_of_us <= wm GROUP BY ALL)""",
        "total AS (SELECT as_of_us, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1 HAVING sum(n) >= 2)",
        "g AS (SELECT as_of_us, n, unnest(range(0, (SELECT len(edges) FROM e) + 1)) AS bin FROM total)",
        """s AS (SELECT as_of_us, g.n, greatest(coalesce(r.n, 0) / (SELECT sum(n) FROM r)::DOUBLE, 1e-6::DOUBLE) AS pr, greatest(coalesce(c.n, 0) / g.n::DOUBLE, 1e-6::DOUBLE) AS pc
        FROM g LEFT JOIN r USING (bin) LEFT JOIN c USING (as_of_us, bin))""",
        select="SELECT as_of_us, n, round(sum((pc - pr) * ln(pc / pr)), 6) AS psi FROM s GROUP BY as_of_us, n",
    )
)
def stream_pred_psi(spark, sf_dir):
    """Stability of predictions in the day before each closed instant, twenty minutes apart, counted as they are served."""
    value = F.col("pred_minutes").alias("value")
    served = sources.predictions_of(trips_of(spark, sf_dir)).where(F.col("served_us") < MID_US)
    stream = sources.predictions_of(stream_of(spark, sf_dir)).select(F.col("served_us").alias("at_us"), value)
    reference = drift.profile(served.select(value, F.lit("all").alias("of")), ["of"])
    return rounded(played(sliding_psi(stream, reference, minutes=DAY, every=_EVERY, late=f"{_PSI_LATE} minutes")))
