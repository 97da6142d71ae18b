"""The store of finished trips as a table that can be told and asked: laid out by entity, bucket of keys and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import MINUTE_US
from tidemark.operators.features import CATALOGUE, ENTITY_COLUMN, Trailing, _warm, entity_column, instant, trailing, trailing_of
from tidemark.sources.trips import finished

DAY_US = 1440 * MINUTE_US
PARTS = ("part_entity", "part_bucket", "part_day", "part_batch")


class TripStore:
    """A folder of Parquet files, each with the trips of some keys that were delivered on one day (or so many days).

    What is told is there for whoever asks next. A batch that is told again replaces itself, so a job or stream that
    starts over leaves no trip twice. Asks are batches, too: the days and buckets that they can need are looked up in
    the layout, so that other files aren't opened; the rest is the as-of join that ``historical`` is made of. Keys are
    kept as text.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, days: int = 1):
        self.spark, self.path, self.buckets, self.width = spark, path, buckets, days * DAY_US

    def _bucket(self, key: str) -> F.Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _keys(self, trips: DataFrame) -> DataFrame:
        return trips.withColumns({c: F.col(c).cast("string") for c in ENTITY_COLUMN.values()})

    def tell(self, trips: DataFrame, batch: str) -> None:
        """Appends the finished ones of trips under the batch's name."""
        parts = F.array(*(F.struct(F.lit(e).alias("part_entity"), self._bucket(c).alias("part_bucket")) for e, c in ENTITY_COLUMN.items()))
        rows = self._keys(finished(trips)).select("*", F.inline(parts)).withColumns({"part_day": F.floor(F.col("d_us") / self.width).cast("int"), "part_batch": F.lit(batch)})
        placed = rows.repartition("part_entity", "part_bucket", "part_day").sortWithinPartitions(*PARTS, "d_us")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(self.path)

    def _there(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def history(self, probes: DataFrame, entity: str, minutes: int) -> DataFrame:
        """The trips that windows of that width can hold for some probes: of their buckets, and delivered on their days."""
        at = instant(probes)
        low, high, buckets = probes.agg(F.min(at), F.max(at), F.collect_set(self._bucket(entity_column(entity)))).first()  # no more than there are buckets
        if low is None or not self._there():
            return finished(self._keys(probes)).limit(0)
        days = F.col("part_day").between((low - minutes * MINUTE_US) // self.width, high // self.width)
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        return rows.where((F.col("part_entity") == entity) & F.col("part_bucket").isin(buckets) & days).drop(*PARTS)

    def ask(self, probes: DataFrame, features: tuple[Trailing, ...] = CATALOGUE) -> DataFrame:
        """Every probe with all features of a catalogue, as of its assignment (or as_of_us) and of what was told so far."""
        out = self._keys(probes)
        for entity, own in trailing_of(features).items():
            out = trailing(out, self.history(out, entity, max(f.window_minutes for f in own)), own)
        return _warm(out, features)
