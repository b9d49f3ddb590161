"""Per-period aggregates corrected while late records arrive, until a cut-off (problem 1).

A period (an hour of device time) is published some minutes after its end and closed some
hours after its end. Each batch of arrivals is appended to the retained raw events; the
periods it touches are recomputed entirely from the raw events, and the result replaces
the periods' earlier versions in one step. Nothing is updated in place: a version is a
set of files in folders of its writer's own, and it counts only once its commit marker exists and names them, so a
reader sees a batch's corrections all at once or not at all, a batch that failed half-way leaves no
trace, and of two writers of one version one fails. Records past the cut-off never change a period; they are tallied apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.session import create_file, fresh_path, micros, read_file, staged

PERIOD_S, PUBLISH_S, CLOSE_S = 3600, 300, 7200
RAW = "van_id string, event_us bigint, arrival_us bigint, speed_kmh double, battery_pct int"
AGGREGATES = (
    "van_id string, period_start bigint, first_pings bigint, first_avg_speed double, first_max_speed double, first_min_battery int, "
    "pings bigint, avg_speed double, max_speed double, min_battery int, late_pings bigint, last_arrival_us bigint"
)
CHANGES = "van_id string, period_start bigint, day int, taken_pings bigint, cut_pings bigint"


class PeriodTable:
    """A versioned table of per-van, per-period aggregates with a cut-off for lateness.

    Layout under ``path``: ``raw/v=K/by=A/day=D``, ``changes/v=K/by=A`` (what a batch brought to each van's periods),
    ``periods/v=K/by=A``, ``commits/K`` (which attempt A it was). Raw events are stored by day, so that a batch re-reads
    only the days it touches.
    """

    def __init__(self, spark: SparkSession, path: str, period_s: int = PERIOD_S, publish_s: int = PUBLISH_S, close_s: int = CLOSE_S):
        self.spark, self.path = spark, path
        self.period_s, self.publish_s, self.close_s = period_s, publish_s, close_s
        self._attempts: dict[int, str] = {}  # of committed versions: these never change

    def _fs(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Committed versions, oldest first: one small file each, as in any table's log."""
        fs, p = self._fs("commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _commit(self, version: int, attempt: str) -> None:
        create_file(self.spark, f"{self.path}/commits/{version}", attempt)  # fails if another writer took the version
        self._attempts[version] = attempt

    def _folder(self, part: str, version: int) -> str:
        if version not in self._attempts:
            self._attempts[version] = read_file(self.spark, f"{self.path}/commits/{version}")
        return f"{self.path}/{part}/v={version}/by={self._attempts[version]}"

    def vacuum(self) -> int:
        """Delete the folders of attempts that were never committed, of versions that are: how many. A writer at work has none of these."""
        gone = 0
        for v in self.versions():
            for part in ("raw", "changes", "periods"):
                fs, p = self._fs(part, f"v={v}")
                for s in fs.listStatus(p) if fs.exists(p) else []:
                    if not self._folder(part, v).endswith("/" + s.getPath().getName()):
                        gone += bool(fs.delete(s.getPath(), True))
        return gone

    def _read(self, part: str, schema: str, versions: list[int], also: str | None = None) -> DataFrame:
        paths = [*(self._folder(part, v) for v in versions), *([also] if also else [])]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, v int")
        return self.spark.read.option("basePath", f"{self.path}/{part}").schema(f"{schema}, v int").parquet(*paths).drop("by")

    def _touched(self, versions: list[int], also: str | None = None) -> DataFrame:
        """Periods that the given versions changed, for any van."""
        return self._read("changes", CHANGES, versions, also).where("taken_pings > 0").select("period_start", "day", "v").distinct()

    def _period(self) -> Column:
        return F.floor(F.col("event_us") / F.lit(self.period_s * 1_000_000)) * self.period_s

    def _late_by(self) -> Column:
        return F.col("arrival_us") - (F.col("period_start") + self.period_s) * 1_000_000

    def ingest(self, batch: DataFrame) -> int:
        """Take one batch of arrivals (columns of ``RAW``) and commit the periods it changes.

        Rows without van or event time are dropped. A missing arrival counts as the event time.
        An empty batch commits an empty version.
        """
        done = self.versions()
        version = (done[-1] if done else 0) + 1
        attempt = uuid.uuid4().hex
        own = {part: f"{self.path}/{part}/v={version}/by={attempt}" for part in ("raw", "changes", "periods")}
        rows = batch.where(F.col("van_id").isNotNull() & F.col("event_us").isNotNull()).select(
            "van_id", "event_us", F.coalesce("arrival_us", "event_us").alias("arrival_us"), "speed_kmh", "battery_pct"
        )
        day = F.floor(F.col("event_us") / F.lit(86_400_000_000)).cast("int")
        # a partition for each day, but a busy day is cut to several and quiet ones are joined, by their real sizes
        rows.withColumn("day", day).hint("rebalance", "day").write.partitionBy("day").parquet(own["raw"])

        schema = f"{RAW}, day int"
        fresh = self._read("raw", schema, [], own["raw"]).withColumn("period_start", self._period())
        open_ = self._late_by() <= self.close_s * 1_000_000
        brought = fresh.groupBy("van_id", "period_start", "day").agg(F.count_if(open_).alias("taken_pings"), F.count_if(~open_).alias("cut_pings"))
        brought.write.parquet(own["changes"])

        touched = self._touched([], own["changes"])
        days = [r.day for r in touched.select("day").distinct().collect()]  # partitions to read: as many as days
        raw = self._read("raw", schema, done, own["raw"]).where(F.col("day").isin(days)).withColumn("period_start", self._period())
        raw = raw.where(open_).join(touched.select("period_start"), "period_start", "left_semi")
        self._aggregate(raw).write.parquet(own["periods"])
        self._commit(version, attempt)
        return version

    def _aggregate(self, raw: DataFrame) -> DataFrame:
        first = self._late_by() <= self.publish_s * 1_000_000
        speed, battery = F.col("speed_kmh"), F.col("battery_pct")
        return raw.groupBy("van_id", "period_start").agg(
            F.count_if(first).alias("first_pings"),
            F.avg(F.when(first, speed)).alias("first_avg_speed"),
            F.max(F.when(first, speed)).alias("first_max_speed"),
            F.min(F.when(first, battery)).alias("first_min_battery"),
            F.count("*").alias("pings"),
            F.avg(speed).alias("avg_speed"),
            F.max(speed).alias("max_speed"),
            F.min(battery).alias("min_battery"),
            F.count_if(~first).alias("late_pings"),
            F.max("arrival_us").alias("last_arrival_us"),
        )

    def current(self) -> DataFrame:
        """The newest committed version of every period."""
        versions = self.versions()
        newest = self._touched(versions).groupBy("period_start").agg(F.max("v").alias("v"))
        return self._read("periods", AGGREGATES, versions).join(newest, ["period_start", "v"], "left_semi").drop("v")

    def cut(self) -> DataFrame:
        """Records past the cut-off, by van and period."""
        changes = self._read("changes", CHANGES, self.versions()).where("cut_pings > 0")
        return changes.groupBy("van_id", "period_start").agg(F.sum("cut_pings").alias("cut_pings"))


def arrivals(messages: DataFrame) -> DataFrame:
    """Messages as arrivals: event time, arrival time (device time where ingestion is missing) and measures."""
    return messages.where(F.col("van_id").isNotNull() & F.col("device_timestamp").isNotNull()).select(
        "van_id",
        micros("device_timestamp").alias("event_us"),
        F.coalesce(micros("ingestion_timestamp"), micros("device_timestamp")).alias("arrival_us"),
        "speed_kmh",
        "battery_pct",
    )


def replay(messages: DataFrame, rounds: int = 4) -> PeriodTable:
    """Feed a log of distinct messages to a new table in ``rounds`` batches in order of arrival.

    The batches are cut at approximate percentiles of the arrival time. The result doesn't
    depend on where they are cut.
    """
    spark = messages.sparkSession
    rows = staged(arrivals(messages), "arrivals")
    cuts = sorted(set(rows.agg(F.percentile_approx("arrival_us", [k / rounds for k in range(1, rounds)], 1000)).first()[0] or []))
    table = PeriodTable(spark, fresh_path(spark, "periods"))
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = rows
        if low is not None:
            batch = batch.where(F.col("arrival_us") > low)
        if high is not None:
            batch = batch.where(F.col("arrival_us") <= high)
        table.ingest(batch)
    return table
