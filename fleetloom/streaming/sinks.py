"""What a micro-batch does to stored tables; each is idempotent, so a batch that is repeated changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from fleetloom import schemas
from fleetloom.operators import deliveries, route_plans
from fleetloom.operators import tables as ops
from fleetloom.operators.late_periods import PeriodTable
from fleetloom.operators.state.streams import retried
from fleetloom.sources.streams import dead_letter_rows, usable
from fleetloom.sources.tables import KeyedTable, StoredTable

Sink = Callable[[DataFrame, int], None]


def periods_sink(table: PeriodTable) -> Sink:
    """Feed arrivals to a period table: the periods of a batch are recomputed and swapped in at once."""
    def run(batch: DataFrame, number: int) -> None:
        if number + 1 > len(table.versions()):  # a repeated batch is in already
            table.ingest(batch)

    return run


def pings_sink(archive: StoredTable, letters: StoredTable, live: StoredTable, query: str) -> Sink:
    """Released and late pings to the archive, late ones also to the dead letters (reconciled), the newest to the live table."""
    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            archive.append(batch.where("kind in ('released', 'late')"), (query, number))
            late = batch.where("kind = 'late'").select(
                F.lit("gps-events").alias("original_topic"), "van_id", F.col("payload").alias("event_payload"), F.lit("LATE_ARRIVAL").alias("error_reason"),
                F.lit(True).alias("reconciled"), F.timestamp_micros("at_us").alias("created_at"), F.timestamp_micros("at_us").alias("reconciled_at"),
            )
            letters.append(late, (query, number))
            newest = live.read().unionByName(batch.where("kind = 'released'").select("van_id", "seq", "ts_us", "at_us", "status", "payload"))
            live.replace(latest(newest), (query, number))
        finally:
            batch.unpersist()

    return run


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each van; of equally new ones the later arrival."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c != "van_id"]), F.struct("ts_us", "at_us"))
    return rows.groupBy("van_id").agg(best.alias("r")).select("van_id", "r.*")


def live_sink(live: StoredTable, query: str) -> Sink:
    """Released pings with estimates (``pings.estimated_pings``) to the live table of ``schemas.LIVE_VANS``: the newest state of each van."""
    payload = "route_id string, location struct<latitude:double,longitude:double>, speed_kmh double, battery_pct int, current_stop_index int, total_stops int, zone_name string"

    def run(batch: DataFrame, number: int) -> None:
        r = batch.where("kind = 'released'").withColumn("p", F.from_json("payload", payload))
        rows = r.select(
            "van_id", "p.route_id", "status", F.col("p.location.latitude").alias("lat"), F.col("p.location.longitude").alias("lon"), "p.speed_kmh", "p.battery_pct",
            F.col("p.current_stop_index").alias("current_stop"), "p.total_stops", F.col("eta_s").alias("eta_seconds"), F.col("risk").alias("sla_risk"), F.col("slack_s").alias("slack_seconds"),
            F.col("p.zone_name").isNotNull().alias("in_zone"), "p.zone_name", F.floor(F.col("ts_us") / 1000).alias("updated_epoch_ms"), "at_us",
        )
        both = live.read().withColumn("at_us", F.lit(-1).cast("bigint")).unionByName(rows)
        best = F.max_by(F.struct(*[c for c in both.columns if c not in ("van_id", "at_us")]), F.struct("updated_epoch_ms", "at_us"))
        live.replace(both.groupBy("van_id").agg(best.alias("r")).select("van_id", "r.*"), (query, number))  # a row per van

    return run


def predictions(estimated: DataFrame) -> DataFrame:
    """What was predicted of arrivals, for ``deliveries.first_predictions``: van_id, route_id, stop_index, at, predicted_arrival."""
    p = F.from_json("payload", "route_id string, current_stop_index int")
    rows = estimated.where("kind = 'released' and status = 'EN_ROUTE' and arrival_us is not null").withColumn("p", p)
    return rows.select("van_id", "p.route_id", F.col("p.current_stop_index").alias("stop_index"), F.timestamp_micros("ts_us").alias("at"), F.timestamp_micros("arrival_us").alias("predicted_arrival"))


@dataclass
class DeliveryTables:
    """What delivery events are written to. ``departures`` (route_id, customer_id, left_at) is put into the log when it is read (``log``)."""

    logs: StoredTable
    departures: StoredTable
    breaches: StoredTable
    routes: KeyedTable
    letters: StoredTable

    @classmethod
    def under(cls, spark: SparkSession, path: str) -> DeliveryTables:
        stored = lambda name, schema: StoredTable(spark, f"{path}/{name}", schema)
        return cls(
            stored("delivery_logs", schemas.DELIVERY_LOGS), stored("departures", "route_id string, customer_id string, left_at timestamp"), stored("sla_breaches", schemas.SLA_BREACHES),
            KeyedTable(spark, f"{path}/completed_routes", schemas.COMPLETED_ROUTES, "route_id"), stored("dead_letter_log", schemas.DEAD_LETTER_LOG),
        )

    def log(self) -> DataFrame:
        return deliveries.closed(self.logs.read(), self.departures.read())

    def compact(self) -> None:
        """Departures put into the log for good, and one row kept of each route. Not while a stream writes."""
        self.logs.replace(self.log())
        self.departures.replace(self.departures.read().where("false"))
        self.routes.compact()


def deliveries_sink(t: DeliveryTables, query: str, zones: DataFrame | None = None, predictions: Callable[[], DataFrame] | None = None, archive: Callable[[], DataFrame] | None = None, wait: Callable[[float], None] | None = None) -> Sink:
    """Delivery records (``streams.delivery_records``) to rows, departures, breaches and routes; broken ones to the dead letters.

    Each batch adds what is new: event ids are looked up by that column alone, and only the touched routes are read and written. A route is there from
    its first arrival on; its counters are taken anew from the log; it is completed, once, when its last stop is left, with the length of its track
    in ``archive`` (pings as ``tables.track_lengths`` takes them). A batch that can't be written is tried again three times after growing pauses, then goes
    to the dead letters as a whole.
    """

    def write(events: DataFrame, mark: tuple[str, int]) -> None:
        rows = deliveries.delivery_rows(events).withColumn("created_at", F.current_timestamp())
        t.logs.append(ops.insert_new(t.logs.read(), rows.withColumn("id", F.expr("uuid()")), "event_id"), mark)
        t.departures.append(deliveries.departures(events), mark)
        late = deliveries.breach_rows(events, predictions() if predictions else None, zones).withColumn("id", F.expr("uuid()"))
        t.breaches.append(ops.insert_new(t.breaches.read(), late, "event_id"), mark)
        touched = events.select("route_id").distinct()
        held = t.routes.held(touched)
        known = held.unionByName(deliveries.route_starts(events).join(held, "route_id", "left_anti"), allowMissingColumns=True)
        counted = ops.with_counts(known, t.logs.read().join(touched, "route_id", "left_semi"))
        ends = deliveries.route_ends(events)
        pings = archive().join(ends.select("route_id"), "route_id", "left_semi") if archive else None
        tracks = ops.track_lengths(pings) if pings is not None else ends.select("route_id", F.lit(None).cast("double").alias("track_km"))
        t.routes.put(deliveries.completed(counted, ends, tracks), mark)

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            t.letters.append(dead_letter_rows(batch), (query, number))
            try:
                retried(lambda: write(usable(batch), (query, number)), wait=wait)
            except Exception as e:
                lost = batch.where("error is null").withColumn("error", F.lit(str(e).split("\n", 1)[0]))
                t.letters.append(dead_letter_rows(lost, prefix="DB_WRITE_FAILED: "), (f"{query} failed", number))
        finally:
            batch.unpersist()

    return run


def plans_sink(routes: KeyedTable, letters: StoredTable, query: str) -> Sink:
    """Plan records (``streams.plan_records``) to the planned side of their routes; broken ones to the dead letters."""

    def run(batch: DataFrame, number: int) -> None:
        letters.append(dead_letter_rows(batch), (query, number))
        plans = usable(batch)
        routes.put(route_plans.with_plans(routes.held(plans), plans), (query, number))

    return run


def publish(messages: DataFrame, kind: str, where: str, topic: str) -> None:
    """Write messages (value, perhaps key and headers): to Kafka (``where`` are the brokers) or as JSON lines under ``where/topic``."""
    if kind == "kafka":
        messages.withColumn("topic", F.lit(topic)).write.format("kafka").option("kafka.bootstrap.servers", where).option("includeHeaders", "headers" in messages.columns).save()
    elif kind == "json":
        plain = messages.withColumn("headers", F.transform("headers", lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")))) if "headers" in messages.columns else messages
        plain.write.mode("append").json(f"{where.rstrip('/')}/{topic}")
    else:
        raise ValueError(f"no such kind of sink: {kind}")


def publisher(kind: str, where: str, topic: str, make: Callable[[DataFrame], DataFrame]) -> Sink:
    """A sink that publishes what ``make`` makes of a batch; a batch that is repeated is published again (at least once)."""
    return lambda batch, number: publish(make(batch), kind, where, topic)


def assignment_messages(assignments: DataFrame) -> DataFrame:
    """Assignments (``dispatch.assignments`` with order_id and van_id) as messages keyed by van, so that a van's come in order."""
    return assignments.select(F.col("van_id").alias("key"), F.to_json(F.struct(*assignments.columns)).alias("value"))


def state_messages(live: DataFrame) -> DataFrame:
    """Rows of the live table as messages keyed by van."""
    return live.select(F.col("van_id").alias("key"), F.to_json(F.struct(*live.columns)).alias("value"))


def observed(df: DataFrame, name: str) -> DataFrame:
    """The stream with counters of what passes: rows by kind, and the largest lag in seconds, taken along the way."""
    lag = F.max((F.col("at_us") - F.col("ts_us")) / 1e6).alias("largest_lag_s")
    return df.observe(name, F.count("*").alias("rows"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("released", "late", "duplicate", "too_old")], lag)


class Counters(StreamingQueryListener):
    """Sums of the observed counters over all micro-batches, and the highest of those called largest."""

    def __init__(self):
        self.totals: dict[str, dict[str, float]] = {}

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            held = self.totals.setdefault(name, {})
            for k, v in row.asDict().items():
                if v is not None:
                    held[k] = max(held.get(k, v), v) if k.startswith("largest") else held.get(k, 0) + v

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
