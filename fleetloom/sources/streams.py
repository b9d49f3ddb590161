"""Streams of JSON records, parsed and validated; broken records are kept apart, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom import schemas
from fleetloom.operators.deliveries import delivery_error
from fleetloom.schemas import VAN_STATUS


def raw_stream(spark: SparkSession, kind: str, where: str, topic: str | None = None, from_start: bool = False, at_most: int | None = None) -> DataFrame:
    """A stream of raw records: value (text), topic, partition, offset, arrived.

    ``kind`` is ``kafka`` (``where`` are the brokers; the connector must be on the class path) or ``json``: files of
    one record per line. ``at_most`` bounds a micro-batch, in records or files. A group of consumers is a checkpoint
    here: each query has its own.
    """
    if kind == "kafka":
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", where).option("subscribe", topic).option("startingOffsets", "earliest" if from_start else "latest")
        if at_most:
            reader = reader.option("maxOffsetsPerTrigger", at_most)
        return reader.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset", F.col("timestamp").alias("arrived"))
    if kind == "json":
        reader = spark.readStream.schema("value string")
        if at_most:
            reader = reader.option("maxFilesPerTrigger", at_most)
        return reader.text(where).select("value", F.lit(topic).alias("topic"), F.lit(0).alias("partition"), F.lit(None).cast("bigint").alias("offset"), F.current_timestamp().alias("arrived"))
    raise ValueError(f"no such kind of stream: {kind}")


def changelog(raw: DataFrame, key: Column, order: Column) -> DataFrame:
    """The latest record of each key, of a batch or (in update mode) of a stream."""
    return raw.groupBy(key.alias("key")).agg(F.max_by("value", order).alias("value"))


def _parsed(raw: DataFrame, schema: str, error: Column) -> DataFrame:
    """Fields of the record, and ``error``: why it can't be used, or null."""
    read = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = raw.withColumn("_r", read)
    fields = [c.split(" ", 1)[0].strip() for c in _names(schema)]
    out = rows.select("*", *[F.col(f"_r.{c}").alias(c) for c in fields], F.col("_r._broken").alias("_broken"))
    broken = F.col("value").isNull() | F.col("_r").isNull() | F.col("_broken").isNotNull()
    return out.withColumn("error", F.when(broken, "record can't be read").otherwise(error)).drop("_r", "_broken")


def _names(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += c in "<("
        depth -= c in ">)"
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def gps_error() -> Column:
    """What is wrong with a ping; the first failing check counts. An unknown status makes it unreadable."""
    return (
        F.when(F.col("status").isNotNull() & ~F.col("status").isin(*VAN_STATUS), "status is unknown")
        .when(F.col("event_id").isNull(), "event_id is missing")
        .when(F.col("van_id").isNull() | F.col("route_id").isNull(), "van_id or route_id is missing")
        .when(F.col("device_timestamp").isNull(), "device_timestamp is missing")
        .when(F.col("location.latitude").isNull() | F.col("location.longitude").isNull(), "location is missing")
        .when(F.col("status").isNull(), "status is missing")
    )


def plan_error() -> Column:
    """What is wrong with a route plan."""
    index = F.transform("stops", lambda s: s["waypoint_index"])
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("stops") - 1, F.lit(1))), lambda i: (F.size("stops") < 2) | (F.get(index, i) >= F.get(index, i - 1)))
    inside = F.forall(index, lambda i: i.isNotNull() & (i >= 0) & (i < F.size("waypoints")))
    positive = lambda c: F.coalesce((F.col(c) > 0) & ~F.isnan(c), F.lit(False))
    return (
        F.when(F.col("route_id").isNull() | F.col("van_id").isNull(), "route_id or van_id is missing")
        .when(F.col("waypoints").isNull() | (F.size("waypoints") < 2), "fewer than two waypoints")
        .when(~F.forall("waypoints", lambda w: w.isNotNull() & (F.size(w) == 2)), "a waypoint isn't a pair")
        .when(~positive("time_scale") | ~positive("base_speed_kmh"), "time_scale or base_speed_kmh isn't positive")
        .when(F.col("stops").isNull(), "stops are missing")
        .when(F.exists("stops", lambda s: s["sla_deadline"].isNull() | s["customer_id"].isNull()), "a stop has no deadline or customer")
        .when(~inside | ~rising, "waypoint indices don't rise within the waypoints")
    )


def gps_records(raw: DataFrame) -> DataFrame:
    parsed = _parsed(raw, schemas.GPS_EVENT, gps_error())
    return parsed.withColumn("sequence_number", F.coalesce("sequence_number", F.lit(0)))


def delivery_records(raw: DataFrame) -> DataFrame:
    return _parsed(raw, schemas.DELIVERY_EVENT, delivery_error())


def plan_records(raw: DataFrame) -> DataFrame:
    return _parsed(raw, schemas.ROUTE_PLAN, plan_error())


def assignment_records(raw: DataFrame) -> DataFrame:
    missing = F.col("order_id").isNull() | F.col("van_id").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull() | F.col("insert_before").isNull()
    return _parsed(raw, schemas.ASSIGNMENT, F.when(missing, "malformed assignment"))


def usable(records: DataFrame) -> DataFrame:
    return records.where("error is null").drop("error", "value")


def dead_letter_rows(records: DataFrame, prefix: str = "MALFORMED: ", reconciled: bool = False) -> DataFrame:
    """Rows of the dead-letter log for records with an error; the payload is JSON in any case."""
    from fleetloom.functions.text import json_or_string

    at = F.current_timestamp() if reconciled else F.lit(None).cast("timestamp")
    return records.where("error is not null").select(
        F.col("topic").alias("original_topic"), F.coalesce("van_id", F.lit("unknown")).alias("van_id"), json_or_string(F.col("value")).alias("event_payload"),
        F.substring(F.concat(F.lit(prefix), F.col("error")), 1, 255).alias("error_reason"), F.lit(reconciled).alias("reconciled"), F.current_timestamp().alias("created_at"), at.alias("reconciled_at"),
    )


def dead_letter_messages(records: DataFrame) -> DataFrame:
    """Messages for a dead-letter topic: the raw record with headers that say why and where from."""
    header = lambda name, c: F.struct(F.lit(name).alias("key"), c.cast("string").cast("binary").alias("value"))
    headers = F.array(header("error", F.substring("error", 1, 500)), header("topic", F.col("topic")), header("partition", F.col("partition")), header("offset", F.col("offset")))
    return records.where("error is not null").select("value", headers.alias("headers"))
