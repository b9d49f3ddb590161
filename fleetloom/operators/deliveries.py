"""Delivery events turned into rows of the delivery, breach and route tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.operators.percentiles import exact_percentiles
from fleetloom.functions.time import average_kmh, clamp_int, floor_seconds, minutes_between, severity
from fleetloom.schemas import DELIVERY_EVENT_TYPE

REQUIRED = ("event_id", "van_id", "route_id", "event_type", "timestamp")


def delivery_error() -> Column:
    """What is wrong with a delivery event; null if nothing is."""
    out = F.when(F.col(REQUIRED[0]).isNull(), f"{REQUIRED[0]} is missing")
    for c in REQUIRED[1:]:
        out = out.when(F.col(c).isNull(), f"{c} is missing")
    return out.when(~F.col("event_type").isin(*DELIVERY_EVENT_TYPE), "event_type is unknown").when(F.length("route_id") > 100, "route_id is too long")


def late_seconds() -> Column:
    """Whole seconds after the deadline, 0 or more; 0 without a deadline."""
    return F.greatest(F.coalesce(floor_seconds(F.col("sla_deadline"), F.col("timestamp")), F.lit(0)), F.lit(0))


def departures(events: DataFrame) -> DataFrame:
    """When stops were left: route_id, customer_id, left_at; the last time that was reported."""
    return events.where(delivery_error().isNull() & (F.col("event_type") == "DEPARTURE")).groupBy("route_id", "customer_id").agg(F.max("timestamp").alias("left_at"))


def closed(logs: DataFrame, left: DataFrame) -> DataFrame:
    """Delivery rows with the departures (``departures``) put in: a stop's row in progress gets its time."""
    latest = left.where("route_id is not null and customer_id is not null").groupBy("route_id", "customer_id").agg(F.max("left_at").alias("left_at"))
    joined = logs.join(latest, ["route_id", "customer_id"], "left")
    time = F.when(F.col("delivery_status") == "IN_PROGRESS", F.greatest("actual_departure", "left_at")).otherwise(F.col("actual_departure"))
    return joined.select(*[time.alias(c) if c == "actual_departure" else c for c in logs.columns])


def delivery_rows(events: DataFrame) -> DataFrame:
    """Rows for arrivals (in progress, with the breach of the deadline) and outcomes; a departure of the stop closes the row in progress.

    Every event counts once by event_id. A missing deadline is taken as the event's time.
    """
    once = events.where(delivery_error().isNull()).dropDuplicates(["event_id"])
    arrived = F.col("event_type") == "ARRIVAL"
    status = F.when(arrived, "IN_PROGRESS").when(F.col("event_type") == "DELIVERY_COMPLETED", "COMPLETED").when(F.col("event_type") == "DELIVERY_FAILED", "FAILED")
    late = F.when(arrived, late_seconds()).otherwise(0)
    rows = once.withColumn("delivery_status", status).where("delivery_status is not null").select(
        "event_id", "route_id", "van_id", "stop_index", "customer_id", *[c for c in ("location",) if c in events.columns], F.coalesce("sla_deadline", "timestamp").alias("sla_deadline"),
        F.col("timestamp").alias("actual_arrival"), F.lit(None).cast("timestamp").alias("actual_departure"), "parcels_delivered", "delivery_status", (late > 0).alias("sla_breached"), clamp_int(late).alias("breach_seconds"),
    )
    return closed(rows, departures(once))


def breach_rows(events: DataFrame, predictions: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """A breach for each arrival a full second or more after its deadline, with the first prediction of it and the stop's zone if given.

    ``predictions`` has van_id, route_id, customer_id, at and predicted_arrival; ``zones`` is as ``sources.zones.active_zones`` gives it, and
    the events then have a location.
    """
    once = events.where(delivery_error().isNull() & (F.col("event_type") == "ARRIVAL")).dropDuplicates(["event_id"])
    late = late_seconds()
    rows = once.where(late > 0)
    if zones is not None:
        from fleetloom.sources.zones import zone_at

        rows = zone_at(rows.withColumns({"_x": F.col("location.longitude"), "_y": F.col("location.latitude")}), zones, "_x", "_y")
    place = F.col("zone_id") if zones is not None else F.lit(None).cast("string")
    rows = rows.select(
        "event_id", "route_id", "van_id", "stop_index", "customer_id", "sla_deadline", F.col("timestamp").alias("actual_arrival"),
        clamp_int(late).alias("breach_seconds"), severity(late).alias("severity"), F.lit("LATE_ARRIVAL").alias("cause"), place.alias("geofence_id"), F.col("timestamp").alias("detected_at"),
    )
    if predictions is None:
        return rows.withColumn("predicted_arrival", F.lit(None).cast("timestamp"))
    keys = ["van_id", "route_id", "customer_id"]
    return rows.join(first_predictions(predictions, keys), keys, "left")


def arrival_errors(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """How far the first prediction of each arrival was off, in seconds: event_id, van_id, off_s (positive: later than predicted).

    ``predictions`` is as for ``breach_rows``. Arrivals that nothing was predicted of have no row.
    """
    from fleetloom.session import micros

    keys = ["van_id", "route_id", "customer_id"]
    came = events.where(delivery_error().isNull() & (F.col("event_type") == "ARRIVAL")).dropDuplicates(["event_id"])
    off = (micros("timestamp") - micros("predicted_arrival")) / 1e6
    return came.join(first_predictions(predictions, keys), keys).select("event_id", "van_id", off.alias("off_s"))


def route_starts(events: DataFrame) -> DataFrame:
    """Rows for routes that deliveries are heard of, as far as an arrival tells: planned times stand in until the plan comes."""
    came = events.where(delivery_error().isNull() & (F.col("event_type") == "ARRIVAL"))
    first = came.groupBy("route_id").agg(F.min_by(F.struct("van_id", "total_stops", "timestamp"), F.struct("timestamp", "event_id")).alias("e"))
    return first.select("route_id", "e.van_id", F.col("e.timestamp").alias("planned_start"), F.col("e.timestamp").alias("planned_end"), "e.total_stops", F.lit(0).alias("completed_stops"), F.lit(0).alias("failed_stops"), F.lit("IN_PROGRESS").alias("status"), F.col("e.timestamp").alias("created_at"))


def completed(routes: DataFrame, ends: DataFrame, tracks: DataFrame) -> DataFrame:
    """Routes with those that ended (``route_ends``) completed, unless they are already (or have no status).

    ``tracks`` has route_id and track_km; without a track the planned distance counts. The duration starts at the planned start.
    """
    r = routes.join(ends.withColumnRenamed("actual_end", "_end"), "route_id", "left").join(tracks.select("route_id", "track_km"), "route_id", "left")
    done = F.col("_end").isNotNull() & F.coalesce(F.col("status") != "COMPLETED", F.lit(False))
    minutes, km = minutes_between(F.col("planned_start"), F.col("_end")), F.coalesce("track_km", F.col("planned_distance_km").cast("double"))
    fresh = {
        "status": F.lit("COMPLETED"), "actual_start": F.coalesce("actual_start", "planned_start"), "actual_end": F.col("_end"), "total_duration_min": minutes, "total_distance_km": km,
        "avg_speed_kmh": average_kmh(km, minutes, F.coalesce(F.col("time_scale").cast("double"), F.lit(1.0))),
    }
    return r.select(*[F.when(done, fresh[c]).otherwise(F.col(c)).cast(routes.schema[c].dataType).alias(c) if c in fresh else c for c in routes.columns])


def first_predictions(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """The first prediction of each arrival."""
    return predictions.groupBy(*keys).agg(F.min_by("predicted_arrival", "at").alias("predicted_arrival"))


def route_ends(events: DataFrame) -> DataFrame:
    """When routes were completed: the departure from the last stop."""
    last = F.col("stop_index") >= F.col("total_stops") - 1
    return events.where(delivery_error().isNull() & (F.col("event_type") == "DEPARTURE") & last).groupBy("route_id").agg(F.max("timestamp").alias("actual_end"))


def prediction_errors(breaches: DataFrame) -> DataFrame:
    """How far predicted arrivals were off, in seconds: count, median and 90th percentile, by severity."""
    from fleetloom.session import micros

    off = F.abs(micros("actual_arrival") - micros("predicted_arrival")) / 1e6
    rows = breaches.where("actual_arrival is not null and predicted_arrival is not null").select("severity", off.alias("off_s"))
    return exact_percentiles(rows, "severity", "off_s", {"p50_s": 0.5, "p90_s": 0.9})
