"""The live and derived tables that the analytics queries read beside the stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.operators import sequences, spatial
from fleetloom.session import load, micros, staged
from fleetloom.sources.streams import gps_error

STORED = ("geofence_zones", "sla_breaches", "completed_routes", "delivery_logs", "gps_event")


def first_zones(spark: SparkSession, sf_dir: str, points: DataFrame) -> DataFrame:
    """The first active zone by name that holds each point: record_id, zone_name, speed_factor; no row outside all.

    ``points`` has record_id, x and y.
    """
    zones = load(spark, sf_dir, "geofence_zones").where("active")
    pairs = spatial.regions_of_points(points, zones.select("id", "geometry"), point_id="record_id", x="x", y="y", region_id="id", geometry="geometry")
    named = pairs.join(zones.select("id", "name", F.col("speed_factor").cast("double").alias("factor")), "id")
    return named.groupBy("record_id").agg(F.min(F.struct("name", "id", "factor")).alias("z")).select("record_id", F.col("z.name").alias("zone_name"), F.coalesce("z.factor", F.lit(1.0)).alias("speed_factor"))


def _places(log: DataFrame) -> DataFrame:
    return log.select("record_id", F.col("location.longitude").alias("x"), F.col("location.latitude").alias("y"))


def arrival(log: DataFrame) -> Column:
    """When a ping arrived; a missing arrival counts as the device time."""
    return F.coalesce(log["ingestion_timestamp"], log["device_timestamp"])


def busiest_hour(log: DataFrame) -> int | None:
    """The end, in epoch seconds, of the hour in which most pings under way arrived, the first of equals; None for an empty log."""
    hour = F.floor(micros(arrival(log)) / F.lit(3_600_000_000))
    hours = log.groupBy(hour.alias("h")).agg(F.count_if(F.col("status").isin("EN_ROUTE", "DELIVERING")).alias("n"))
    most = hours.agg(F.min(F.struct(-F.col("n"), F.col("h"))).alias("m")).first().m
    return None if most is None else (most.h + 1) * 3600


def _segment_factors(spark: SparkSession, sf_dir: str, plans: DataFrame) -> DataFrame:
    """The speed factor of each segment of each plan, by the first active zone that holds its middle: plan, factors (as ``sources.zones.segment_factors``)."""
    ends = F.zip_with("lats", "lons", lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon")))
    n = F.greatest(F.size("lats") - 1, F.lit(0))
    middles = F.zip_with(F.slice(ends, F.lit(1), n), F.slice(ends, F.lit(2), n), lambda a, b: F.struct(((a["lat"] + b["lat"]) / 2).alias("y"), ((a["lon"] + b["lon"]) / 2).alias("x")))
    parts = plans.select("plan", F.posexplode(middles).alias("pos", "m")).select("plan", "pos", "m.x", "m.y", F.concat("plan", F.lit("#"), F.col("pos").cast("string")).alias("record_id"))
    slow = first_zones(spark, sf_dir, parts.select("record_id", "x", "y")).select("record_id", "speed_factor")
    listed = parts.join(slow, "record_id", "left").groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("speed_factor", F.lit(1.0)).alias("f")))).alias("l"))
    return listed.select("plan", F.transform("l", lambda s: s["f"]).alias("factors"))  # as long as a route


def ping_estimates(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """Arrival estimates of every ping on the route through its van's logged stops, slowed by the active zones."""
    log = load(spark, sf_dir, "gps_event") if log is None else log
    pings = log.where("van_id is not null and device_timestamp is not null and location is not null and status is not null").select(
        "record_id", "van_id", "route_id", micros("device_timestamp").alias("ts_us"), F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lon"),
        "status", F.col("current_stop_index").alias("leg"), "speed_kmh",
    )
    plans = sequences.plans_from_logs(load(spark, sf_dir, "delivery_logs")).withColumn("plan", F.to_json(F.struct("van_id", "route_id")))
    factors = _segment_factors(spark, sf_dir, plans)
    slowed = first_zones(spark, sf_dir, _places(log)).select("record_id", F.col("speed_factor").alias("zone_factor"))
    pings = pings.where("lat is not null and lon is not null").join(slowed, "record_id", "left")
    return sequences.estimates(pings, plans.join(factors, "plan", "left"))


def live_vans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each van at its newest ping: the estimate, risk and slack there, and the zone that holds its place.

    The log ends with all vans returned; the live table is therefore as it stood at the end of the busiest hour, after all
    pings that had arrived by then.
    Newest by device time, but a clock that is ahead counts as the arrival, and a missing arrival as the device time; then by record.
    Every van that sent a time has a row; one whose newest ping has no place, status or plan is at UNKNOWN risk (NONE if it isn't under way)
    with an estimate of -1, and in no zone without a place.
    """
    log = load(spark, sf_dir, "gps_event").where("van_id is not null and device_timestamp is not null")
    if (until := busiest_hour(log)) is not None:
        log = log.where(micros(arrival(log)) < until * 1_000_000)
    clock = F.least("device_timestamp", F.coalesce("ingestion_timestamp", "device_timestamp"))
    best = F.max_by(F.struct(*[c for c in log.columns if c != "van_id"]), F.struct(clock, "record_id"))
    newest = staged(log.groupBy("van_id").agg(best.alias("p")).select("van_id", "p.*"), "newest")  # a row per van, read three times
    here = first_zones(spark, sf_dir, _places(newest)).select("record_id", "zone_name")
    told = ping_estimates(spark, sf_dir, log).join(newest.select("record_id"), "record_id", "left_semi").select("record_id", "eta_s", "risk", "slack_s")
    return newest.join(told, "record_id", "left").join(here, "record_id", "left").select(
        "van_id", "route_id", "status", F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lon"), "speed_kmh", "battery_pct",
        F.col("current_stop_index").alias("current_stop"), "total_stops", F.coalesce("eta_s", F.lit(-1)).alias("eta_seconds"), F.coalesce("risk", F.lit("UNKNOWN")).alias("sla_risk"),
        F.col("slack_s").alias("slack_seconds"), F.col("zone_name").isNotNull().alias("in_zone"), "zone_name", F.floor(micros("device_timestamp") / F.lit(1000)).alias("updated_epoch_ms"),
    )


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings that can't be used, and those that came more than two hours late; the late ones are archived, so reconciled."""
    late = micros("ingestion_timestamp") - micros("device_timestamp") > 7_200_000_000
    rows = load(spark, sf_dir, "gps_event").withColumn("reason", F.coalesce(gps_error(), F.when(late, "LATE_ARRIVAL")))
    return rows.where("reason is not null").select(
        F.coalesce("van_id", F.lit("unknown")).alias("van_id"), F.substring("reason", 1, 255).alias("error_reason"), (F.col("reason") == "LATE_ARRIVAL").alias("reconciled")
    )


def register(spark: SparkSession, sf_dir: str) -> None:
    """All tables as temporary views, for queries that are given as SQL."""
    for name in STORED:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
    live_vans(spark, sf_dir).createOrReplaceTempView("live_vans")
    dead_letters(spark, sf_dir).createOrReplaceTempView("dead_letter_log")
