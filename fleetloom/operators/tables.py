"""Changes of stored tables as plans: idempotent inserts, upserts, retention, compaction.

Nothing is changed in place. Each function gives the table as it is to be written; ``sources.tables``
writes it to a new version and switches over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the target yet, one for each key; a null key is no key, so such rows always go in."""
    keyed = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(target.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return keyed.select(rows.columns).unionByName(rows.where(F.col(key).isNull()))


def upsert(target: DataFrame, rows: DataFrame, key: str, accept: Column, update: dict[str, Column]) -> DataFrame:
    """The target with rows of new keys added, and rows of held keys changed where ``accept`` holds.

    In ``accept`` and ``update`` held columns are ``t.name``, new ones ``s.name``. ``rows`` has one row for each
    key. A null key matches nothing.
    """
    t, s = target.alias("t"), rows.withColumn("_new", F.lit(True)).alias("s")
    joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    held = F.col(f"t.{key}").isNotNull() | F.col("s._new").isNull()
    known = set(rows.columns)

    def column(name: str) -> Column:
        fresh = F.col(f"s.{name}") if name in known else F.lit(None).cast(target.schema[name].dataType)
        changed = F.when(F.col("s._new").isNotNull() & F.coalesce(accept, F.lit(False)), update[name]).otherwise(F.col(f"t.{name}")) if name in update else F.col(f"t.{name}")
        return F.when(held, changed).otherwise(fresh).cast(target.schema[name].dataType).alias(name)

    return joined.select(*[column(c) for c in target.columns])


def newer_version() -> Column:
    """A plan is taken only if none is held or the held version is lower."""
    return F.col("t.plan_version").isNull() | (F.col("t.plan_version") < F.col("s.plan_version"))


def outcome_counts(logs: DataFrame) -> DataFrame:
    """Completed and failed stops of each route."""
    return logs.groupBy("route_id").agg(F.count_if(F.col("delivery_status") == "COMPLETED").alias("completed_stops"), F.count_if(F.col("delivery_status") == "FAILED").alias("failed_stops"))


def with_counts(routes: DataFrame, logs: DataFrame) -> DataFrame:
    """Routes with their counters taken anew from the delivery rows; 0 for a route without any."""
    counts = outcome_counts(logs)
    fresh = {c: F.coalesce(counts[c], F.lit(0)).cast("int").alias(c) for c in ("completed_stops", "failed_stops")}
    return routes.join(counts, routes["route_id"] == counts["route_id"], "left").select(*[fresh.get(c, routes[c]) for c in routes.columns])


def track_lengths(pings: DataFrame, group: str = "route_id", at: str = "device_timestamp", block_s: int = 3600) -> DataFrame:
    """Length in km of the line through each group's pings in order of time; groups of a single ping have none.

    On the sphere; a spheroid differs by up to half a percent. A null position or time is no point of
    the line. Pings of equal time are in order of their record. The line is measured within blocks of
    time and between the ends of neighbouring blocks, so that a group with very many pings is
    many tasks.
    """
    from fleetloom.functions.geo import haversine_m
    from fleetloom.session import micros

    lat, lon = F.col("location.latitude"), F.col("location.longitude")
    rows = pings.where(F.col(group).isNotNull() & F.col(at).isNotNull() & lat.isNotNull() & lon.isNotNull()).select(
        F.col(group).alias("g"), micros(at).alias("us"), F.col("record_id").alias("id"), lat.alias("lat"), lon.alias("lon"), F.floor(micros(at) / F.lit(block_s * 1_000_000)).alias("block")
    )
    inner = Window.partitionBy("g", "block").orderBy("us", "id")
    steps = rows.select("g", "block", "us", "id", "lat", "lon", haversine_m(F.lag("lat").over(inner), F.lag("lon").over(inner), F.col("lat"), F.col("lon")).alias("m"))
    place, order = F.struct("lat", "lon"), F.struct("us", "id")
    blocks = steps.groupBy("g", "block").agg(F.sum("m").alias("m"), F.count("*").alias("pings"), F.min_by(place, order).alias("first"), F.max_by(place, order).alias("last"))
    before = F.lag("last").over(Window.partitionBy("g").orderBy("block"))  # one row per block
    bridged = blocks.withColumn("before", before).withColumn("bridge", haversine_m(F.col("before.lat"), F.col("before.lon"), F.col("first.lat"), F.col("first.lon")))
    total = bridged.groupBy("g").agg((F.coalesce(F.sum("m"), F.lit(0.0)) + F.coalesce(F.sum("bridge"), F.lit(0.0))).alias("m"), F.sum("pings").alias("pings"))
    return total.where("pings > 1").select(F.col("g").alias(group), (F.col("m") / 1000).alias("track_km"), "pings")


def finished_routes(routes: DataFrame, logs: DataFrame, pings: DataFrame) -> DataFrame:
    """Routes that have ended, with duration, distance driven and average speed: what completion writes.

    The duration starts at the actual, else the planned start. The speed is at real pace and at most
    999.99, which is also given where no time passed or no distance is known.
    """
    from fleetloom.functions.time import average_kmh, minutes_between

    ended = with_counts(routes, logs).where("actual_end is not null")
    minutes = minutes_between(F.coalesce("actual_start", "planned_start"), F.col("actual_end"))
    scale = F.col("time_scale").cast("double") if "time_scale" in routes.columns else F.lit(1.0)
    return (
        ended.join(track_lengths(pings), "route_id", "left")
        .select("route_id", "van_id", "completed_stops", "failed_stops", minutes.alias("minutes"), "track_km", scale.alias("scale"))
        .withColumn("avg_speed_kmh", average_kmh(F.col("track_km"), F.col("minutes"), F.col("scale")))
        .drop("scale")
    )


def expired(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    return rows.where(F.col(at) < cutoff)


def expired_batch(rows: DataFrame, at: str, cutoff: Column, order: str, size: int, lowest_first: bool = False) -> DataFrame:
    """The next rows to delete, at most ``size``.

    With ``lowest_first`` the lowest keys are taken before the cut-off is looked at: an old row with a high
    key then stays until its turn comes.
    """
    if lowest_first:
        return rows.orderBy(order).limit(size).where(F.col(at) < cutoff)
    return expired(rows, at, cutoff).orderBy(at, order).limit(size)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti").select(rows.columns)


def retained(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """What a compaction keeps; a row without a time stays."""
    return rows.where((F.col(at) >= cutoff) | F.col(at).isNull())


def retire_routes(routes: DataFrame, logs: DataFrame, breaches: DataFrame, cutoff: Column) -> dict[str, DataFrame]:
    """What is left of deliveries, breaches and routes: a route goes once it is old and nothing refers to it."""
    left_logs, left_breaches = retained(logs, "created_at", cutoff), retained(breaches, "detected_at", cutoff)
    used = left_logs.select("route_id").union(left_breaches.select("route_id"))
    gone = expired(routes, "created_at", cutoff).join(used, "route_id", "left_anti")
    return {"delivery_logs": left_logs, "sla_breaches": left_breaches, "completed_routes": without(routes, gone, "route_id")}


def zones_version(zones: DataFrame) -> DataFrame:
    """One number that changes only if a zone does, in whatever order they are read."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "name", "zone_type", "geometry", "speed_factor", "active")])
    counted = zones.groupBy(row.alias("row")).agg(F.count("*").alias("n"))  # equal rows would cancel each other out
    return counted.agg(F.coalesce(F.bit_xor(F.xxhash64("row", "n")), F.lit(0)).alias("version"), F.coalesce(F.sum("n"), F.lit(0)).alias("zones"))
