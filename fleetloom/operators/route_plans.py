"""Route plans as rows of the route table, and as what estimates need of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.geo import cumulative_m
from fleetloom.functions.time import round_km
from fleetloom.operators import tables
from fleetloom.session import micros

DWELL_S = 40.0  # planned at the last stop


def route_rows(plans: DataFrame) -> DataFrame:
    """The planned side of each plan's route: from the start to the end of the last stop, by time and distance.

    ``plans`` is as ``sources.streams.plan_records`` gives it. Plans without a stop have no row. Of several plans of a route the highest
    version counts, of those the latest created.
    """
    last = F.element_at("stops", -1)
    newest = plans.where(F.size("stops") > 0).groupBy("route_id").agg(F.max_by(F.struct("van_id", "version", "created_at", "time_scale", "stops", "waypoints"), F.struct(F.coalesce("version", F.lit(0)), "created_at")).alias("p"))
    rows = newest.select("route_id", "p.*")
    dwell_us = F.floor(F.lit(DWELL_S) / F.col("time_scale") * 1000) * 1000
    return rows.select(
        "route_id", "van_id", F.coalesce("created_at", F.current_timestamp()).alias("planned_start"), F.timestamp_micros(micros(last["planned_arrival"]) + dwell_us).alias("planned_end"),
        F.size("stops").alias("total_stops"), F.coalesce("version", F.lit(0)).alias("plan_version"), F.col("time_scale").cast("decimal(6,2)").alias("time_scale"),
        round_km(F.get(cumulative_m(F.col("waypoints")), last["waypoint_index"])).cast("decimal(8,2)").alias("planned_distance_km"), F.lit(0).alias("completed_stops"), F.lit(0).alias("failed_stops"),
        F.lit("IN_PROGRESS").alias("status"), F.coalesce("created_at", F.current_timestamp()).alias("created_at"),
    )


PLANNED = ("planned_start", "planned_end", "total_stops", "plan_version", "time_scale", "planned_distance_km")


def with_plans(routes: DataFrame, plans: DataFrame) -> DataFrame:
    """Routes with the planned side of newer plans, and new routes; an older or equal version changes nothing."""
    update: dict[str, Column] = {c: F.col(f"s.{c}") for c in PLANNED}
    return tables.upsert(routes, route_rows(plans), "route_id", tables.newer_version(), update)


def tracked(plans: DataFrame) -> DataFrame:
    """Plans as ``streaming.pings.keyed_plans`` and ``sequences.estimates`` take them."""
    of = lambda c: F.transform("stops", lambda s: s[c])
    return plans.select(
        "van_id", "route_id", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce(micros("created_at"), F.lit(0)).alias("created_us"), F.transform("waypoints", lambda w: w[0]).alias("lats"),
        F.transform("waypoints", lambda w: w[1]).alias("lons"), of("waypoint_index").alias("vertices"), F.transform("stops", lambda s: micros(s["sla_deadline"]) / 1e6).alias("deadlines"), of("customer_id").alias("customers"),
        "base_speed_kmh", "time_scale",
    )
