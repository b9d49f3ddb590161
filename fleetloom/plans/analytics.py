"""The seven analytics queries, free SQL with parameters, and explain."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.plans import views
from fleetloom.plans.live_sql import LIVE
from fleetloom.session import load

# Limits of a ranking.
LEAST_ROWS, MOST_ROWS = 1, 100


def clamped(limit: int) -> int:
    return max(LEAST_ROWS, min(int(limit), MOST_ROWS))


def top_delay_zones(zones: DataFrame, breaches: DataFrame, limit: int = 10) -> DataFrame:
    """Active zones by total delay; zones of equal delay by name. Breaches without a zone don't count."""
    # breaches are added up by zone before they meet the zones: the join then moves a row per zone
    sums = breaches.where("geofence_id is not null").groupBy("geofence_id").agg(
        F.count("*").alias("n"), F.sum("breach_seconds").alias("s"), F.count("breach_seconds").alias("known")
    )
    return (
        sums.join(zones.where("active"), F.col("geofence_id") == F.col("id"))
        .groupBy(F.col("name").alias("zone_name"), "zone_type", "speed_factor")
        .agg(
            F.sum("n").alias("breach_count"), F.sum("s").alias("total_breach_seconds"),
            (F.sum("s").cast("double") / F.nullif(F.sum("known"), F.lit(0))).alias("avg_breach_seconds"),
        )
        .orderBy(F.desc_nulls_last("total_breach_seconds"), "zone_name", "zone_type", "speed_factor")
        .limit(clamped(limit))
    )


def sla_summary(breaches: DataFrame) -> DataFrame:
    """Breaches by severity and cause."""
    seconds = F.col("breach_seconds")
    return breaches.groupBy("severity", "cause").agg(
        F.count("*").alias("breach_count"), F.avg(seconds.cast("double")).alias("avg_breach_seconds"), F.max(seconds).alias("max_breach_seconds")
    ).orderBy(F.desc("breach_count"))


def van_performance(routes: DataFrame, limit: int = 20) -> DataFrame:
    """Vans by success rate over their completed routes, then by routes, then by id."""
    done, failed = F.sum("completed_stops"), F.sum("failed_stops")
    rate = F.when(done + failed > 0, done.cast("double") * 100 / F.nullif(done + failed, F.lit(0))).otherwise(0.0)
    return (
        routes.where("status = 'COMPLETED'")
        .groupBy("van_id")
        .agg(
            F.count("*").alias("total_routes"), done.alias("total_completed"), failed.alias("total_failed"), rate.alias("success_rate_pct"),
            F.avg(F.col("avg_speed_kmh").cast("double")).alias("avg_speed"), F.avg(F.col("total_distance_km").cast("double")).alias("avg_distance_km"),
        )
        .orderBy(F.desc("success_rate_pct"), F.desc("total_routes"), "van_id")
        .limit(clamped(limit))
    )


def dlq_summary(letters: DataFrame) -> DataFrame:
    """Dead letters by reason; what isn't known to be reconciled is pending."""
    count = lambda on: F.sum(F.when(on, 1).otherwise(0))
    reconciled = F.coalesce("reconciled", F.lit(False))
    return letters.groupBy("error_reason").agg(
        F.count("*").alias("event_count"), count(reconciled).alias("reconciled_count"), count(~reconciled).alias("pending_count")
    ).orderBy(F.desc("event_count"))


def zone_heatmap(zones: DataFrame, breaches: DataFrame) -> DataFrame:
    """All active zones with their hits, also those without any."""
    sums = breaches.groupBy("geofence_id").agg(F.count("breach_seconds").alias("n"), F.sum("breach_seconds").alias("s"))
    hits = F.coalesce(F.sum("n"), F.lit(0))
    return (
        zones.where("active").join(sums, F.col("geofence_id") == F.col("id"), "left")
        .groupBy(F.col("name").alias("zone_name"), "zone_type", "speed_factor")
        .agg(hits.alias("hit_count"), F.coalesce(F.sum("s").cast("double") / F.nullif(hits, F.lit(0)), F.lit(0.0)).alias("avg_delay_seconds"))
        .orderBy(F.desc("hit_count"))
    )


def live_zone_risk(live: DataFrame, zones: DataFrame, breaches: DataFrame) -> DataFrame:
    """Vans in a zone now, with the zone's history by name, whether the zone is active or not."""
    sums = breaches.where("geofence_id is not null").groupBy("geofence_id").agg(F.count("*").alias("n"), F.sum("breach_seconds").alias("s"), F.count("breach_seconds").alias("k"))
    history = (
        sums.join(zones.select("id", "name"), F.col("geofence_id") == F.col("id")).groupBy("name")
        .agg(F.sum("n").alias("past"), (F.sum("s").cast("double") / F.nullif(F.sum("k"), F.lit(0))).alias("zone_avg_breach_seconds"))
    )
    history = history.withColumnRenamed("name", "history_name")
    place = zones.select(F.col("name").alias("place_name"), "speed_factor")
    return (
        live.where("in_zone").join(place, F.col("zone_name") == F.col("place_name"))
        .join(history, F.col("zone_name") == F.col("history_name"), "left")
        .select("van_id", "status", "zone_name", "sla_risk", "slack_seconds", "speed_factor", F.coalesce("past", F.lit(0)).alias("zone_breaches"), "zone_avg_breach_seconds")
        .orderBy(F.desc("zone_breaches"), "van_id")
    )


def at_risk_vans(live: DataFrame, breaches: DataFrame) -> DataFrame:
    """Vans at risk now, the most urgent first, with their history; unknown slack comes last."""
    history = breaches.groupBy("van_id").agg(F.count("*").alias("past"), F.avg(F.col("breach_seconds").cast("double")).alias("past_avg_breach_seconds"))
    return (
        live.where(F.col("sla_risk").isin("WARNING", "CRITICAL"))
        .join(history, "van_id", "left")
        .select(
            "van_id", "status", "sla_risk", "slack_seconds", "eta_seconds", "zone_name", F.coalesce("past", F.lit(0)).alias("past_breaches"), "past_avg_breach_seconds"
        )
        .orderBy(F.asc_nulls_last("slack_seconds"), "van_id")
    )


def panel(live: DataFrame) -> DataFrame:
    """The lists of a dashboard: list (CRITICAL, WARNING, DELIVERING or IN_ZONE) and van_id, by list and van.

    A van is in every list that it belongs to.
    """
    of = F.array_compact(
        F.array(
            F.when(F.col("sla_risk").isin("CRITICAL", "WARNING"), F.col("sla_risk")), F.when(F.col("status") == "DELIVERING", "DELIVERING"), F.when(F.col("in_zone"), "IN_ZONE")
        )
    )
    return live.select(F.explode(of).alias("list"), "van_id").orderBy("list", "van_id")


_FETCH = re.compile(r"\bFETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+ONLY\b", re.I)


def run_sql(spark: SparkSession, sql: str, *params: object) -> DataFrame:
    """Any SQL over the registered views, with positional parameters; labels come out in lower case.

    ``FETCH FIRST n ROWS ONLY`` is taken as LIMIT.
    """
    df = spark.sql(_FETCH.sub(r"LIMIT \1", sql), args=list(params) or None)
    return df.toDF(*[c.lower() for c in df.columns])


def explain_sql(spark: SparkSession, sql: str, *params: object) -> str:
    """The plan of a query as text."""
    return run_sql(spark, sql, *params)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _table(name: str):
    return lambda spark, sf_dir: load(spark, sf_dir, name)


_ZONES, _BREACHES, _ROUTES = _table("geofence_zones"), _table("sla_breaches"), _table("completed_routes")


def _free_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register(spark, sf_dir)
    return run_sql(
        spark, "SELECT severity AS SEVERITY, count(*) AS n FROM sla_breaches WHERE breach_seconds > ? AND cause = ? GROUP BY severity ORDER BY n DESC FETCH FIRST 5 ROWS ONLY", 60, "LATE_ARRIVAL"
    )


QUERIES = {
    "delay_zones": lambda s, d: top_delay_zones(_ZONES(s, d), _BREACHES(s, d)),
    "sla_summary": lambda s, d: sla_summary(_BREACHES(s, d)),
    "van_performance": lambda s, d: van_performance(_ROUTES(s, d)),
    "dlq_summary": lambda s, d: dlq_summary(views.dead_letters(s, d)),
    "zone_heatmap": lambda s, d: zone_heatmap(_ZONES(s, d), _BREACHES(s, d)),
    "live_zone_risk": lambda s, d: live_zone_risk(views.live_vans(s, d), _ZONES(s, d), _BREACHES(s, d)),
    "at_risk_vans": lambda s, d: at_risk_vans(views.live_vans(s, d), _BREACHES(s, d)),
    "panel": lambda s, d: panel(views.live_vans(s, d)),
    "free_sql": _free_sql,
    "live_vans": views.live_vans,
}

SQL = {
    "delay_zones": """
SELECT z.name AS zone_name, z.zone_type, z.speed_factor, count(*) AS breach_count, CAST(sum(s.breach_seconds) AS BIGINT) AS total_breach_seconds,
       avg(CAST(s.breach_seconds AS DOUBLE)) AS avg_breach_seconds
FROM sla_breaches s JOIN geofence_zones z ON s.geofence_id = z.id WHERE z.active
GROUP BY 1, 2, 3 ORDER BY total_breach_seconds DESC NULLS LAST, zone_name, zone_type, speed_factor LIMIT 10""",
    "sla_summary": """
SELECT severity, cause, count(*) AS breach_count, avg(CAST(breach_seconds AS DOUBLE)) AS avg_breach_seconds, max(breach_seconds) AS max_breach_seconds
FROM sla_breaches GROUP BY 1, 2""",
    "van_performance": """
SELECT van_id, count(*) AS total_routes, CAST(sum(completed_stops) AS BIGINT) AS total_completed, CAST(sum(failed_stops) AS BIGINT) AS total_failed,
       CASE WHEN sum(completed_stops) + sum(failed_stops) > 0
            THEN CAST(sum(completed_stops) AS DOUBLE) * 100 / (sum(completed_stops) + sum(failed_stops)) ELSE 0.0 END AS success_rate_pct,
       avg(CAST(avg_speed_kmh AS DOUBLE)) AS avg_speed, avg(CAST(total_distance_km AS DOUBLE)) AS avg_distance_km
FROM completed_routes WHERE status = 'COMPLETED' GROUP BY 1 ORDER BY success_rate_pct DESC, total_routes DESC, van_id LIMIT 20""",
    "dlq_summary": """
WITH r AS (SELECT CASE WHEN event_id IS NULL THEN 'event_id is missing' WHEN van_id IS NULL OR route_id IS NULL THEN 'van_id or route_id is missing'
  WHEN device_timestamp IS NULL THEN 'device_timestamp is missing'
  WHEN location IS NULL OR location.latitude IS NULL OR location.longitude IS NULL THEN 'location is missing' WHEN status IS NULL THEN 'status is missing'
  WHEN epoch_us(ingestion_timestamp) - epoch_us(device_timestamp) > 7200000000 THEN 'LATE_ARRIVAL' END AS error_reason FROM gps_event)
SELECT error_reason, count(*) AS event_count, count(*) FILTER (error_reason = 'LATE_ARRIVAL') AS reconciled_count,
       count(*) FILTER (error_reason <> 'LATE_ARRIVAL') AS pending_count
FROM r WHERE error_reason IS NOT NULL GROUP BY 1""",
    "zone_heatmap": """
SELECT z.name AS zone_name, z.zone_type, z.speed_factor, count(s.breach_seconds) AS hit_count, coalesce(avg(CAST(s.breach_seconds AS DOUBLE)), 0.0) AS avg_delay_seconds
FROM geofence_zones z LEFT JOIN sla_breaches s ON s.geofence_id = z.id WHERE z.active GROUP BY 1, 2, 3""",
    "live_zone_risk": LIVE
    + """
SELECT v.van_id, v.status, v.zone_name, v.sla_risk, v.slack_seconds, z.speed_factor, coalesce(h.n, 0) AS zone_breaches, h.a AS zone_avg_breach_seconds
FROM live_vans v JOIN geofence_zones z ON z.name = v.zone_name
LEFT JOIN (SELECT z.name, count(*) AS n, avg(CAST(s.breach_seconds AS DOUBLE)) AS a FROM sla_breaches s JOIN geofence_zones z ON z.id = s.geofence_id GROUP BY 1) h
  ON h.name = v.zone_name
WHERE v.in_zone""",
    "at_risk_vans": LIVE
    + """
SELECT v.van_id, v.status, v.sla_risk, v.slack_seconds, v.eta_seconds, v.zone_name, coalesce(h.n, 0) AS past_breaches, h.a AS past_avg_breach_seconds
FROM live_vans v LEFT JOIN (SELECT van_id, count(*) AS n, avg(CAST(breach_seconds AS DOUBLE)) AS a FROM sla_breaches GROUP BY 1) h ON h.van_id = v.van_id
WHERE v.sla_risk IN ('WARNING', 'CRITICAL')""",
    "panel": LIVE
    + """
SELECT sla_risk AS list, van_id FROM live_vans WHERE sla_risk IN ('CRITICAL', 'WARNING') UNION ALL
SELECT 'DELIVERING', van_id FROM live_vans WHERE status = 'DELIVERING' UNION ALL SELECT 'IN_ZONE', van_id FROM live_vans WHERE in_zone""",
    "free_sql": "SELECT severity, count(*) AS n FROM sla_breaches WHERE breach_seconds > 60 AND cause = 'LATE_ARRIVAL' GROUP BY 1 ORDER BY n DESC LIMIT 5",
    "live_vans": LIVE + "SELECT * FROM live_vans",
    "vans_by_risk": LIVE
    + """
SELECT r.sla_risk, count(v.van_id) AS vans FROM (VALUES ('NONE'), ('WARNING'), ('CRITICAL'), ('UNKNOWN')) AS r(sla_risk) LEFT JOIN live_vans v ON v.sla_risk = r.sla_risk GROUP BY 1""",
}
