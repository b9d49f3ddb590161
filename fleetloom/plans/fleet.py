"""Queries of the pipeline's own operators over the fleet tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetloom.functions.geo import bearing_deg, haversine_km
from fleetloom.functions.time import lag_ms
from fleetloom.operators import deliveries, dispatch, health, sequences, tables
from fleetloom.operators.percentiles import exact_percentiles
from fleetloom.operators.prefix import running_max
from fleetloom.plans import views
from fleetloom.plans.live_sql import ESTIMATES, HAVERSINE, LIVE
from fleetloom.plans.problems import IN_ZONES
from fleetloom.schemas import RISK
from fleetloom.session import load, micros, staged
from fleetloom.sources.zones import parsed_zones


def _gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "gps_event")


def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding-window verdict on every ping."""
    return sequences.window_verdicts(_gps(spark, sf_dir)).select("record_id", "verdict")


def bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Bloom filter's verdict on every ping."""
    return sequences.bloom_verdicts(_gps(spark, sf_dir)).select("record_id", "repeated")


def plan_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes as plans in order of arrival: which of them replaced their van's plan.

    A route is planned when it is created, comes again as version 1 when it starts, and once more, unchanged, when it ends.
    """
    routes = load(spark, sf_dir, "completed_routes")
    sent = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), micros(c).alias("arrival")) for v, c in ((0, "created_at"), (1, "actual_start"), (1, "actual_end"))]))
    plans = routes.select("van_id", "route_id", (micros("planned_start") / 1e6).alias("created_s"), sent.alias("p")).select("van_id", "route_id", "created_s", "p.version", "p.arrival")
    return sequences.accepted_plans(plans.where("arrival is not null")).select("van_id", "route_id", "version", "arrival", "accepted")


def dedup_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sliding window made of the log: pings by verdict, and each verdict's share."""
    counts = sequences.window_verdicts(_gps(spark, sf_dir)).groupBy("verdict").agg(F.count("*").alias("pings"))
    whole = counts.agg(F.sum("pings").alias("n"))
    return counts.join(F.broadcast(whole)).select("verdict", "pings", F.round(F.col("pings") * 100 / F.col("n"), 3).alias("percent"))


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a window of 4,096 on the events table as a stream in which all arrive twice and out of order.

    Without restarts a verdict follows from the highest number before and the earlier copies, so no state is needed.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = load(spark, sf_dir, "events").select(F.col("user_id").alias("van_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 50 + (k * 97) % 9000).alias("at_ms"))
    rows = base.unionByName(base.withColumn("at_ms", F.col("at_ms") + 250))
    rows = running_max(rows, "van_id", "at_ms", F.col("seq"), "highest", 60_000, "seq")  # in blocks of a minute
    again = F.row_number().over(Window.partitionBy("van_id", "seq").orderBy("at_ms"))
    behind = F.col("highest") - F.col("seq")
    verdict = F.when(F.col("highest").isNull() | (behind < 0), "new").when(behind >= 4096, "too_old").when(F.col("again") > 1, "duplicate").otherwise("new")
    return rows.select("*", again.alias("again")).select("van_id", "seq", "at_ms", verdict.alias("verdict"))


def late_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings that come after a later one of their van was released."""
    return sequences.late_pings(_gps(spark, sf_dir))


def archive_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings that the archive keeps: at least 30 seconds apart for each van."""
    return sequences.archive_sample(_gps(spark, sf_dir), 30.0)


def throttled_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that are published: every change of status, else at most one a minute for each van."""
    return sequences.throttled(_gps(spark, sf_dir), 60.0)


def sampled_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ping of each van in each minute of arrival."""
    return sequences.sampled(_gps(spark, sf_dir))


def eta_by_ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival estimates of every ping on the route through its van's logged stops, slowed by the active zones."""
    return views.ping_estimates(spark, sf_dir)


def first_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each ping in any active zone the first by name, with its speed factor."""
    log = _gps(spark, sf_dir).select("record_id", F.col("location.longitude").alias("x"), F.col("location.latitude").alias("y"))
    return views.first_zones(spark, sf_dir, log)


def vans_by_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vans are at each risk; levels without a van are there with 0."""
    levels = spark.createDataFrame([(r,) for r in RISK], "sla_risk string")
    counts = views.live_vans(spark, sf_dir).groupBy("sla_risk").agg(F.count("*").alias("n"))
    return levels.join(counts, "sla_risk", "left").select("sla_risk", F.coalesce("n", F.lit(0)).alias("vans"))


def ingest_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the ingest lag in milliseconds by status."""
    rows = _gps(spark, sf_dir).where("device_timestamp is not null and ingestion_timestamp is not null")
    lag = rows.select("status", lag_ms(F.col("device_timestamp"), F.col("ingestion_timestamp")).alias("ms"))
    found = exact_percentiles(lag, "status", "ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}).withColumnRenamed("n", "pings")
    return found.withColumns({c: F.round(c, 3) for c in ("p50_ms", "p95_ms", "p99_ms")})


def lag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative histogram of the ingest lag by status, and out of it the 95th percentile."""
    rows = _gps(spark, sf_dir).where("status is not null and device_timestamp is not null and ingestion_timestamp is not null")
    lag = rows.select("status", lag_ms(F.col("device_timestamp"), F.col("ingestion_timestamp")).alias("ms"))
    buckets = health.latency_buckets(lag, "ms", [100, 250, 500, 1000, 5000, 60_000, 3_600_000], "status")
    return buckets.join(health.histogram_quantile(buckets, 0.95, "status").withColumnRenamed("value", "p95_ms"), "status").where("le < 1e18").select("status", "le", "n", F.round("p95_ms", 3).alias("p95_ms"))


def eta_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far predicted arrivals were off, by severity."""
    return deliveries.prediction_errors(load(spark, sf_dir, "sla_breaches")).select("severity", "n", F.round("p50_s", 4).alias("p50_s"), F.round("p90_s", 4).alias("p90_s"))


def track_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the line through each route's pings."""
    return tables.track_lengths(_gps(spark, sf_dir)).withColumn("track_km", F.round("track_km", 4))


def route_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each route, taken anew from its delivery rows."""
    return tables.with_counts(load(spark, sf_dir, "completed_routes"), load(spark, sf_dir, "delivery_logs")).select("route_id", "completed_stops", "failed_stops")


def finished_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What completion writes for each ended route."""
    routes, logs = load(spark, sf_dir, "completed_routes"), load(spark, sf_dir, "delivery_logs")
    done = tables.finished_routes(routes, logs, _gps(spark, sf_dir))
    return done.withColumns({c: F.round(c, 3) for c in ("minutes", "track_km", "avg_speed_kmh")}).select("route_id", "completed_stops", "failed_stops", "minutes", "track_km", "avg_speed_kmh")


def newest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest route of each van."""
    routes = load(spark, sf_dir, "completed_routes")
    best = F.max(F.struct("created_at", "route_id"))
    return routes.where("van_id is not null").groupBy("van_id").agg(best.alias("b")).select("van_id", "b.route_id", micros("b.created_at").alias("created_us"))


def leg_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and bearing from each first-logged stop of a route to the next."""
    logs = load(spark, sf_dir, "delivery_logs").where("route_id is not null and stop_index is not null and location is not null")
    first = logs.groupBy("route_id", "stop_index").agg(F.min_by("location", F.struct("created_at", "id")).alias("at"))
    w = Window.partitionBy("route_id").orderBy("stop_index")  # the stops of one route
    legs = first.withColumn("to", F.lead("at").over(w)).where("to is not null")
    a, b = [F.col(f"at.{c}") for c in ("latitude", "longitude")], [F.col(f"to.{c}") for c in ("latitude", "longitude")]
    return legs.select("route_id", "stop_index", F.round(haversine_km(*a, *b), 6).alias("km"), F.round(bearing_deg(*a, *b), 4).alias("bearing"))


def zones_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the active zones of each type, in one text."""
    zones = load(spark, sf_dir, "geofence_zones").where("active")
    return zones.groupBy("zone_type").agg(F.concat_ws(",", F.sort_array(F.collect_list("name"))).alias("names"))  # zones of a type: a few


def retained_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches that retention keeps: of the seven days up to the newest."""
    rows = load(spark, sf_dir, "sla_breaches")
    newest = rows.agg(F.max("detected_at")).first()[0]
    cutoff = F.lit(newest) - F.expr("interval 7 days")
    return tables.retained(rows, "detected_at", cutoff).select("id", "van_id", "breach_seconds")


def routes_without_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that no failed delivery refers to."""
    failed = load(spark, sf_dir, "delivery_logs").where("delivery_status = 'FAILED'")
    return load(spark, sf_dir, "completed_routes").join(failed, "route_id", "left_anti").select("route_id", "van_id")


def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health over hourly windows of the log's counters, and by the vans that are silent; no table holds the free disk."""
    log = _gps(spark, sf_dir)
    samples = health.with_silence(health.pipeline_samples(log), log).withColumn("disk_free", F.lit(1.0))
    return health.report(samples, 3600).withColumn("problems", F.concat_ws("; ", "problems"))


def counter_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the pipeline's counters over windows of an hour."""
    return health.deltas(health.pipeline_samples(_gps(spark, sf_dir)), health.COUNTERS, 3600).select("at_s", "window_s", "d_received", "d_processed", "d_rejected")


def dispatch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest van and position for an order in the middle of each active zone, of the vans under way in the live table."""
    boxes = parsed_zones(load(spark, sf_dir, "geofence_zones").where("active").select("id", "geometry")).where("polygons is not null")
    ring = F.get(F.get("polygons", F.lit(0)), F.lit(0))
    mid = lambda c: (F.array_min(F.transform(ring, lambda p: p[c])) + F.array_max(F.transform(ring, lambda p: p[c]))) / 2
    live = staged(views.live_vans(spark, sf_dir).where("status in ('EN_ROUTE', 'DELIVERING') and lat is not null and lon is not null"), "under-way")
    now = F.col("updated_epoch_ms") / 1000
    orders = boxes.select(F.col("id").alias("order_id"), mid("y").alias("lat"), mid("x").alias("lon"))
    newest = live.agg(F.max(now).alias("now_s"))
    orders = orders.join(F.broadcast(newest)).withColumn("deadline_s", F.col("now_s") + 1200)
    plans = sequences.plans_from_logs(load(spark, sf_dir, "delivery_logs"))
    stops = F.transform(F.arrays_zip("lats", "lons", "deadlines"), lambda s: F.struct(s["lats"].alias("lat"), s["lons"].alias("lon"), s["deadlines"].alias("planned_s"), s["deadlines"].alias("deadline_s")))
    serving = F.col("status") == "DELIVERING"
    vans = live.join(plans, ["van_id", "route_id"]).select(
        "van_id", "lat", "lon", serving.alias("serving"), (F.col("current_stop") + serving.cast("int")).alias("next"), (F.when(F.col("speed_kmh") > 5, F.col("speed_kmh")).otherwise(30.0) / 3.6).alias("speed_mps"),
        F.lit(0.0).alias("delay_s"), stops.alias("stops"), F.element_at("lats", -1).alias("hub_lat"), F.element_at("lons", -1).alias("hub_lon"),
    )
    return dispatch.assignments(orders, vans).withColumn("predicted_arrival_s", F.round("predicted_arrival_s", 3))


def nation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay ranking over line items: nations as zones, quantities as delays."""
    items = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint") * 7).alias("s"))
    suppliers, nations = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    return (
        items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("zone_name")).agg(F.sum("n").alias("breach_count"), F.sum("s").alias("total_breach_seconds"))
        .orderBy(F.desc("total_breach_seconds"), "zone_name").limit(10)
    )


QUERIES = {
    f.__name__: f
    for f in (
        window_dedup, bloom_dedup, plan_selection, dedup_counters, dedup_events, late_pings, archive_sample, throttled_updates, sampled_updates, eta_by_ping, first_zone, vans_by_risk, ingest_lag, lag_histogram, eta_errors, track_lengths, route_counters,
        finished_routes, newest_routes, leg_geometry, zones_by_type, retained_breaches, routes_without_failures, pipeline_health, counter_growth, dispatch_orders, nation_ranking,
    )
}

_HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians({b}.latitude - {a}.latitude) / 2) ** 2 + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * sin(radians({b}.longitude - {a}.longitude) / 2) ** 2)))"

_TRACK = f"""
WITH l AS (
  SELECT route_id, location AS b, lag(location) OVER (PARTITION BY route_id ORDER BY device_timestamp, record_id) AS a FROM gps_event
  WHERE route_id IS NOT NULL AND device_timestamp IS NOT NULL AND location.latitude IS NOT NULL AND location.longitude IS NOT NULL
), t AS (SELECT route_id, sum({_HAVERSINE.format(a="a", b="b")}) FILTER (a IS NOT NULL) / 1000 AS track_km, count(*) AS pings FROM l GROUP BY 1 HAVING count(*) > 1)
"""

_SAMPLES = """
WITH r AS (
  SELECT CAST(floor(epoch_us(ingestion_timestamp) / 900e6) AS BIGINT) * 900 AS at_s,
    event_id IS NULL OR van_id IS NULL OR route_id IS NULL OR device_timestamp IS NULL OR location IS NULL OR location.latitude IS NULL
    OR location.longitude IS NULL OR status IS NULL AS bad FROM gps_event WHERE ingestion_timestamp IS NOT NULL
), c AS (SELECT at_s, count(*) AS n, count(*) FILTER (NOT bad) AS p, count(*) FILTER (bad) AS j FROM r GROUP BY 1),
s AS (SELECT at_s, CAST(sum(n) OVER o AS BIGINT) AS received, CAST(sum(p) OVER o AS BIGINT) AS processed, CAST(sum(j) OVER o AS BIGINT) AS rejected FROM c WINDOW o AS (ORDER BY at_s))
"""

# The sequential operators, row after row by recursion: {order} is the order of a van's rows, {start} and {step} its state.
_STEPS = """
WITH RECURSIVE b AS (
  SELECT record_id, van_id, coalesce(sequence_number, 0) AS seq, epoch_us(device_timestamp) AS ts_us, epoch_us(coalesce(ingestion_timestamp, device_timestamp)) AS at_us, status
  FROM gps_event WHERE van_id IS NOT NULL AND device_timestamp IS NOT NULL AND record_id IS NOT NULL
), a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY van_id ORDER BY {order}) AS rn FROM b), r AS (
  SELECT van_id, rn, record_id, seq, {start} FROM a WHERE rn = 1
  UNION ALL
  SELECT a.van_id, a.rn, a.record_id, a.seq, {step} FROM r JOIN a ON a.van_id = r.van_id AND a.rn = r.rn + 1
)"""

_VERDICTS = (
    _STEPS.format(
        order="at_us, record_id",
        start="seq AS top, 0 AS epoch, CAST(-1 AS BIGINT) AS behind",
        step="CASE WHEN r.top - a.seq >= 1000000 THEN a.seq ELSE greatest(r.top, a.seq) END, r.epoch + CASE WHEN r.top - a.seq >= 1000000 THEN 1 ELSE 0 END, r.top - a.seq",
    )
    + """, verdicts AS (
  SELECT record_id, CASE WHEN behind >= 1000000 THEN 'reset' WHEN behind < 0 THEN 'new' WHEN behind >= 4096 THEN 'too_old'
    WHEN row_number() OVER (PARTITION BY van_id, epoch, seq ORDER BY rn) > 1 THEN 'duplicate' ELSE 'new' END AS verdict FROM r)
"""
)

_HEALTH = (
    _SAMPLES
    + """, heard AS (
  SELECT van_id, CAST(floor(epoch_us(ingestion_timestamp) / 900e6) AS BIGINT) AS slot, max(epoch_us(ingestion_timestamp)) AS us FROM gps_event
  WHERE ingestion_timestamp IS NOT NULL AND event_id IS NOT NULL AND van_id IS NOT NULL AND route_id IS NOT NULL AND device_timestamp IS NOT NULL AND location.latitude IS NOT NULL
    AND location.longitude IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2
), seen AS (SELECT s.at_s, (SELECT count(DISTINCT van_id) FROM heard h WHERE h.slot * 900 <= s.at_s) AS vans,
  (SELECT count(DISTINCT van_id) FROM heard h WHERE h.slot * 900 <= s.at_s AND s.at_s / 900 <= floor((h.us + 300000000) / 900e6) - 1) AS alive FROM s
), d AS (
  SELECT s.at_s, s.at_s - b.at_s AS window_s, s.received - b.received AS n, s.processed - b.processed AS p, s.rejected - b.rejected AS j, vans, vans - alive AS silent
  FROM s JOIN seen USING (at_s) JOIN s b ON b.at_s = coalesce((SELECT max(x.at_s) FROM s x WHERE x.at_s <= s.at_s - 3600), (SELECT min(x.at_s) FROM s x WHERE x.at_s >= s.at_s - 3600))
), e AS (SELECT *, CASE WHEN n > 0 THEN j / n ELSE 0.0 END AS bad, CASE WHEN vans > 0 THEN silent / vans ELSE 0.0 END AS still FROM d
), f AS (
  SELECT *, concat_ws('; ', CASE WHEN bad > 0.2 THEN printf('rejection rate %.1f%%', CAST(bad * 100 AS DOUBLE)) END, CASE WHEN n > 0 AND p = 0 THEN 'pings arrive but none is processed' END,
    CASE WHEN n = 0 AND window_s >= 3600 THEN 'no pings arrive' END, CASE WHEN still > 0.05 THEN printf('%d of %d vans are silent', silent, vans) END) AS problems FROM e
)
"""
)

_DISPATCH = (
    LIVE
    + """, under_way AS (SELECT * FROM live_vans WHERE status IN ('EN_ROUTE', 'DELIVERING') AND lat IS NOT NULL AND lon IS NOT NULL
), asked AS (
  SELECT zone_id AS order_id, (min(x1) + max(x1)) / 2 AS olon, (min(y1) + max(y1)) / 2 AS olat, (SELECT max(updated_epoch_ms) / 1000 FROM under_way) AS now_s FROM e WHERE pid = 1 AND rid = 1 GROUP BY 1
), ready AS (
  SELECT u.van_id, u.route_id, u.lat, u.lon, u.status = 'DELIVERING' AS serving, u.current_stop + CAST(u.status = 'DELIVERING' AS INTEGER) AS nxt, CASE WHEN u.speed_kmh > 5 THEN u.speed_kmh ELSE 30.0 END / 3.6 AS mps, p.n
  FROM under_way u JOIN plan p USING (van_id, route_id)
), position AS (SELECT *, unnest(range(nxt, n + 1)) AS k FROM ready WHERE nxt >= 0 AND nxt <= n
), pair AS (
  SELECT r.*, CASE WHEN r.k = nxt AND NOT serving THEN r.lat ELSE b.lat END AS plat, CASE WHEN r.k = nxt AND NOT serving THEN r.lon ELSE b.lon END AS plon, coalesce(c.lat, b.lat) AS qlat, coalesce(c.lon, b.lon) AS qlon,
    b.deadline AS before_s, (SELECT count(*) FROM stop2 l WHERE l.van_id = r.van_id AND l.route_id = r.route_id AND l.k >= r.k AND l.deadline IS NOT NULL) AS later
  FROM position r LEFT JOIN stop2 b ON b.van_id = r.van_id AND b.route_id = r.route_id AND b.k = r.k - 1 LEFT JOIN stop2 c ON c.van_id = r.van_id AND c.route_id = r.route_id AND c.k = r.k
), way AS (
  SELECT p.*, o.*, """
    + f"{HAVERSINE.format(lat1='plat', lon1='plon', lat2='olat', lon2='olon')} AS there, {HAVERSINE.format(lat1='olat', lon1='olon', lat2='qlat', lon2='qlon')} AS onward, {HAVERSINE.format(lat1='plat', lon1='plon', lat2='qlat', lon2='qlon')} AS direct"
    + """ FROM pair p CROSS JOIN asked o
), costed AS (
  SELECT *, 1.3 * (there + onward - direct) AS extra_m,
    CASE WHEN k = nxt AND NOT serving THEN now_s WHEN k = nxt THEN now_s + 40 ELSE greatest(now_s, before_s) + 40 END + 1.3 * there / mps AS arrival_s FROM way
), ranked AS (
  SELECT *, arrival_s <= now_s + 1200 AS on_time, count(*) OVER (PARTITION BY order_id) AS options_considered,
    row_number() OVER (PARTITION BY order_id ORDER BY extra_m / 1000 + 5.0 * later + CASE WHEN arrival_s <= now_s + 1200 THEN 0.0 ELSE 5.0 END, arrival_s, van_id, k) AS place FROM costed
)
SELECT order_id, van_id, CAST(k AS INTEGER) AS insert_before, floor(extra_m / 10 + 0.5) / 100 AS extra_km, round(arrival_s, 3) AS predicted_arrival_s, CAST(later AS INTEGER) AS stops_made_late, on_time, options_considered
FROM ranked WHERE place = 1"""
)

SQL = {
    "window_dedup": _VERDICTS + "SELECT record_id, verdict FROM verdicts",
    "dedup_counters": _VERDICTS + "SELECT verdict, count(*) AS pings, round(count(*) * 100 / (SELECT count(*) FROM verdicts), 3) AS percent FROM verdicts GROUP BY 1",
    "archive_sample": _STEPS.format(
        order="ts_us, seq, record_id", start="ts_us AS last, true AS kept",
        step="CASE WHEN a.ts_us - r.last >= 30000000 OR coalesce(a.status = 'RETURNED', false) THEN a.ts_us ELSE r.last END, a.ts_us - r.last >= 30000000 OR coalesce(a.status = 'RETURNED', false)",
    ) + "SELECT record_id, van_id FROM r WHERE kept",
    "throttled_updates": _STEPS.format(
        order="at_us, record_id", start="at_us AS last, status, true AS kept",
        step="CASE WHEN a.at_us - r.last >= 60000000 OR a.status IS DISTINCT FROM r.status THEN a.at_us ELSE r.last END, CASE WHEN a.at_us - r.last >= 60000000 OR a.status IS DISTINCT FROM r.status THEN a.status ELSE r.status END,"
        " a.at_us - r.last >= 60000000 OR a.status IS DISTINCT FROM r.status",
    ) + "SELECT record_id, van_id FROM r WHERE kept",
    "plan_selection": """
WITH RECURSIVE p AS (
  SELECT van_id, route_id, 0 AS version, epoch_us(planned_start) AS made, epoch_us(created_at) AS arrival FROM completed_routes UNION ALL
  SELECT van_id, route_id, 1, epoch_us(planned_start), epoch_us(actual_start) FROM completed_routes UNION ALL SELECT van_id, route_id, 1, epoch_us(planned_start), epoch_us(actual_end) FROM completed_routes
), a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY van_id ORDER BY arrival, route_id, version) AS rn FROM p WHERE van_id IS NOT NULL AND route_id IS NOT NULL AND arrival IS NOT NULL
), r AS (
  SELECT van_id, rn, route_id, version, arrival, true AS accepted, route_id AS held, version AS at_version, made AS since FROM a WHERE rn = 1
  UNION ALL
  SELECT van_id, rn, route_id, version, arrival, NOT refused, CASE WHEN refused THEN held ELSE route_id END, CASE WHEN refused THEN at_version ELSE version END, CASE WHEN refused THEN since ELSE made END FROM (
    SELECT a.*, r.held, r.at_version, r.since, CASE WHEN a.route_id = r.held THEN a.version <= r.at_version ELSE coalesce(a.made < r.since, false) END AS refused FROM r JOIN a ON a.van_id = r.van_id AND a.rn = r.rn + 1)
)
SELECT van_id, route_id, version, arrival, accepted FROM r""",
    "lag_histogram": """
WITH m AS (
  SELECT status, greatest(0, floor((epoch_us(ingestion_timestamp) - epoch_us(device_timestamp)) / 1000.0)) AS ms FROM gps_event
  WHERE status IS NOT NULL AND device_timestamp IS NOT NULL AND ingestion_timestamp IS NOT NULL
), b AS (SELECT status, CAST(le AS DOUBLE) AS le, count(*) FILTER (ms <= le) AS n, count(*) AS whole FROM m CROSS JOIN (VALUES (100), (250), (500), (1000), (5000), (60000), (3600000)) AS v(le) GROUP BY 1, 2),
c AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0.0) AS low, whole * 0.95 AS need FROM b WINDOW w AS (PARTITION BY status ORDER BY le)),
q AS (SELECT status, max(low + (le - low) * (need - below) / (n - below)) AS v FROM c WHERE n >= need AND below < need GROUP BY 1)
SELECT c.status, c.le, c.n, round(coalesce(q.v, 3600000.0), 3) AS p95_ms FROM c LEFT JOIN q USING (status)""",
    "pipeline_health": _HEALTH
    + """
SELECT at_s, CASE WHEN problems <> '' THEN 'DEGRADED' WHEN window_s < 1800 THEN 'WARMING_UP' ELSE 'OK' END AS status, window_s, floor(bad * 100 * 10 + 0.5) / 10 AS rejected_pct,
  floor(CASE WHEN window_s > 0 THEN n / window_s ELSE 0.0 END * 10 + 0.5) / 10 AS received_per_s, problems FROM f""",
    "dispatch_orders": _DISPATCH,
    "eta_by_ping": ESTIMATES + "SELECT * FROM told",
    "first_zone": IN_ZONES
    + """
SELECT DISTINCT ON (record_id) record_id, g.name AS zone_name, CAST(coalesce(g.speed_factor, 1.0) AS DOUBLE) AS speed_factor
FROM inside i JOIN geofence_zones g ON g.id = i.zone_id ORDER BY record_id, g.name, g.id""",
    "dedup_events": """
WITH b AS (
  SELECT user_id AS van_id, event_id AS seq,
         event_id * 50 + (CAST(json_extract_string(props, '$.k') AS BIGINT) * 97) % 9000 AS at_ms FROM events
), r AS (SELECT * FROM b UNION ALL SELECT van_id, seq, at_ms + 250 FROM b),
h AS (SELECT *, max(seq) OVER (PARTITION BY van_id ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h,
             row_number() OVER (PARTITION BY van_id, seq ORDER BY at_ms) AS n FROM r)
SELECT van_id, seq, at_ms, CASE WHEN h IS NULL OR h < seq THEN 'new' WHEN h - seq >= 4096 THEN 'too_old' WHEN n > 1 THEN 'duplicate' ELSE 'new' END AS verdict FROM h""",
    "late_pings": """
WITH a AS (
  SELECT record_id, van_id, epoch_us(device_timestamp) AS ts_us, epoch_us(coalesce(ingestion_timestamp, device_timestamp)) AS at_us FROM gps_event
  WHERE van_id IS NOT NULL AND device_timestamp IS NOT NULL
), r AS (
  SELECT van_id, clock, max(max(ts_us)) OVER (PARTITION BY van_id ORDER BY clock) AS top
  FROM (SELECT van_id, greatest(at_us, ts_us + 3000001) AS clock, ts_us FROM a) GROUP BY van_id, clock
)
SELECT a.record_id, a.van_id, a.ts_us, a.at_us FROM a ASOF JOIN r ON r.van_id = a.van_id AND a.at_us >= r.clock WHERE r.top > a.ts_us""",
    "sampled_updates": """
SELECT van_id, slot_s, last(record_id ORDER BY at_us, record_id) AS record_id FROM (
  SELECT record_id, van_id, epoch_us(coalesce(ingestion_timestamp, device_timestamp)) AS at_us,
         CAST(floor(epoch_us(coalesce(ingestion_timestamp, device_timestamp)) / 60e6) AS BIGINT) * 60 AS slot_s FROM gps_event
  WHERE van_id IS NOT NULL AND device_timestamp IS NOT NULL) GROUP BY 1, 2""",
    "ingest_lag": """
SELECT status, count(*) AS pings, round(quantile_cont(ms, 0.5), 3) AS p50_ms, round(quantile_cont(ms, 0.95), 3) AS p95_ms, round(quantile_cont(ms, 0.99), 3) AS p99_ms FROM (
  SELECT status, CAST(greatest(0, floor((epoch_us(ingestion_timestamp) - epoch_us(device_timestamp)) / 1000.0)) AS DOUBLE) AS ms FROM gps_event
  WHERE device_timestamp IS NOT NULL AND ingestion_timestamp IS NOT NULL) GROUP BY 1""",
    "eta_errors": """
SELECT severity, count(*) AS n, round(quantile_cont(s, 0.5), 4) AS p50_s, round(quantile_cont(s, 0.9), 4) AS p90_s FROM (
  SELECT severity, abs(epoch_us(actual_arrival) - epoch_us(predicted_arrival)) / 1e6 AS s FROM sla_breaches
  WHERE actual_arrival IS NOT NULL AND predicted_arrival IS NOT NULL) GROUP BY 1""",
    "track_lengths": _TRACK + "SELECT route_id, round(track_km, 4) AS track_km, pings FROM t",
    "route_counters": """
SELECT r.route_id, CAST(coalesce(c, 0) AS INTEGER) AS completed_stops, CAST(coalesce(f, 0) AS INTEGER) AS failed_stops FROM completed_routes r LEFT JOIN (
  SELECT route_id, count(*) FILTER (delivery_status = 'COMPLETED') AS c, count(*) FILTER (delivery_status = 'FAILED') AS f FROM delivery_logs GROUP BY 1) l
ON l.route_id = r.route_id""",
    "finished_routes": _TRACK
    + """
SELECT r.route_id, CAST(coalesce(c, 0) AS INTEGER) AS completed_stops, CAST(coalesce(f, 0) AS INTEGER) AS failed_stops, round(m, 3) AS minutes, round(track_km, 3) AS track_km,
       round(least(999.99, track_km / nullif(m / 60, 0)), 3) AS avg_speed_kmh
FROM (SELECT *, (epoch_us(actual_end) - epoch_us(coalesce(actual_start, planned_start))) / 6e7 AS m FROM completed_routes WHERE actual_end IS NOT NULL) r
LEFT JOIN (SELECT route_id, count(*) FILTER (delivery_status = 'COMPLETED') AS c, count(*) FILTER (delivery_status = 'FAILED') AS f FROM delivery_logs GROUP BY 1) l ON l.route_id = r.route_id
LEFT JOIN t ON t.route_id = r.route_id""",
    "newest_routes": """
SELECT DISTINCT ON (van_id) van_id, route_id, epoch_us(created_at) AS created_us FROM completed_routes WHERE van_id IS NOT NULL ORDER BY van_id, created_at DESC, route_id DESC""",
    "leg_geometry": f"""
WITH f AS (SELECT DISTINCT ON (route_id, stop_index) route_id, stop_index, location AS a FROM delivery_logs
  WHERE route_id IS NOT NULL AND stop_index IS NOT NULL AND location IS NOT NULL ORDER BY route_id, stop_index, created_at, id),
l AS (SELECT *, lead(a) OVER (PARTITION BY route_id ORDER BY stop_index) AS b FROM f)
SELECT route_id, stop_index, round({_HAVERSINE.format(a="a", b="b")} / 1000, 6) AS km,
  round((degrees(atan2(sin(radians(b.longitude - a.longitude)) * cos(radians(b.latitude)),
    cos(radians(a.latitude)) * sin(radians(b.latitude)) - sin(radians(a.latitude)) * cos(radians(b.latitude)) * cos(radians(b.longitude - a.longitude)))) + 360) % 360, 4) AS bearing
FROM l WHERE b IS NOT NULL""",
    "zones_by_type": "SELECT zone_type, string_agg(name, ',' ORDER BY name) AS names FROM geofence_zones WHERE active GROUP BY 1",
    "retained_breaches": "SELECT id, van_id, breach_seconds FROM sla_breaches WHERE detected_at IS NULL OR detected_at >= (SELECT max(detected_at) FROM sla_breaches) - INTERVAL 7 DAY",
    "routes_without_failures": "SELECT route_id, van_id FROM completed_routes r WHERE NOT EXISTS (SELECT 1 FROM delivery_logs l WHERE l.route_id = r.route_id AND l.delivery_status = 'FAILED')",
    "counter_growth": _SAMPLES
    + """
SELECT s.at_s, s.at_s - b.at_s AS window_s, s.received - b.received AS d_received, s.processed - b.processed AS d_processed, s.rejected - b.rejected AS d_rejected
FROM s JOIN s b ON b.at_s = coalesce((SELECT max(x.at_s) FROM s x WHERE x.at_s <= s.at_s - 3600), (SELECT min(x.at_s) FROM s x WHERE x.at_s >= s.at_s - 3600))""",
    "nation_ranking": """
SELECT n_name AS zone_name, count(*) AS breach_count, CAST(sum(CAST(l_quantity AS BIGINT) * 7) AS BIGINT) AS total_breach_seconds
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1 ORDER BY total_breach_seconds DESC, zone_name LIMIT 10""",
}
