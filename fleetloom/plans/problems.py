"""Queries of the data-processing problems over the fleet tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.operators import exactly_once as once
from fleetloom.operators import intervals, late_periods, quantiles, spatial, stops
from fleetloom.session import load, staged


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Van hours that were corrected after publication, and those with records past the cut-off."""
    table = late_periods.replay(once.exactly_once(load(spark, sf_dir, "gps_event")))
    corrected = table.current().where("late_pings > 0").select("van_id", "period_start", F.lit("corrected").alias("outcome"))
    return corrected.union(table.cut().select("van_id", "period_start", F.lit("cut").alias("outcome")))


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregates of every van hour, as first published and as corrected."""
    table = late_periods.replay(once.exactly_once(load(spark, sf_dir, "gps_event")))
    return table.current().withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in ("first_avg_speed", "avg_speed")})  # means of few pings often lie half-way


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are a later copy of a message."""
    return once.duplicates(load(spark, sf_dir, "gps_event")).select("record_id")


def p2_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disjoint ranges of sequence numbers seen of each van at the end of the log."""
    states = once.seen_ranges(once.message_rows(load(spark, sf_dir, "gps_event")), 3)
    return states[-1].select("van_id", "lo", "hi")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of each van, by the ten-minute slot of their midpoint."""
    return stops.stops(load(spark, sf_dir, "gps_event")).select(
        "van_id", F.floor((F.col("start_s") + F.col("end_s")) / 2 / 600).alias("mid_slot")
    )


def p3_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops with start, end, duration and place."""
    found = stops.stops(load(spark, sf_dir, "gps_event")).withColumns({c: F.round(c, 3) for c in ("start_s", "end_s", "duration_s")})
    return found.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in ("lat", "lon")})  # means of few pings often lie half-way


def p3_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips between stops with start, end, duration and distance."""
    return stops.trips(load(spark, sf_dir, "gps_event")).withColumns({c: F.round(c, n) for c, n in (("start_s", 3), ("end_s", 3), ("duration_s", 3), ("distance_m", 2))})


def p3_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings that stops and trips don't use, by reason."""
    return stops.left_out(load(spark, sf_dir, "gps_event"))


def _breach_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to be measured, one for each event: van_id, day, v. An event without id stands for itself."""
    event = F.coalesce("event_id", F.concat(F.lit("row "), F.col("id")))
    seen = F.struct(F.col("detected_at").isNull(), F.col("detected_at"), F.col("id"), F.col("van_id"), F.col("breach_seconds"))
    return (
        load(spark, sf_dir, "sla_breaches")
        .where("breach_seconds > 0 and breach_seconds < 2147483647")
        .groupBy(event.alias("event"))
        .agg(F.min(seen).alias("first"))
        .select("first.van_id", F.to_date("first.detected_at").alias("day"), F.col("first.breach_seconds").alias("v"))
    )


P4_LIMITS = {50: 150, 90: 450, 99: 1500}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vans and percentiles of breach seconds above their limit."""
    values = staged(_breach_seconds(spark, sf_dir).where("van_id is not null").select("van_id", "v"), "breach-seconds")
    sketched = quantiles.merged(quantiles.sketches(values, "van_id", "v"), "van_id")
    return quantiles.above(sketched, values, "van_id", "v", P4_LIMITS, least=20)


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each van, out of sketches of partitions: estimates with bounded error."""
    sketched = quantiles.merged(quantiles.sketches(_breach_seconds(spark, sf_dir), "van_id", "v"), "van_id")
    return quantiles.percentiles(sketched, "van_id", [50, 90, 95, 99, 99.9])


def p4_counts_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of single days, merged over the days: how many values each van's sketch stands for."""
    keyed = _breach_seconds(spark, sf_dir).where("van_id is not null and day is not null")
    daily = quantiles.merged(
        quantiles.sketches(keyed.select(F.concat_ws("|", "day", "van_id").alias("van_day"), "v"), "van_day", "v"), "van_day"
    ).select(F.split("van_day", "[|]", 2)[1].alias("van_id"), "n", "sketch")
    return quantiles.merged(daily, "van_id").select("van_id", "n")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active zones that contain each ping."""
    pings = load(spark, sf_dir, "gps_event").select("record_id", F.col("location.longitude").alias("x"), F.col("location.latitude").alias("y"))
    zones = load(spark, sf_dir, "geofence_zones").where("active").select(F.col("id").alias("zone_id"), "geometry")
    return spatial.regions_of_points(pings, zones, point_id="record_id", x="x", y="y", region_id="zone_id", geometry="geometry")


def p5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each delivery, how many others were within 150 m, and how far the nearest was."""
    rows = load(spark, sf_dir, "delivery_logs").select("id", F.col("location.longitude").alias("x"), F.col("location.latitude").alias("y"))
    return spatial.near_counts(rows, point_id="id", x="x", y="y", metres=150.0).withColumn("nearest_m", F.round("nearest_m", 3))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of more than 30 minutes and less than 6 hours between a van's busy periods."""
    spans = intervals.valid_intervals(load(spark, sf_dir, "delivery_logs"), "van_id", "actual_arrival", "actual_departure", 12 * 3600)
    length = F.col("gap_end_us") - F.col("gap_start_us")
    return (
        intervals.gaps(spans, "van_id")
        .where((length > 1800 * 1_000_000) & (length < 21_600 * 1_000_000))
        .select("van_id", F.floor(F.col("gap_start_us") / 1000).alias("gap_start"), F.floor(F.col("gap_end_us") / 1000).alias("gap_end"))
    )


def p6_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy periods of each van, in epoch microseconds."""
    spans = intervals.valid_intervals(load(spark, sf_dir, "delivery_logs"), "van_id", "actual_arrival", "actual_departure", 12 * 3600)
    return intervals.periods(spans, "van_id").select("van_id", F.col("s").alias("period_start"), F.col("e").alias("period_end"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_periods, p2_found, p2_ranges, p3_found, p3_stops, p3_trips, p3_left_out, p4_found, p4_percentiles, p4_counts_by_day,
        p5_found, p5_near, p6_found, p6_periods,
    )
}

# Messages of gps_event: every row with the least row of its chain of copies.
_MESSAGES = """
WITH RECURSIVE bare AS MATERIALIZED (
  SELECT *, translate(lower(event_id), '{}- ' || chr(9) || chr(10) || chr(13), '') AS b FROM gps_event
), ids AS MATERIALIZED (
  SELECT record_id, van_id, sequence_number AS seq, device_timestamp AS dev, ingestion_timestamp AS ing, speed_kmh, battery_pct,
         CASE WHEN starts_with(b, 'urn:uuid:') THEN substr(b, 10) ELSE b END AS u FROM bare
), k AS MATERIALIZED (
  SELECT record_id, 'u' || u AS key FROM ids WHERE regexp_full_match(u, '[0-9a-f]{32}') AND u <> repeat('0', 32)
  UNION ALL
  SELECT record_id, 's' || van_id || '/' || seq || '/' || epoch_us(dev) FROM ids
  WHERE van_id IS NOT NULL AND seq IS NOT NULL AND dev IS NOT NULL
), g AS MATERIALIZED (SELECT key, min(record_id) AS hub FROM k GROUP BY key HAVING count(*) > 1),
e AS MATERIALIZED (SELECT DISTINCT k.record_id AS a, g.hub AS b FROM k JOIN g ON k.key = g.key WHERE k.record_id <> g.hub),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a
), whole AS MATERIALIZED (SELECT a, b FROM reach UNION SELECT a, a FROM both_ways),
ranked AS MATERIALIZED (
  SELECT w.a, min({'ing': coalesce(y.ing, TIMESTAMP '9999-01-01'), 'id': y.record_id}) AS first
  FROM whole w JOIN ids y ON y.record_id = w.b GROUP BY w.a
), lost AS MATERIALIZED (SELECT a AS record_id FROM ranked WHERE first.id <> a)
"""

_ARRIVED = (
    _MESSAGES
    + """, m AS (
  SELECT van_id, CAST(floor(epoch_us(dev) / 3600e6) AS BIGINT) * 3600 AS period_start, speed_kmh, battery_pct,
         epoch_us(coalesce(ing, dev)) AS at_us
  FROM ids WHERE van_id IS NOT NULL AND dev IS NOT NULL AND record_id NOT IN (SELECT record_id FROM lost)
), t AS (SELECT *, at_us - (period_start + 3600) * 1000000 AS late_us FROM m)
"""
)

_VALUES = """
WITH v AS (
  SELECT DISTINCT ON (coalesce(event_id, 'row ' || id)) van_id, CAST(detected_at AS DATE) AS day, breach_seconds AS v FROM sla_breaches
  WHERE breach_seconds > 0 AND breach_seconds < 2147483647
  ORDER BY coalesce(event_id, 'row ' || id), detected_at NULLS LAST, id
)
"""

_PERIODS = """
WITH i AS (
  SELECT DISTINCT van_id, epoch_us(actual_arrival) AS s, epoch_us(actual_departure) AS e FROM delivery_logs
  WHERE van_id IS NOT NULL AND actual_departure >= actual_arrival AND epoch_us(actual_departure) - epoch_us(actual_arrival) <= 43200000000
), r AS (SELECT *, max(e) OVER (PARTITION BY van_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < s THEN 1 ELSE 0 END) OVER (PARTITION BY van_id ORDER BY s, e) AS no FROM r),
p AS (SELECT van_id, no, min(s) AS period_start, max(e) AS period_end FROM n GROUP BY 1, 2)
"""

# Geometries of either notation as nested lists, their edges, and the even-odd rule by counting crossings.
IN_ZONES = r"""
WITH t AS (SELECT id AS zone_id, trim(geometry) AS g FROM geofence_zones WHERE active AND geometry IS NOT NULL),
b AS (SELECT *, replace(replace(regexp_replace(substr(g, strpos(g, '(')), '(-?[0-9.]+)\s+(-?[0-9.]+)', '[\1,\2]', 'g'), '(', '['), ')', ']') AS w FROM t),
j AS (
  SELECT zone_id, CASE WHEN NOT starts_with(g, '{') THEN CASE WHEN upper(g) LIKE '%MULTIPOLYGON%' THEN w ELSE '[' || w || ']' END
    WHEN json_valid(g) THEN CASE lower(json_extract_string(g, '$.type')) WHEN 'polygon' THEN '[' || CAST(json_extract(g, '$.coordinates') AS VARCHAR) || ']'
      WHEN 'multipolygon' THEN CAST(json_extract(g, '$.coordinates') AS VARCHAR) END END AS c FROM b
), p AS (SELECT zone_id, CAST(from_json(c, '[[[["DOUBLE"]]]]') AS DOUBLE[][][][]) AS ps FROM j WHERE c IS NOT NULL AND json_valid(c)),
q AS (SELECT zone_id, unnest(range(1, len(ps) + 1)) AS pid, ps FROM p), r AS (SELECT zone_id, pid, ps[pid] AS rs, unnest(range(1, len(ps[pid]) + 1)) AS rid FROM q),
v AS (SELECT zone_id, pid, rid, rs[rid] AS ring, unnest(range(1, len(rs[rid]) + 1)) AS i FROM r),
e AS MATERIALIZED (SELECT zone_id, pid, rid, ring[i][1] AS x1, ring[i][2] AS y1, ring[i % len(ring) + 1][1] AS x2, ring[i % len(ring) + 1][2] AS y2 FROM v),
z AS (SELECT zone_id, min(x1) AS a, max(x1) AS c, min(y1) AS b, max(y1) AS d FROM e GROUP BY 1),
n AS MATERIALIZED (SELECT record_id, zone_id, location.longitude AS x, location.latitude AS y FROM gps_event JOIN z ON location.longitude BETWEEN a AND c AND location.latitude BETWEEN b AND d),
h AS (SELECT record_id, zone_id, pid, rid, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS odd FROM n JOIN e USING (zone_id) GROUP BY 1, 2, 3, 4),
inside AS (SELECT DISTINCT record_id, zone_id FROM (SELECT record_id, zone_id, pid FROM h GROUP BY 1, 2, 3 HAVING bool_or(odd AND rid = 1) AND NOT bool_or(odd AND rid > 1)))
"""

_HOW_FAR = "2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians({b}lat - {a}lat) / 2) ** 2 + cos(radians({a}lat)) * cos(radians({b}lat)) * sin(radians({b}lon - {a}lon) / 2) ** 2)))"
_LAG = "epoch_us(ingestion_timestamp) - epoch_us(device_timestamp)"

# Stops by windows, in spans of six hours with margins: strays out, each ping's window of five minutes, still windows, the steps they
# cover, chains of steps over all spans (a step belongs to the span of its later ping), chains of chains.
_STEP = _HOW_FAR.format(a="a", b="")
_STOPS = f"""
WITH u0 AS (
  SELECT DISTINCT ON (van_id, device_timestamp) van_id, epoch_us(device_timestamp) / 1e6 AS t, location.latitude AS lat, location.longitude AS lon FROM gps_event
  WHERE van_id IS NOT NULL AND device_timestamp IS NOT NULL AND location.latitude BETWEEN -90 AND 90 AND location.longitude BETWEEN -180 AND 180
    AND (ingestion_timestamp IS NULL OR {_LAG} BETWEEN -120000000 AND 604800000000) ORDER BY van_id, device_timestamp, ingestion_timestamp NULLS LAST, location.latitude, location.longitude
), u AS (SELECT *, unnest(list_distinct([floor((t - 2400) / 21600), floor(t / 21600), floor((t + 2400) / 21600)])) AS span FROM u0
), s0 AS (
  SELECT *, lon * 111195.0 * cos(radians(median(lat) OVER (PARTITION BY van_id, span))) AS x, lat * 111195.0 AS y, t - lag(t) OVER w > 1200 AS apart, lag(t) OVER w AS t0, lag(lat) OVER w AS alat, lag(lon) OVER w AS alon
  FROM u WINDOW w AS (PARTITION BY van_id, span ORDER BY t)
), s1 AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY van_id, span ORDER BY t) AS seg, CASE WHEN apart OR t0 IS NULL THEN 'inf'::DOUBLE ELSE {_STEP} / greatest(t - t0, 1e-6) END AS pace FROM s0
), s2 AS MATERIALIZED (
  SELECT *, count(*) OVER w >= 3 AND sqrt((x - median(x) OVER w) ** 2 + (y - median(y) OVER w) ** 2) > 60 AS stray, lead(pace) OVER (PARTITION BY van_id, span ORDER BY t) AS next_pace
  FROM s1 WINDOW w AS (PARTITION BY van_id, span, seg ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
), way0 AS (
  SELECT van_id, span, t, lat, lon, lag(lat) OVER w AS alat, lag(lon) OVER w AS alon FROM s2 WHERE NOT stray OR (pace <= 36 AND next_pace <= 36) WINDOW w AS (PARTITION BY van_id, span ORDER BY t)
), way AS MATERIALIZED (SELECT van_id, span, t, sum(coalesce({_STEP}, 0)) OVER (PARTITION BY van_id, span ORDER BY t) AS cum FROM way0
), g0 AS (SELECT van_id, span, t, lat, lon, x, y, lag(t) OVER w AS t0, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM s2 WHERE NOT stray WINDOW w AS (PARTITION BY van_id, span ORDER BY t)
), g AS MATERIALIZED (
  SELECT g0.van_id, g0.span, g0.t, lat, lon, x, y, t0, cum, cum - lag(cum) OVER w AS m, row_number() OVER w AS n, sum(CASE WHEN g0.t - t0 > 1200 THEN 1 ELSE 0 END) OVER w AS seg,
         sum(CASE WHEN t0 IS NULL OR g0.t - t0 > 1200 THEN 0 ELSE sqrt((x - x0) ** 2 + (y - y0) ** 2) END) OVER w AS path
  FROM g0 JOIN way ON way.van_id = g0.van_id AND way.span = g0.span AND way.t = g0.t WINDOW w AS (PARTITION BY g0.van_id, g0.span ORDER BY g0.t)
), w0 AS (
  SELECT a.van_id, a.span, a.n AS i, b.n AS j, b.path - a.path AS travelled, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS net
  FROM (SELECT *, t + 300 - 1e-6 AS due FROM g) a ASOF JOIN g b ON a.van_id = b.van_id AND a.span = b.span AND a.seg = b.seg AND a.due <= b.t
), w AS (
  SELECT w0.van_id, w0.span, i, j, any_value(travelled) AS travelled, any_value(net) AS net, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) / 2 AS reach
  FROM w0 JOIN g ON g.van_id = w0.van_id AND g.span = w0.span AND g.n BETWEEN i AND j GROUP BY 1, 2, 3, 4
), steps AS (SELECT DISTINCT van_id, span, unnest(range(i, j)) + 1 AS n FROM w WHERE (net <= 0.6 * travelled OR travelled <= 60) AND reach <= 60
), core AS MATERIALIZED (SELECT *, row_number() OVER w AS k, lag(lat) OVER w AS alat, lag(lon) OVER w AS alon FROM g WHERE floor(t / 21600) = span WINDOW w AS (PARTITION BY van_id ORDER BY t)
), runs AS (SELECT s.van_id, c.k, c.k - row_number() OVER (PARTITION BY s.van_id ORDER BY c.k) AS run FROM steps s JOIN core c ON c.van_id = s.van_id AND c.span = s.span AND c.n = s.n
), pieces AS (SELECT van_id, min(k) - 1 AS a, max(k) AS b FROM runs GROUP BY van_id, run
), long AS (
  SELECT p.van_id, a, b, min(t) AS t0, max(t) AS t1, count(*) AS pings, avg(lat) AS lat, avg(lon) AS lon FROM pieces p JOIN core c ON c.van_id = p.van_id AND c.k BETWEEN a AND b GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND max(t) - min(t) >= 300
), linked AS (SELECT *, lag(t1) OVER w AS before, lag(lat) OVER w AS alat, lag(lon) OVER w AS alon FROM long WINDOW w AS (PARTITION BY van_id ORDER BY t0)
), numbered AS (SELECT *, sum(CASE WHEN t0 - before <= 180 AND {_STEP} <= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY van_id ORDER BY t0) AS stop_no FROM linked
), stop AS MATERIALIZED (
  SELECT van_id, CAST(stop_no AS BIGINT) AS stop_no, min(t0) AS start_s, max(t1) AS end_s, CAST(sum(pings) AS BIGINT) AS pings, sum(lat * pings) / sum(pings) AS lat, sum(lon * pings) / sum(pings) AS lon, min(a) AS a, max(b) AS b FROM numbered GROUP BY 1, 2
)
"""

SQL = {
    "p3_found": _STOPS + "SELECT van_id, CAST(floor((start_s + end_s) / 2 / 600) AS BIGINT) AS mid_slot FROM stop",
    "p3_stops": _STOPS
    + "SELECT van_id, stop_no, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, round(end_s - start_s, 3) AS duration_s, pings, round(lat + 1e-10, 6) AS lat, round(lon + 1e-10, 6) AS lon FROM stop",
    "p3_trips": _STOPS
    + f"""
, leg AS (SELECT van_id, k, CASE WHEN t - t0 <= 1200 THEN m ELSE {_STEP} END AS m FROM core),
trip AS (SELECT van_id, stop_no AS trip_no, end_s AS start_s, b AS a, lead(start_s) OVER w AS end_s, lead(a) OVER w AS b FROM stop WINDOW w AS (PARTITION BY van_id ORDER BY stop_no))
SELECT t.van_id, trip_no, round(start_s, 3) AS start_s, round(any_value(end_s), 3) AS end_s, round(any_value(end_s) - start_s, 3) AS duration_s, round(sum(m), 2) AS distance_m, count(*) - 1 AS pings
FROM trip t JOIN leg l ON l.van_id = t.van_id AND l.k > t.a AND l.k <= t.b WHERE end_s IS NOT NULL GROUP BY t.van_id, trip_no, start_s""",
    "p3_left_out": f"""
SELECT CASE WHEN van_id IS NULL THEN 'no van' WHEN device_timestamp IS NULL THEN 'no device time'
  WHEN NOT coalesce(location.latitude BETWEEN -90 AND 90 AND location.longitude BETWEEN -180 AND 180, false) THEN 'no place on the globe'
  WHEN {_LAG} < -120000000 THEN 'clock ahead' WHEN {_LAG} > 604800000000 THEN 'clock behind' END AS reason, count(*) AS pings FROM gps_event GROUP BY 1 HAVING reason IS NOT NULL""",
    "p1_found": _ARRIVED
    + """
SELECT DISTINCT van_id, period_start, CASE WHEN late_us > 7200000000 THEN 'cut' ELSE 'corrected' END AS outcome
FROM t WHERE late_us > 300000000""",
    "p1_periods": _ARRIVED
    + """
SELECT van_id, period_start, count(*) FILTER (late_us <= 300000000) AS first_pings,
       round(avg(speed_kmh) FILTER (late_us <= 300000000) + 1e-10, 6) AS first_avg_speed,
       max(speed_kmh) FILTER (late_us <= 300000000) AS first_max_speed, min(battery_pct) FILTER (late_us <= 300000000) AS first_min_battery,
       count(*) AS pings, round(avg(speed_kmh) + 1e-10, 6) AS avg_speed, max(speed_kmh) AS max_speed, min(battery_pct) AS min_battery,
       count(*) FILTER (late_us > 300000000) AS late_pings, max(at_us) AS last_arrival_us
FROM t WHERE late_us <= 7200000000 GROUP BY 1, 2""",
    "p2_found": _MESSAGES + "SELECT record_id FROM lost",
    "p2_ranges": """
WITH n AS (
  SELECT DISTINCT van_id, sequence_number AS s, CAST(floor(sequence_number / 65536.0) AS BIGINT) AS block FROM gps_event
  WHERE van_id IS NOT NULL AND sequence_number IS NOT NULL AND device_timestamp IS NOT NULL
), i AS (SELECT *, s - row_number() OVER (PARTITION BY van_id, block ORDER BY s) AS island FROM n)
SELECT van_id, min(s) AS lo, max(s) AS hi FROM i GROUP BY van_id, block, island""",
    "p4_found": _VALUES
    + """, c AS (SELECT van_id, v, row_number() OVER (PARTITION BY van_id ORDER BY v) AS rank, count(*) OVER (PARTITION BY van_id) AS n
  FROM v WHERE van_id IS NOT NULL)
SELECT DISTINCT van_id, CAST(l.pct AS BIGINT) AS pct FROM c JOIN (VALUES (50, 150), (90, 450), (99, 1500)) AS l(pct, most) ON true
WHERE n >= 20 AND rank = CAST(ceil(l.pct * n / 100.0) AS BIGINT) AND v > l.most""",
    "p4_counts_by_day": _VALUES + "SELECT van_id, count(*) AS n FROM v WHERE van_id IS NOT NULL AND day IS NOT NULL GROUP BY 1",
    "p5_found": IN_ZONES + "SELECT record_id, zone_id FROM inside",
    "p5_near": """
WITH p AS (
  SELECT id, location.longitude AS x, location.latitude AS y FROM delivery_logs
  WHERE location.longitude BETWEEN -180 AND 180 AND location.latitude BETWEEN -90 AND 90
), d AS (
  SELECT a.id, 2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians(b.y - a.y) / 2) ** 2
         + cos(radians(a.y)) * cos(radians(b.y)) * sin(radians(b.x - a.x) / 2) ** 2))) AS m
  FROM p a JOIN p b ON a.id <> b.id AND b.y BETWEEN a.y - 0.002 AND a.y + 0.002 AND b.x BETWEEN a.x - 0.01 AND a.x + 0.01
)
SELECT p.id, count(d.m) AS near, round(min(d.m), 3) AS nearest_m FROM p LEFT JOIN d ON d.id = p.id AND d.m <= 150 GROUP BY p.id""",
    "p6_found": _PERIODS
    + """, g AS (SELECT van_id, lag(period_end) OVER (PARTITION BY van_id ORDER BY no) AS a, period_start AS b FROM p)
SELECT van_id, CAST(floor(a / 1000.0) AS BIGINT) AS gap_start, CAST(floor(b / 1000.0) AS BIGINT) AS gap_end FROM g
WHERE b - a > 1800000000 AND b - a < 21600000000""",
    "p6_periods": _PERIODS + "SELECT van_id, period_start, period_end FROM p",
}
