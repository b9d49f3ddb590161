"""SQL of the estimates along routes and of the live table, to compare the operators with."""

from __future__ import annotations

from fleetloom.plans.problems import IN_ZONES

HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2)))"
_DEGREE = "(6371000.0 * pi() / 180)"

# The first zones of pings, plans out of logged stops with the factor of each segment, places along them, what each step
# teaches of the speed, its running mean by recursion, and the estimate of each ping as ``told``.
_ESTIMATES = (
    IN_ZONES.replace("WITH t AS", "WITH RECURSIVE t AS", 1).replace("{", "{{").replace("}", "}}")
    + f""", fz AS MATERIALIZED (
  SELECT DISTINCT ON (record_id) record_id, g.name AS zone_name, CAST(coalesce(g.speed_factor, 1.0) AS DOUBLE) AS f
  FROM inside i JOIN geofence_zones g ON g.id = i.zone_id ORDER BY record_id, g.name, g.id
), arrived AS MATERIALIZED (
  SELECT *, epoch_us(device_timestamp) AS ts_us, epoch_us(coalesce(ingestion_timestamp, device_timestamp)) AS at_us FROM gps_event WHERE van_id IS NOT NULL AND device_timestamp IS NOT NULL
), hours AS (SELECT CAST(floor(at_us / 3600e6) AS BIGINT) AS h, count(*) FILTER (status IN ('EN_ROUTE', 'DELIVERING')) AS n FROM arrived GROUP BY 1
), moment AS (SELECT (min(h) + 1) * 3600000000 AS t FROM hours WHERE n = (SELECT max(n) FROM hours)
), stop1 AS (
  SELECT DISTINCT ON (van_id, route_id, stop_index) van_id, route_id, stop_index, location.latitude AS lat, location.longitude AS lon, epoch_us(sla_deadline) / 1e6 AS deadline, customer_id
  FROM delivery_logs WHERE van_id IS NOT NULL AND route_id IS NOT NULL AND location IS NOT NULL AND stop_index IS NOT NULL ORDER BY van_id, route_id, stop_index, created_at, id
), numbers AS (SELECT van_id, route_id, unnest(range(0, max(stop_index) + 1)) AS k FROM stop1 GROUP BY 1, 2
), stop2 AS MATERIALIZED (
  SELECT n.van_id, n.route_id, n.k, s.lat, s.lon, s.deadline, coalesce(nullif(s.customer_id, ''), CAST(n.k AS VARCHAR)) AS who
  FROM numbers n ASOF JOIN stop1 s ON s.van_id = n.van_id AND s.route_id = n.route_id AND n.k <= s.stop_index
), seg AS MATERIALIZED (
  SELECT * FROM (SELECT van_id, route_id, k, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM stop2 WINDOW w AS (PARTITION BY van_id, route_id ORDER BY k)) WHERE lat2 IS NOT NULL
), mid AS MATERIALIZED (SELECT van_id, route_id, k, zone_id, (lon1 + lon2) / 2 AS x, (lat1 + lat2) / 2 AS y FROM seg JOIN z ON (lon1 + lon2) / 2 BETWEEN a AND c AND (lat1 + lat2) / 2 BETWEEN b AND d
), midh AS (
  SELECT van_id, route_id, k, zone_id, pid, rid, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS odd
  FROM mid JOIN e USING (zone_id) GROUP BY 1, 2, 3, 4, 5, 6
), midin AS (SELECT DISTINCT van_id, route_id, k, zone_id FROM (SELECT van_id, route_id, k, zone_id, pid FROM midh GROUP BY ALL HAVING bool_or(odd AND rid = 1) AND NOT bool_or(odd AND rid > 1))
), midz AS (SELECT DISTINCT ON (van_id, route_id, k) van_id, route_id, k, CAST(coalesce(g.speed_factor, 1.0) AS DOUBLE) AS f FROM midin JOIN geofence_zones g ON g.id = zone_id ORDER BY van_id, route_id, k, g.name, g.id
), slow AS (SELECT s.van_id, s.route_id, s.k, coalesce(m.f, 1.0) AS f, {HAVERSINE.format(lat1='lat1', lon1='lon1', lat2='lat2', lon2='lon2')} AS m FROM seg s LEFT JOIN midz m ON m.van_id = s.van_id AND m.route_id = s.route_id AND m.k = s.k
), vertex AS MATERIALIZED (
  SELECT p.*, coalesce(sum(q.m) OVER (PARTITION BY p.van_id, p.route_id ORDER BY p.k), 0.0) AS cum, q.f AS f_before, lag(p.lat) OVER w AS lat0, lag(p.lon) OVER w AS lon0
  FROM stop2 p LEFT JOIN slow q ON q.van_id = p.van_id AND q.route_id = p.route_id AND q.k = p.k - 1 WINDOW w AS (PARTITION BY p.van_id, p.route_id ORDER BY p.k)
), plan AS MATERIALIZED (SELECT van_id, route_id, count(*) AS n, list(cum ORDER BY k) AS cums, list(f_before ORDER BY k) FILTER (k > 0) AS fs FROM vertex GROUP BY 1, 2
), ping AS MATERIALIZED (
  SELECT a.record_id, a.van_id, a.route_id, a.ts_us, a.ts_us / 1e6 AS s, location.latitude AS lat, location.longitude AS lon, status, coalesce(current_stop_index, -1) AS leg, speed_kmh, coalesce(fz.f, 1.0) AS zf,
         row_number() OVER (PARTITION BY a.van_id ORDER BY a.ts_us, a.record_id) AS rn
  FROM arrived a LEFT JOIN fz USING (record_id) WHERE location.latitude IS NOT NULL AND location.longitude IS NOT NULL AND status IS NOT NULL AND {{upto}}
), on_plan AS (
  SELECT g.*, p.n, p.cums, coalesce(p.fs, [1.0]) AS fs, v.lat AS vlat, v.lon AS vlon, v.deadline, v.who, v.cum AS vcum, v.k IS NOT NULL AS known, p.n IS NOT NULL AS planned,
         (v.lon0 - g.lon) * {_DEGREE} * cos(radians(g.lat)) AS x0, (v.lat0 - g.lat) * {_DEGREE} AS y0, (v.lon - g.lon) * {_DEGREE} * cos(radians(g.lat)) AS x1, (v.lat - g.lat) * {_DEGREE} AS y1
  FROM ping g LEFT JOIN plan p ON p.van_id = g.van_id AND p.route_id = g.route_id LEFT JOIN vertex v ON v.van_id = g.van_id AND v.route_id = g.route_id AND v.k = g.leg
), part AS (SELECT *, CASE WHEN (x1 - x0) ** 2 + (y1 - y0) ** 2 > 0 THEN greatest(0.0, least(1.0, -(x0 * (x1 - x0) + y0 * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) ELSE 0.0 END AS tt FROM on_plan
), placed AS (
  SELECT *, {HAVERSINE.format(lat1='vlat', lon1='vlon', lat2='lat', lon2='lon')} AS straight,
         CASE WHEN status = 'EN_ROUTE' AND known THEN CASE WHEN leg = 0 THEN 0.0 ELSE cums[leg] + tt * (cums[leg + 1] - cums[leg]) END END AS at_m,
         CASE WHEN status = 'EN_ROUTE' AND known THEN CASE WHEN leg = 0 THEN {HAVERSINE.format(lat1='vlat', lon1='vlon', lat2='lat', lon2='lon')} ELSE sqrt((x0 + tt * (x1 - x0)) ** 2 + (y0 + tt * (y1 - y0)) ** 2) END END AS off
  FROM part
), along AS (SELECT *, CASE WHEN off <= 200 THEN at_m END AS here FROM placed
), linked AS MATERIALIZED (
  SELECT *, lag(route_id) OVER w IS NOT DISTINCT FROM route_id AND rn > 1 AS same, lag(s) OVER w AS s0, lag(leg) OVER w AS leg0, lag(here) OVER w AS here0, lag(status) OVER w AS status0,
         CASE WHEN here IS NOT NULL THEN fs[greatest(1, least(len(fs), len(list_filter(cums, lambda c: c <= here))))] ELSE zf END AS factor
  FROM along WINDOW w AS (PARTITION BY van_id ORDER BY rn)
), taught AS MATERIALIZED (
  SELECT *, same AND here IS NOT NULL AND here0 IS NOT NULL AND leg0 = leg AND status0 = 'EN_ROUTE' AND s - s0 >= 0.2 AND s - s0 <= 30.0 AND here >= here0 AS teaches,
         sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY van_id ORDER BY rn) AS run FROM linked
), counted AS MATERIALIZED (SELECT *, sum(CASE WHEN teaches THEN 1 ELSE 0 END) OVER (PARTITION BY van_id ORDER BY rn) AS lesson FROM taught
), lessons AS MATERIALIZED (
  SELECT van_id, lesson, (here - here0) / (s - s0) / fs[greatest(1, least(len(fs), len(list_filter(cums, lambda c: c <= (here + here0) / 2))))] AS x FROM counted WHERE teaches
), learned AS (
  SELECT van_id, lesson, x AS v FROM lessons WHERE lesson = 1
  UNION ALL
  SELECT l.van_id, l.lesson, 0.3 * l.x + (1 - 0.3) * p.v FROM learned p JOIN lessons l ON l.van_id = p.van_id AND l.lesson = p.lesson + 1
), paced AS (
  SELECT c.*, coalesce(nullif(l.v, 0), CASE WHEN speed_kmh > 0 THEN speed_kmh / factor ELSE 36.0 END / 3.6) AS pace,
         min(s) FILTER (status = 'DELIVERING' AND known) OVER (PARTITION BY c.van_id, run, who) AS came FROM counted c LEFT JOIN learned l ON l.van_id = c.van_id AND l.lesson = c.lesson
), left_s AS (
  SELECT *, CASE WHEN here IS NULL THEN straight * 1.3 / factor WHEN leg = 0 THEN 0.0 ELSE greatest(0.0, cums[leg + 1] - here) / fs[leg] END / pace AS wait FROM paced
), whole AS (SELECT *, CASE WHEN status = 'EN_ROUTE' AND known THEN floor(least(wait, 4611686018427387904.0) + 0.5) END AS eta FROM left_s
), told AS (
  SELECT record_id, van_id, CAST(CASE WHEN eta IS NOT NULL THEN eta WHEN status = 'DELIVERING' AND known THEN 0 ELSE -1 END AS BIGINT) AS eta_s,
         CASE WHEN eta IS NULL THEN 'NONE' WHEN here IS NULL THEN 'STRAIGHT_LINE' ELSE 'ROUTE' END AS method,
         CASE WHEN status NOT IN ('EN_ROUTE', 'DELIVERING') THEN 'NONE' WHEN NOT planned THEN 'UNKNOWN' WHEN NOT known THEN 'NONE'
              WHEN status = 'DELIVERING' THEN CASE WHEN came > deadline THEN 'CRITICAL' ELSE 'NONE' END
              WHEN deadline IS NULL THEN 'UNKNOWN' WHEN floor(deadline - (s + eta)) < 0 THEN 'CRITICAL' WHEN floor(deadline - (s + eta)) < 60 THEN 'WARNING' ELSE 'NONE' END AS risk,
         CAST(CASE WHEN eta IS NOT NULL THEN floor(deadline - (s + eta)) WHEN status = 'DELIVERING' AND known THEN floor(deadline - came) END AS BIGINT) AS slack_s
  FROM whole
)
"""
)

ESTIMATES = _ESTIMATES.format(upto="true")

LIVE = _ESTIMATES.format(upto="at_us < (SELECT t FROM moment)") + (
    """, newest AS (
  SELECT DISTINCT ON (van_id) * FROM arrived WHERE at_us < (SELECT t FROM moment) ORDER BY van_id, least(ts_us, at_us) DESC, record_id DESC
), live_vans AS (
  SELECT p.van_id, p.route_id, p.status, p.location.latitude AS lat, p.location.longitude AS lon, p.speed_kmh, p.battery_pct, p.current_stop_index AS current_stop, p.total_stops,
         coalesce(o.eta_s, -1) AS eta_seconds, coalesce(o.risk, 'UNKNOWN') AS sla_risk, o.slack_s AS slack_seconds, fz.zone_name IS NOT NULL AS in_zone, fz.zone_name, epoch_ms(p.device_timestamp) AS updated_epoch_ms
  FROM newest p LEFT JOIN told o USING (record_id) LEFT JOIN fz USING (record_id)
)
"""
)
