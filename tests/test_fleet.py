from datetime import datetime, timedelta

import numpy as np

from fleetloom.operators import health
from fleetloom.operators.state.eta import EtaTracker, Route, Stop
from fleetloom.plans import fleet

BASE = datetime(2024, 5, 1, 8)
PLACE = "struct<latitude:double,longitude:double>"
PING = f"record_id bigint, event_id string, van_id string, route_id string, device_timestamp timestamp, ingestion_timestamp timestamp, location {PLACE}, status string, current_stop_index int, speed_kmh double"


def at(s):
    return BASE + timedelta(seconds=s)


def test_estimates_are_slowed_by_zones(spark, tmp_path):
    stop = "id string, van_id string, route_id string, stop_index int, customer_id string, location " + PLACE + ", sla_deadline timestamp, created_at timestamp"
    places = [52.300, 52.310, 52.320]  # two segments of 1,112 m; the zone holds the middle of the second
    spark.createDataFrame([(str(k), v, "r", k, f"c{k}", (y, 4.85), at(900), BASE) for v in ("v", "w") for k, y in enumerate(places)], stop).write.parquet(f"{tmp_path}/delivery_logs.parquet")
    zones = [(n, n, "T", 0.5, on, "POLYGON((4.84 52.312,4.90 52.312,4.90 52.318,4.84 52.318,4.84 52.312))") for n, on in (("slow", True), ("closed", False))]
    spark.createDataFrame(zones, "id string, name string, zone_type string, speed_factor double, active boolean, geometry string").write.parquet(f"{tmp_path}/geofence_zones.parquet")
    pings = [
        (1, "e1", "v", "r", at(0), at(0), (52.305, 4.85), "EN_ROUTE", 1, 36.0),  # on the first segment: no zone
        (2, "e2", "w", "r", at(0), at(0), (52.310, 4.85), "EN_ROUTE", 2, 18.0),  # 18 km/h within the zone are 36 without
        (3, "e3", "w", "r", at(60), at(60), (52.315, 4.86), "EN_ROUTE", 2, 0.0),  # off the route, in the zone
        (4, "e4", "v", "r", at(60), at(60), (52.305, 4.86), "EN_ROUTE", 1, 0.0),  # off the route, in no zone
    ]
    spark.createDataFrame(pings, PING).write.parquet(f"{tmp_path}/gps_event.parquet")
    got = {r.record_id: (r.eta_s, r.method) for r in fleet.eta_by_ping(spark, str(tmp_path)).collect()}
    assert got[1] == (56, "ROUTE") and got[2] == (222, "ROUTE")  # 1,112 m at 10 m/s, halved in the zone
    assert got[3] == (228, "STRAIGHT_LINE") and got[4] == (114, "STRAIGHT_LINE")  # 876 m * 1.3 at 10 m/s, halved in the zone


def test_speed_is_cleared_of_the_zone_half_way():
    lat = 52.3 + 0.01 * np.arange(4)
    t = EtaTracker()
    t.plan("r", Route(lat, [4.85] * 4, np.array([1.0, 0.5, 1.0])), [Stop(3, lat[3], 4.85)])
    t.ping(0, "r", 52.309, 4.85, "EN_ROUTE", 0)
    t.ping(20, "r", 52.3205, 4.85, "EN_ROUTE", 0)  # ends behind the zone, most of the way was in it
    assert abs(t.speed - t.route.cum[1] * 1.15 / 20 / 0.5) < 0.1


def test_estimates_of_a_van_that_stands_fit_a_long():
    t = EtaTracker()
    t.plan("r", Route([52.3, 52.4], [4.85, 4.85]), [Stop(1, 52.4, 4.85, 1000.0)])
    t.ping(0, "r", 52.34, 4.85, "EN_ROUTE", 0)
    for k in range(1, 150):
        e = t.ping(k, "r", 52.35, 4.85, "EN_ROUTE", 0)
    assert 0 < e.eta_s < 2**63 and -(2**63) < e.slack_s < 0


def test_silent_vans_degrade_health(spark, tmp_path):
    def row(van, s, status="EN_ROUTE"):
        return (0, "e", van, "r", at(s), at(s), (52.3, 4.85), status, 0, 36.0)

    rows = [row(f"v{k}", s) for k in range(10) for s in range(0, 5400, 100) if k or s < 2700]  # v0 stops at the fourth interval
    rows += [row("v0", 4000, None), row("late", 4600)]  # an invalid ping is no sign of life; a new van is heard of, then silent
    spark.createDataFrame(rows, PING).write.parquet(f"{tmp_path}/gps_event.parquet")
    got = [r for r in fleet.pipeline_health(spark, str(tmp_path)).orderBy("at_s").collect()]
    assert [r.problems for r in got] == ["", "", "", "1 of 10 vans are silent", "1 of 10 vans are silent", "2 of 11 vans are silent"]
    assert [r.status for r in got[2:]] == ["OK", "DEGRADED", "DEGRADED", "DEGRADED"]
    log = spark.read.parquet(f"{tmp_path}/gps_event.parquet")
    short = health.with_silence(health.pipeline_samples(log, 60), log, 60, 300).where("vans > 0").orderBy("at_s").collect()
    silent = {(r.at_s - short[0].at_s) // 60: r.silent_vans for r in short}  # v0 was last heard of after 2,600 s, silent beyond 2,900 s
    assert all(n == 0 for k, n in silent.items() if k < 48) and silent[48] == 1 and silent[max(silent)] == 2
