import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetloom import schemas
from fleetloom.operators import deliveries, dispatch, health, tables
from fleetloom.session import fresh_path
from fleetloom.sources import streams
from fleetloom.sources.tables import StoredTable, first_zones, seed_zones
from fleetloom.sources.zones import active_zones, segment_factors, zone_at

T0 = datetime(2024, 1, 1, 12)


def at(s):
    return T0 + timedelta(seconds=s)


def test_insert_upsert_and_guards(spark):
    held = spark.createDataFrame([("r1", 2, "a"), ("r2", None, "b"), ("r3", 5, "c"), (None, 1, "n")], "route_id string, plan_version int, van string")
    new = spark.createDataFrame([("r1", 1, "x"), ("r2", 0, "y"), ("r3", 6, "z"), ("r4", 1, "w")], "route_id string, plan_version int, van string")
    got = tables.upsert(held, new, "route_id", tables.newer_version(), {"plan_version": F.col("s.plan_version"), "van": F.col("s.van")})
    assert {tuple(r) for r in got.collect()} == {("r1", 2, "a"), ("r2", 0, "y"), ("r3", 6, "z"), (None, 1, "n"), ("r4", 1, "w")}
    assert {r.route_id for r in tables.insert_new(held, new.union(new), "route_id").collect()} == {"r4"}
    assert tables.insert_new(held, new, "route_id").count() == 1


def test_retention_in_batches_and_its_quirk(spark):
    rows = spark.createDataFrame([(k, at(0 if k in (0, 1, 9) else 1000)) for k in range(10)], "id int, created_at timestamp")
    cut = F.lit(at(500))
    assert [r.id for r in tables.expired_batch(rows, "created_at", cut, "id", 2).collect()] == [0, 1]
    assert [r.id for r in tables.expired_batch(rows, "created_at", cut, "id", 4, lowest_first=True).collect()] == [0, 1]
    left = tables.without(rows, tables.expired_batch(rows, "created_at", cut, "id", 20), "id")
    assert left.count() == 7 and tables.retained(rows, "created_at", cut).count() == 7


def test_routes_are_retired_only_when_nothing_refers_to_them(spark):
    routes = spark.createDataFrame([("old", at(0)), ("used", at(0)), ("new", at(900))], "route_id string, created_at timestamp")
    logs = spark.createDataFrame([("used", at(900)), ("old", at(1))], "route_id string, created_at timestamp")
    breaches = spark.createDataFrame([("old", at(2))], "route_id string, detected_at timestamp")
    left = tables.retire_routes(routes, logs, breaches, F.lit(at(500)))
    assert {r.route_id for r in left["completed_routes"].collect()} == {"used", "new"} and left["delivery_logs"].count() == 1 and left["sla_breaches"].count() == 0


EVENT = "event_id string, van_id string, route_id string, stop_index int, customer_id string, event_type string, timestamp timestamp, parcels_delivered int, sla_deadline timestamp, total_stops int"


def delivery_events():
    rows = []
    for stop, (outcome, late) in enumerate([("DELIVERY_COMPLETED", 30), ("DELIVERY_FAILED", -60)]):
        deadline, base = at(1000 * stop + 500), 1000 * stop + 500 + late
        for k, (kind, t) in enumerate([("ARRIVAL", base - 20), (outcome, base), ("DEPARTURE", base + 10)]):
            rows.append((f"e{stop}{k}", "v", "r", stop, f"c{stop}", kind, at(t), 1, deadline, 2))
    return rows


def test_delivery_events_sent_twice(spark):
    df = spark.createDataFrame(delivery_events() * 2, EVENT)
    rows = deliveries.delivery_rows(df).collect()
    assert len(rows) == 4 and sum(r.delivery_status == "IN_PROGRESS" and r.actual_departure is not None for r in rows) == 2
    assert [r.breach_seconds for r in deliveries.breach_rows(df).collect()] == [10]  # by the arrival, not the outcome
    assert deliveries.route_ends(df).count() == 1
    counts = tables.outcome_counts(deliveries.delivery_rows(df)).first()
    assert (counts.completed_stops, counts.failed_stops) == (1, 1)
    guess = spark.createDataFrame([("v", "r", "c0", at(1), at(520)), ("v", "r", "c0", at(2), at(999))], "van_id string, route_id string, customer_id string, at timestamp, predicted_arrival timestamp")
    assert deliveries.breach_rows(df, guess).first().predicted_arrival == at(520)
    bad = spark.createDataFrame([("x", "v", "r" * 101, 0, "c", "ARRIVAL", at(0), 1, None, 1), (None, "v", "r", 0, "c", "ARRIVAL", at(0), 1, None, 1), ("y", "v", "r", 0, "c", "LOST", at(0), 1, None, 1)], EVENT)
    assert deliveries.delivery_rows(bad).count() == 0


def test_stored_table_versions_and_repeated_batches(spark):
    t = StoredTable(spark, fresh_path(spark, "stored"), "id string, n int")
    assert t.read().count() == 0
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert t.append(df, ("q", 0)) and not t.append(df, ("q", 0)) and t.read().count() == 2
    t.insert_new(spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "id string, n int"), "id")
    assert {r.id for r in t.read().collect()} == {"a", "b", "c"} and t.read().count() == 3
    t.replace(t.read().where("id <> 'a'"))
    assert t.read().count() == 2 and t.vacuum() == 2 and t.read().count() == 2


def test_a_writer_that_dies_between_creating_and_writing_an_entry(spark, monkeypatch):
    from fleetloom import session
    from fleetloom.sources import tables as stored

    path = fresh_path(spark, "t")
    t = StoredTable(spark, path, "id int")
    t.append(spark.createDataFrame([(1,)], "id int"))
    fs, p = t._fs("_log/.00000000000000000002.json.0123")
    fs.create(p, False).close()  # what it leaves: an empty file that isn't an entry yet
    assert [r.id for r in t.read().collect()] == [1]

    def lost(spark_, path_, text):
        session.create_file(spark_, path_, "{}")  # another writer was first
        return session.create_file(spark_, path_, text)

    monkeypatch.setattr(stored, "create_file", lambda s, p_, x: lost(s, p_.replace("0002", "0009"), x))
    with pytest.raises(FileExistsError):
        t.append(spark.createDataFrame([(2,)], "id int"))
    monkeypatch.undo()
    fs.delete(t._fs("_log/00000000000000000009.json")[1], False)
    t.append(spark.createDataFrame([(3,)], "id int"))
    assert sorted(r.id for r in t.read().collect()) == [1, 3] and t.vacuum() == 1


def test_zones_of_a_new_installation(spark):
    t = StoredTable(spark, fresh_path(spark, "zones"), schemas.GEOFENCE_ZONES)
    seed_zones(t)
    seed_zones(t)
    assert t.read().count() == 4
    points = spark.createDataFrame([(1, 52.352, 4.894), (2, 52.3545, 4.894), (3, 52.352, 4.8985), (4, 52.3585, 4.894), (5, None, 1.0)], "id int, lat double, lon double")
    got = {r.id: (r.zone_name, r.speed_factor) for r in zone_at(points, active_zones(first_zones(spark)), "lon", "lat").collect()}
    assert got == {1: ("De Pijp School Zone", 0.6), 2: (None, 1.0), 3: (None, 1.0), 4: (None, 1.0), 5: (None, 1.0)}
    twice = first_zones(spark).where("name like 'D%'")
    assert tables.zones_version(twice.union(twice)).first() != tables.zones_version(twice.where("false")).first()
    versions = [tables.zones_version(z).first().version for z in (first_zones(spark), first_zones(spark).orderBy(F.desc("name")), first_zones(spark).where("name like 'D%'"))]
    assert versions[0] == versions[1] != versions[2]


def raw(spark, *texts):
    return spark.createDataFrame([(t, "gps-events", 0, k) for k, t in enumerate(texts)], "value string, topic string, partition int, offset bigint")


PING = '{"event_id":"e","van_id":"v","route_id":"r","device_timestamp":"2024-01-01T00:00:00Z","location":{"latitude":52.0,"longitude":4.9},"status":"IDLE","other":1}'


def test_records_are_parsed_and_broken_ones_kept_apart(spark):
    texts = [PING, PING.replace('"IDLE"', '"FLYING"'), PING.replace('"event_id":"e",', ""), PING[:40], None, "", PING.replace('"v"', "null")]
    df = streams.gps_records(raw(spark, *texts))
    assert [r.error for r in df.orderBy("offset").collect()] == [None, "status is unknown", "event_id is missing", "record can't be read", "record can't be read", "record can't be read", "van_id or route_id is missing"]
    ok = streams.usable(df).first()
    assert ok.sequence_number == 0 and ok.location.latitude == 52.0 and ok.device_timestamp == datetime(2024, 1, 1)
    letters = streams.dead_letter_rows(df).collect()
    assert len(letters) == 6 and all(r.error_reason.startswith("MALFORMED: ") for r in letters) and {r.van_id for r in letters} == {"v", "unknown"}
    message = streams.dead_letter_messages(df).where("value is not null").first()
    assert [h.key for h in message.headers] == ["error", "topic", "partition", "offset"]


PLAN = {
    "route_id": "r", "van_id": "v", "version": 1, "time_scale": 4.0, "base_speed_kmh": 36.0, "waypoints": [[52.0, 4.9], [52.1, 4.9]],
    "stops": [{"stop_index": 0, "customer_id": "c", "sla_deadline": "2024-01-01T00:00:00Z", "waypoint_index": 0}, {"stop_index": 1, "customer_id": "d", "sla_deadline": "2024-01-01T00:00:00Z", "waypoint_index": 1}],
}


def test_route_plans_are_checked(spark):
    import json

    stop = PLAN["stops"][0]
    bad = [{"van_id": None}, {"waypoints": [[1.0, 2.0]]}, {"waypoints": [[1.0], [2.0, 3.0]]}, {"time_scale": 0.0}, {"stops": None}, {"stops": [stop | {"customer_id": None}]}, {"stops": PLAN["stops"][::-1]}, {"stops": [stop | {"waypoint_index": 2}]}]
    texts = [json.dumps(PLAN), json.dumps(PLAN | {"stops": []}), *[json.dumps(PLAN | b) for b in bad]]
    errors = [r.error for r in streams.plan_records(raw(spark, *texts)).orderBy("offset").collect()]
    assert errors[:2] == [None, None] and all(errors[2:])


def test_changelog_keeps_the_latest(spark):
    df = raw(spark, "a1", "b1", "a2")
    assert {tuple(r) for r in streams.changelog(df, F.substring("value", 1, 1), F.col("offset")).collect()} == {("a", "a2"), ("b", "b1")}


def test_unknown_source_kind(spark):
    with pytest.raises(ValueError):
        streams.raw_stream(spark, "carrier-pigeon", "x")


VANS = "van_id string, lat double, lon double, serving boolean, next int, speed_mps double, delay_s double, stops array<struct<lat:double,lon:double,planned_s:double,deadline_s:double>>, hub_lat double, hub_lon double"


def fleet(spark, **changes):
    def van(name, lon):
        stops = [(52.305 + 0.005 * k, lon, 100.0 * (k + 1), 5000.0) for k in range(3)]
        base = {"van_id": name, "lat": 52.3, "lon": lon, "serving": False, "next": 0, "speed_mps": 40.0, "delay_s": 0.0, "stops": stops, "hub_lat": 52.32, "hub_lon": lon}
        return tuple((base | changes.get(name.replace("-", "_"), {})).values())

    return spark.createDataFrame([van("van-a", 4.85), van("van-b", 4.90)], VANS)


def test_cheapest_insertion(spark):
    order = spark.createDataFrame([("o", 52.3125, 4.851, 0.0, 1000.0)], "order_id string, lat double, lon double, now_s double, deadline_s double")
    best = dispatch.assignments(order, fleet(spark)).first()
    assert (best.van_id, best.insert_before, best.options_considered, best.on_time) == ("van-a", 2, 8, True) and best.extra_km < 0.2
    late = fleet(spark, van_a={"delay_s": 10_000.0})
    assert dispatch.options(order, late).where("van_id = 'van-a' and not on_time").count() > 0
    serving = dispatch.options(order, fleet(spark, van_a={"serving": True, "next": 1})).where("van_id = 'van-a'")
    assert serving.agg(F.min("k")).first()[0] == 1
    assert dispatch.assignments(order, fleet(spark).where("false")).count() == 0
    assert dispatch.assignments(order, fleet(spark, van_a={"next": 4}, van_b={"next": 9})).count() == 0


def test_requests_in_blocks_find_the_same_places(spark, monkeypatch):
    orders = spark.createDataFrame([(f"o{k}", 52.30 + k / 2000, 4.85, 0.0, 1000.0) for k in range(40)] + [("x", None, 4.85, 0.0, 1.0)], "order_id string, lat double, lon double, now_s double, deadline_s double")
    whole = sorted(map(str, dispatch.assignments(orders, fleet(spark)).collect()))
    monkeypatch.setattr(dispatch, "BLOCK", 9)
    assert len(whole) == 40 and sorted(map(str, dispatch.assignments(orders, fleet(spark)).collect())) == whole


def samples(spark, rows):
    return spark.createDataFrame(rows, "at_s bigint, received bigint, processed bigint, rejected bigint, vans int, silent_vans int, disk_free double")


def test_health(spark):
    steady = [(15 * k, 1500 * k, 1400 * k, 100 * k, 50, 0, 0.5) for k in range(40)]
    last = health.report(samples(spark, steady)).orderBy(F.desc("at_s")).first()
    assert (last.status, last.rejected_pct, last.received_per_s, last.window_s) == ("OK", 6.7, 100.0, 300)
    bad = health.report(samples(spark, [(15 * k, 1500 * k, 15 * k, 1485 * k, 50, 8, 0.1) for k in range(40)])).orderBy(F.desc("at_s")).first()
    assert bad.status == "DEGRADED" and bad.rejected_pct == 99.0 and len(bad.problems) == 3 and "8 of 50 vans are silent" in bad.problems
    assert health.report(samples(spark, steady[:3])).orderBy(F.desc("at_s")).first().status == "WARMING_UP"
    still = health.report(samples(spark, [(15 * k, 7, 7, 0, 0, 0, 0.5) for k in range(40)])).orderBy("at_s").collect()
    assert still[-1].status == "DEGRADED" and still[2].status == "WARMING_UP"


def test_alerts(spark):
    rows = [(60 * k, 1000 * k if k < 30 else 30_000, 1000 * k, 300 * k, 0 if k < 40 else 1, 0, 0) for k in range(60)]
    df = spark.createDataFrame(rows, "at_s bigint, received bigint, processed bigint, deduplicated bigint, malformed bigint, dead_lettered bigint, archive_dropped bigint")
    firing = {}
    for r in health.alerts(df).collect():
        firing.setdefault(r.rule, []).append(r.at_s // 60)
    assert min(firing["stream_stalled"]) == 40 and sorted(firing["malformed_gps"]) == list(range(40, 45)) and min(firing["dedup_rejection_high"]) == 15
    assert "archive_dropping" not in firing and "deliveries_dead_lettered" not in firing


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("a", 0.1, 10), ("a", 0.5, 90), ("a", float("inf"), 100), ("b", 1.0, 0), ("b", float("inf"), 5)], "k string, le double, n bigint")
    got = {r.k: r.value for r in health.histogram_quantile(df, 0.5, "k").collect()}
    assert abs(got["a"] - 0.3) < 1e-9 and got["b"] == 1.0


def test_latency_buckets_and_vans_heard_of(spark):
    df = spark.createDataFrame([("a", v) for v in (50, 100, 150, 900, None)] + [("b", 5000)], "k string, ms int")
    got = {(r.k, r.le): r.n for r in health.latency_buckets(df, "ms", [1000, 100], "k").collect()}
    assert got == {("a", 100.0): 2, ("a", 1000.0): 4, ("a", float("inf")): 4, ("b", 100.0): 0, ("b", 1000.0): 0, ("b", float("inf")): 1}
    vans = spark.createDataFrame([("x", 900_000), ("y", 880_000), ("z", 879_999), ("n", None)], "van_id string, at bigint")
    assert {r.van_id for r in health.heard_of(vans, "at", F.lit(1_000_000)).collect()} == {"x", "y"}


def test_zones_by_cell_equal_zones_in_a_row(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        x, y, w, h = rng.uniform(4, 5), rng.uniform(52, 53), rng.choice([1e-4, 0.01, 0.3]) * rng.uniform(0.5, 2), rng.choice([1e-4, 0.01, 0.3])
        rows.append((f"z{k}", f"n{k % 17}", "T", rng.choice([None, "0.40", "0.75"]), f"POLYGON(({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))", True))
    raw = spark.createDataFrame(rows, "id string, name string, zone_type string, speed_factor string, geometry string, active boolean").withColumn("speed_factor", F.col("speed_factor").cast("decimal(3,2)"))
    points = [(k, rng.uniform(3.9, 5.1), rng.uniform(51.9, 53.1)) for k in range(500)] + [(900, None, 52.0), (901, float("nan"), 52.0), (902, 200.0, 52.0), (903, 4.5, None)]
    points += [(1000 + k, *map(float, r[4][9:].split(",")[0].split())) for k, r in enumerate(rows)]  # corners
    df = spark.createDataFrame(points, "k long, lon double, lat double")
    zones = active_zones(raw)
    few = {tuple(r) for r in zone_at(df, zones, "lon", "lat").select("k", "zone_name", "speed_factor").collect()}
    many = {tuple(r) for r in zone_at(df, zones, "lon", "lat", most_zones=5).select("k", "zone_name", "speed_factor").collect()}
    assert few == many and sum(r[1] is not None for r in few) > 50
    assert {r.zone_name for r in zone_at(df, zones.where("false"), "lon", "lat", most_zones=-1).collect()} == {None}


def test_segments_are_slowed_by_the_zone_at_their_middle(spark):
    lines = spark.createDataFrame([("r", [[52.348, 4.894], [52.3505, 4.894], [52.353, 4.894], [52.356, 4.894]]), ("short", [[52.0, 4.9]])], "route_id string, waypoints array<array<double>>")
    got = {r.route_id: r.factors for r in segment_factors(lines, active_zones(first_zones(spark))).collect()}
    assert got == {"r": [1.0, 0.6, 1.0]}
