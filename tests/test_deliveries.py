"""Delivery and plan streams into stored tables, retention, and messages."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetloom import schemas
from fleetloom.operators import deliveries, route_plans
from fleetloom.operators.state.eta import haversine
from fleetloom.session import fresh_path
from fleetloom.sources import retention, streams
from fleetloom.sources.tables import KeyedTable, StoredTable
from fleetloom.sources.zones import active_zones
from fleetloom.streaming.sinks import DeliveryTables, assignment_messages, deliveries_sink, plans_sink, publish

BASE = datetime(2024, 1, 1)


def at(s):
    return BASE + timedelta(seconds=s)


def event(k, route, stop, kind, s, deadline=None, total=2, van="v", lat=52.3):
    when = lambda t: None if t is None else at(t).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"event_id": k, "van_id": van, "route_id": route, "stop_index": stop, "customer_id": f"{route}-{stop}", "event_type": kind, "timestamp": when(s), "location": {"latitude": lat, "longitude": 4.85}, "parcels_delivered": 1, "sla_deadline": when(deadline), "total_stops": total})


EVENTS = [
    event("a1", "r", 0, "ARRIVAL", 100, 90), event("a2", "r", 0, "DELIVERY_COMPLETED", 130, 90), event("a3", "r", 0, "DEPARTURE", 140), event("b1", "r", 1, "ARRIVAL", 300, 400),
    event("b2", "r", 1, "DELIVERY_FAILED", 330, 400), event("b3", "r", 1, "DEPARTURE", 340), event("c1", "q", 0, "ARRIVAL", 50, None, 3, "w"),
]


def records(spark, lines):
    raw = spark.createDataFrame([(x,) for x in lines], "value string").withColumns({"topic": F.lit("delivery-events"), "partition": F.lit(0), "offset": F.lit(0)})
    return streams.delivery_records(raw)


@pytest.mark.parametrize("cuts", [[7], [1, 3, 4, 6, 7], [2, 2, 5, 7]])
def test_events_in_any_batches_fill_all_tables_once(spark, cuts):
    t = DeliveryTables.under(spark, fresh_path(spark, "deliveries"))
    zone = spark.createDataFrame([("z1", "Yard", "T", None, "POLYGON((4.8 52.2, 4.9 52.2, 4.9 52.4, 4.8 52.4, 4.8 52.2))", True)], "id string, name string, zone_type string, speed_factor decimal(3,2), geometry string, active boolean")
    guesses = spark.createDataFrame([("v", "r", "r-0", at(1), at(95)), ("v", "r", "r-0", at(2), at(99))], "van_id string, route_id string, customer_id string, at timestamp, predicted_arrival timestamp")
    pings = spark.createDataFrame([("r", at(s), k, (52.3 + k / 100, 4.85)) for k, s in enumerate((10, 20, 30))], "route_id string, device_timestamp timestamp, record_id long, location struct<latitude:double,longitude:double>")
    sink = deliveries_sink(t, "q", active_zones(zone), lambda: guesses, lambda: pings)
    low = 0
    for number, high in enumerate(cuts):
        batch = records(spark, [*EVENTS[low:high], *EVENTS[:low], "{broken" if number == 0 else EVENTS[0]])  # all earlier events again
        sink(batch, number)
        sink(batch, number)
        low = high
    logs = {r.event_id: r for r in t.log().collect()}
    assert set(logs) == {"a1", "a2", "b1", "b2", "c1"} and len({r.id for r in logs.values()}) == 5
    assert logs["a1"].actual_departure == at(140) and logs["b1"].actual_departure == at(340) and logs["a2"].actual_departure is None and logs["c1"].actual_departure is None
    assert (logs["a1"].sla_breached, logs["a1"].breach_seconds, logs["a2"].breach_seconds, logs["a1"].location.latitude) == (True, 10, 0, 52.3)
    (breach,) = t.breaches.read().collect()
    assert (breach.event_id, breach.breach_seconds, breach.geofence_id, breach.predicted_arrival, breach.severity) == ("a1", 10, "z1", at(95), "WARNING")
    routes = {r.route_id: r for r in t.routes.read().collect()}
    assert (routes["q"].status, routes["q"].total_stops, routes["q"].completed_stops, routes["q"].actual_end) == ("IN_PROGRESS", 3, 0, None)
    r, km = routes["r"], 2 * haversine(52.30, 4.85, 52.31, 4.85) / 1000
    assert (r.status, r.completed_stops, r.failed_stops, r.actual_end, r.actual_start) == ("COMPLETED", 1, 1, at(340), at(100))
    assert float(r.total_duration_min) == 4.0 and abs(float(r.total_distance_km) - km) < 0.01 and abs(float(r.avg_speed_kmh) - km * 15) < 0.1
    assert [x.error_reason for x in t.letters.read().collect()] == ["MALFORMED: record can't be read"]
    before = sorted(map(str, t.log().collect())), sorted(map(str, t.routes.read().collect()))
    t.compact()
    assert (sorted(map(str, t.log().collect())), sorted(map(str, t.routes.read().collect()))) == before and t.departures.read().count() == 0
    # a departure that comes again, later, completes nothing twice
    sink(records(spark, [event("b9", "r", 1, "DEPARTURE", 900)]), 99)
    assert {x.route_id: x.actual_end for x in t.routes.read().collect()}["r"] == at(340)


def test_a_batch_that_cannot_be_written_is_tried_again_and_then_dead_lettered(spark, monkeypatch):
    t, tries, pauses = DeliveryTables.under(spark, fresh_path(spark, "deliveries")), [], []
    append = t.breaches.append

    def failing(*args):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("database is away\nat length")
        return append(*args)

    monkeypatch.setattr(t.breaches, "append", failing)
    sink = deliveries_sink(t, "q", wait=pauses.append)
    sink(records(spark, EVENTS), 0)
    assert len(tries) == 3 and pauses == [0.2, 0.4] and t.letters.read().count() == 0 and t.logs.read().count() == 5 and t.breaches.read().count() == 1
    monkeypatch.setattr(t.breaches, "append", lambda *_: (_ for _ in ()).throw(RuntimeError("gone")))
    sink(records(spark, [event("n1", "n", 0, "ARRIVAL", 1, 0)]), 1)
    assert [(r.error_reason, json.loads(r.event_payload)["event_id"]) for r in t.letters.read().collect()] == [("DB_WRITE_FAILED: gone", "n1")]


def plan(route, version, created, stops=2, scale=2.0):
    when = lambda s: at(s).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({
        "route_id": route, "van_id": "v", "version": version, "created_at": when(created), "time_scale": scale, "base_speed_kmh": 30.0, "waypoints": [[52.3 + k / 100, 4.85] for k in range(5)],
        "stops": [{"stop_index": k, "customer_id": f"c{k}", "location": {"latitude": 52.3, "longitude": 4.85}, "sla_deadline": when(900 + k), "planned_arrival": when(600 + 100 * k), "parcels": 1, "waypoint_index": k + 1} for k in range(stops)],
    })


def test_plans_fill_the_planned_side_of_routes(spark):
    path = fresh_path(spark, "plans")
    routes, letters = KeyedTable(spark, f"{path}/routes", schemas.COMPLETED_ROUTES, "route_id"), StoredTable(spark, f"{path}/letters", schemas.DEAD_LETTER_LOG)
    read = lambda *lines: streams.plan_records(spark.createDataFrame([(x,) for x in lines], "value string").withColumns({"topic": F.lit("route-plans"), "partition": F.lit(0), "offset": F.lit(0)}))
    sink = plans_sink(routes, letters, "p")
    sink(read(plan("r", 1, 10), plan("r", 2, 20, 3), plan("e", 1, 5, 0), "nonsense"), 0)
    r = {x.route_id: x for x in routes.read().collect()}["r"]
    assert (r.plan_version, r.total_stops, r.planned_start, r.planned_end, r.status) == (2, 3, at(20), at(820), "IN_PROGRESS")
    assert abs(float(r.planned_distance_km) - 3 * haversine(52.30, 4.85, 52.31, 4.85) / 1000) < 0.011 and letters.read().count() == 1
    sink(read(plan("r", 1, 99)), 1)  # an older version changes nothing
    assert {x.route_id: x.planned_start for x in routes.read().collect()}["r"] == at(20)
    t = route_plans.tracked(streams.usable(read(plan("r", 3, 7)))).first()
    assert (round(t.lats[1], 9), t.vertices, t.customers, t.version, t.base_speed_kmh) == (52.31, [1, 2], ["c0", "c1"], 3, 30.0)


def test_arrivals_against_first_predictions(spark):
    events = streams.usable(records(spark, EVENTS * 2))
    guesses = spark.createDataFrame([("v", "r", "r-0", at(5), at(120)), ("v", "r", "r-0", at(2), at(95)), ("v", "r", "r-9", at(2), at(95))], "van_id string, route_id string, customer_id string, at timestamp, predicted_arrival timestamp")
    assert [(r.event_id, r.off_s) for r in deliveries.arrival_errors(events, guesses).collect()] == [("a1", 5.0)]


def test_retention_takes_what_is_old_and_unreferred(spark):
    t, now = DeliveryTables.under(spark, fresh_path(spark, "old")), at(30 * 86_400)
    old, new = now - timedelta(days=8), now - timedelta(hours=1)
    t.routes.put(spark.createDataFrame([("old", old), ("used", old), ("new", new), ("none", None)], "route_id string, created_at timestamp"))
    t.logs.append(spark.createDataFrame([("1", "old", old), ("2", "used", new), ("3", "x", None)], "id string, route_id string, created_at timestamp"))
    t.letters.append(spark.createDataFrame([("a", now - timedelta(days=3)), ("b", new)], "van_id string, created_at timestamp"))
    assert retention.run_once(now, letters=t.letters, logs=t.logs, breaches=t.breaches, routes=t.routes) == {"letters": 1, "breaches": 0, "logs": 1, "routes": 1}
    assert {r.route_id for r in t.routes.read().collect()} == {"used", "new", "none"} and {r.id for r in t.logs.read().collect()} == {"2", "3"}
    assert set(retention.run_once(now, letters=t.letters, logs=t.logs, breaches=t.breaches, routes=t.routes).values()) == {0}


def test_messages_are_written_with_headers_and_keys(spark, tmp_path):
    letters = streams.dead_letter_messages(records(spark, ["{broken", EVENTS[0]]))
    publish(letters, "json", str(tmp_path), "dead")
    (row,) = [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/dead").collect()]
    assert row["value"] == "{broken" and {h["key"]: h.get("value") for h in row["headers"]}["error"] == "record can't be read"
    chosen = spark.createDataFrame([("o1", "v", 2)], "order_id string, van_id string, insert_before int")
    publish(assignment_messages(chosen), "json", str(tmp_path), "assignments")
    (row,) = [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/assignments").collect()]
    assert row["key"] == "v" and json.loads(row["value"])["order_id"] == "o1"
    with pytest.raises(ValueError):
        publish(letters, "fax", "", "")
