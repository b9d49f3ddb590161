import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetloom.operators.generator import Network, drive, fleet, leg_ends, nearest_first, route, through_network, with_stop
from fleetloom.operators.intervals import IntervalMap
from fleetloom.operators.late_periods import PeriodTable, replay
from fleetloom.operators.sequences import accepted_plans, admitted_requests, archive_sample, bloom_verdicts, estimates, late_pings, plans_from_logs, sampled, throttled, window_verdicts
from fleetloom.operators.state.dedup import NEW, RESET, WindowDedup
from fleetloom.operators.state.streams import ReorderBuffer, Throttle
from fleetloom.schemas import GPS_EVENT
from fleetloom.session import fresh_path
from fleetloom.sources.tables import StoredTable
from fleetloom.sources.zones import active_zones
from fleetloom.streaming import intervals as live_intervals
from fleetloom.streaming.pings import OUTPUT, PingProcessor, keyed_pings, ordered_pings, use_rocksdb
from fleetloom.streaming.sinks import Counters, observed, periods_sink, pings_sink

BASE = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for van in ("v", "w"):
        for n in range(300):
            t = BASE + timedelta(seconds=float(n))
            for _ in range(1 + int(rng.random() < 0.1)):
                k += 1
                lag = float(rng.exponential(1.5)) + (20 if rng.random() < 0.03 else 0)
                rows.append((f"e{k}", van, n + 1, t, t + timedelta(seconds=lag), (52.0, 4.9), 10.0, 0.0, 50, "r", 0, 3, "RETURNED" if n == 299 else "EN_ROUTE"))
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], GPS_EVENT + ", record_id bigint")


def in_order(log):
    rows = log.collect()
    return sorted(rows, key=lambda r: (r.van_id, r.ingestion_timestamp, r.record_id))


def test_window_verdicts_and_sampling_against_one_by_one(spark, log):
    rows = in_order(log)
    got = {r.record_id: r.verdict for r in window_verdicts(log, 64, 1000).collect()}
    for van in ("v", "w"):
        own = [r for r in rows if r.van_id == van]
        assert [got[r.record_id] for r in own] == list(WindowDedup(64, 1000).check([r.sequence_number for r in own]))
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    kept, published = set(), set()
    for van in ("v", "w"):
        a, p = Throttle(10_000_000, on_change=False, always="RETURNED"), Throttle(7_000_000)
        own = [r for r in rows if r.van_id == van]
        published |= {r.record_id for r in own if p.due(us(r.ingestion_timestamp), r.status)}
        kept |= {r.record_id for r in sorted(own, key=lambda r: (r.device_timestamp, r.sequence_number, r.record_id)) if a.due(us(r.device_timestamp), r.status)}
    assert {r.record_id for r in archive_sample(log, 10).collect()} == kept
    assert {r.record_id for r in throttled(log, 7).collect()} == published
    assert sampled(log, 60).count() == len({(r.van_id, us(r.ingestion_timestamp) // 60_000_000) for r in rows})


def test_late_pings_against_every_pair(spark, log):
    rows = log.collect()
    want = {
        e.record_id for e in rows
        if any(f.van_id == e.van_id and f.ingestion_timestamp <= e.ingestion_timestamp and f.device_timestamp + timedelta(seconds=3) < e.ingestion_timestamp and f.device_timestamp > e.device_timestamp for f in rows)
    }
    assert {r.record_id for r in late_pings(log).collect()} == want and want


def run(spark, streaming, mode, name, sink=None):
    w = streaming.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, "check"))
    w = w.foreachBatch(sink) if sink else w.format("memory").queryName(name)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return None if sink else spark.table(name)


def files_in_order(spark, df, order, parts, name):
    """A folder that a file stream reads one file at a time, in order."""
    import time

    where = fresh_path(spark, name)
    rows = df.orderBy(order).collect()
    for k in range(parts):
        own = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
        spark.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(where)
        time.sleep(1.1)
    return where


def test_stream_of_pings_equals_the_machines(spark, log):
    use_rocksdb(spark)
    keyed = keyed_pings(log)
    where = files_in_order(spark, keyed, "at_us", 3, "pings")
    stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", 1).parquet(where)
    counters = Counters()
    spark.streams.addListener(counters)
    got = run(spark, observed(ordered_pings(stream, PingProcessor(window=64, reset=1000)), "pings"), "append", "ordered").collect()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(counters)
    assert counters.totals["pings"]["rows"] == len(got) and counters.totals["pings"]["late"] == sum(r.kind == "late" for r in got)
    want = []
    for van in ("v", "w"):
        d, b = WindowDedup(64, 1000), ReorderBuffer(3_000_000)
        for r in sorted((r for r in keyed.collect() if r.van_id == van), key=lambda r: r.at_us):
            (verdict,) = d.check([r.seq])
            want += [("released", van, w[1]) for w in b.drain(r.at_us)]
            if verdict not in (NEW, RESET):
                want.append((verdict, van, r.seq))
            elif not b.offer(r.ts_us, r.seq, r.status):
                want.append(("late", van, r.seq))
    assert sorted((r.kind, r.van_id, r.seq) for r in got) == sorted(want)
    assert {"released", "late", "duplicate"} <= {r.kind for r in got}


def test_sinks_take_a_batch_once(spark, log):
    df = spark.createDataFrame([("released", "v", 1, 10, 20, "IDLE", "{}"), ("released", "v", 2, 30, 40, "IDLE", "{}"), ("late", "v", 0, 1, 50, "IDLE", "{}"), ("duplicate", "v", 1, 10, 60, "IDLE", "{}")], OUTPUT)
    from fleetloom.schemas import DEAD_LETTER_LOG

    archive, letters = StoredTable(spark, fresh_path(spark, "a"), OUTPUT), StoredTable(spark, fresh_path(spark, "l"), DEAD_LETTER_LOG)
    live = StoredTable(spark, fresh_path(spark, "v"), "van_id string, seq bigint, ts_us bigint, at_us bigint, status string, payload string")
    sink = pings_sink(archive, letters, live, "q")
    sink(df, 0)
    sink(df, 0)
    assert archive.read().count() == 3 and letters.read().count() == 1 and live.read().first().seq == 2


def test_period_stream_equals_replay(spark, log):
    from fleetloom.operators.late_periods import arrivals

    late = log.withColumn("ingestion_timestamp", F.when(F.col("sequence_number") % 7 == 0, F.col("ingestion_timestamp") + F.expr("interval 5000 seconds")).otherwise(F.col("ingestion_timestamp")))
    rows = arrivals(late)
    where = files_in_order(spark, rows, "arrival_us", 3, "arrivals")
    table = PeriodTable(spark, fresh_path(spark, "live-periods"))
    run(spark, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(where), "append", None, periods_sink(table))
    state = lambda t: sorted((r.van_id, r.period_start, r.first_pings, r.pings, r.late_pings) for r in t.current().collect())
    assert state(table) == state(replay(late)) and len(table.versions()) == 3


def test_interval_stream_keeps_the_map(spark):
    rng = np.random.default_rng(1)
    rows = [(n, "k" if n % 3 else "j", int(s), int(s + rng.integers(0, 40))) for n, s in enumerate(rng.integers(0, 1000, 90))]
    df = spark.createDataFrame(rows, "n int, key string, s bigint, e bigint")
    where = files_in_order(spark, df, "n", 3, "intervals")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)
    got = run(spark, live_intervals.merged_periods(stream, "key"), "update", "busy").collect()
    for key in ("k", "j"):
        m, reported = IntervalMap(), {(r.period_start, r.period_end) for r in got if r.key == key}
        for _, k, s, e in rows:
            if k == key:
                m.insert(s, e)
        assert set(m.periods()) <= reported


def test_estimates_over_logged_routes(spark):
    logs = spark.createDataFrame(
        [("a", "v", "r", 0, "c0", (52.300, 4.85), BASE + timedelta(seconds=500), BASE), ("b", "v", "r", 1, "c1", (52.310, 4.85), BASE + timedelta(seconds=900), BASE), ("c", "v", "r", 1, "c1", (52.9, 4.85), BASE, BASE + timedelta(seconds=9))],
        "id string, van_id string, route_id string, stop_index int, customer_id string, location struct<latitude:double,longitude:double>, sla_deadline timestamp, created_at timestamp",
    )
    plans = plans_from_logs(logs)
    assert plans.first().lats == [52.300, 52.310]
    us = lambda s: int((BASE - datetime(1970, 1, 1)).total_seconds() * 1e6) + s * 1_000_000
    pings = spark.createDataFrame([(1, "v", "r", us(0), 52.305, 4.85, "EN_ROUTE", 1, 36.0), (2, "v", "x", us(1), 52.3, 4.85, "EN_ROUTE", 0, 0.0), (3, "w", "r", us(1), 52.3, 4.85, "IDLE", None, 0.0)], "record_id bigint, van_id string, route_id string, ts_us bigint, lat double, lon double, status string, leg int, speed_kmh double")
    got = {r.record_id: r for r in estimates(pings, plans).collect()}
    assert got[1].method == "ROUTE" and got[1].eta_s == 56 and got[1].risk == "NONE" and got[2].risk == "UNKNOWN" and got[3].eta_s == -1


def test_generated_fleets_are_repeatable(spark):
    one, two = fleet(spark, 4, 4, seed=3), fleet(spark, 4, 4, seed=3).repartition(2)
    ids = one.groupBy("event_id").agg(F.countDistinct("van_id", "sequence_number").alias("n"), F.count("*").alias("c"))
    assert ids.where("n > 1").count() == 0 and ids.where("c > 1").count() > 0 and one.where("event_id not rlike '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$'").count() == 0
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    rng = np.random.default_rng(1)
    line, vertices = route(rng, 6)
    assert len(vertices) == 6 and (np.diff(vertices) > 0).all() and np.diff(line.cum).max() <= 50.5
    p = drive(rng, line, vertices, 0.0)
    out = through_network(rng, p, Network(copies=0.2))
    assert set(out["seq"]) == set(range(1, len(p) + 1)) and len(out) > len(p) and (out["at"].diff().dropna() >= 0).all() and p["status"].iloc[-1] == "RETURNED"
    assert list(nearest_first(np.array([3.0, 1.0, 2.0]), np.zeros(3), (0.0, 0.0))) == [1, 2, 0]


def test_routes_take_another_stop_and_find_their_leg_ends():
    rng = np.random.default_rng(2)
    line, vertices = route(rng, 5)
    longer, at = with_stop(line, vertices, line.cum[vertices[0]] + 1, 2, 52.37, 4.91)
    assert len(at) == 6 and (np.diff(at) > 0).all() and list(at[:2]) == list(vertices[:2])
    assert np.allclose([longer.lat[at[2]], longer.lon[at[2]]], [52.37, 4.91]) and np.allclose(longer.lat[at[3:]], line.lat[vertices[2:]])
    legs = np.diff(np.concatenate([[0], line.cum[vertices]]))
    assert list(leg_ends(line, legs * 1.01, np.column_stack([line.lat[vertices], line.lon[vertices]]))) == list(vertices)


def test_bloom_plans_and_requests_as_sequences(spark, log):
    got = {r.record_id: r.repeated for r in bloom_verdicts(log, 1000, 0.001).collect()}
    seen, wrong = set(), 0
    for r in in_order(log):
        again = (r.van_id, r.sequence_number) in seen
        seen.add((r.van_id, r.sequence_number))
        assert got[r.record_id] or not again
        wrong += got[r.record_id] and not again
    assert wrong <= 3
    plans = spark.createDataFrame([("v", "r1", 1, 10, 1), ("v", "r1", 1, 99, 2), ("v", "r2", None, 5, 3), ("v", "r2", 0, None, 4), ("w", "r9", 0, None, 1), (None, "x", 1, 1, 1)], "van_id string, route_id string, version int, created_s int, arrival bigint")
    assert [(r.van_id, r.accepted) for r in accepted_plans(plans).orderBy("van_id", "arrival").collect()] == [("v", True), ("v", False), ("v", False), ("v", True), ("w", True)]
    asked = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 12)] + [("b", 3), (None, 1)], "client string, at_s int")
    assert [(r.client, r.passed) for r in admitted_requests(asked).collect()] == [("a", True), ("a", True), ("a", True), ("a", False), ("b", True), ("a", True)]


def test_stream_of_estimates_equals_the_batch_and_feeds_the_live_table(spark, log):
    from fleetloom import schemas
    from fleetloom.streaming.pings import EstimateProcessor, estimated_pings, keyed_plans
    from fleetloom.streaming.sinks import live_sink, predictions

    us = lambda s: int((BASE - datetime(1970, 1, 1)).total_seconds() * 1e6) + int(s * 1e6)
    rng, rows, n = random.Random(5), [], 0
    for van in ("v", "w"):
        for k in range(60):
            at, n = us(k * 5), n + 1
            status = "DELIVERING" if k % 20 > 16 else "EN_ROUTE"
            rows.append((f"e{n}", van, k, BASE + timedelta(seconds=k * 5), BASE + timedelta(seconds=k * 5 + rng.choice([1, 1, 2, 7])), (52.3 + k * 0.0005, 4.85), 30.0, 1.0, 50, "r" if van == "v" or k < 30 else "none", min(2, k // 20), 3, status))
    records = spark.createDataFrame(rows, schemas.GPS_EVENT)
    plan = ([52.30, 52.31, 52.32, 52.33], [4.85] * 4, [1.0, 0.5, 1.0], [1, 2, 3], [us(60) / 1e6, us(200) / 1e6, None], ["a", "b", "c"])
    plans = spark.createDataFrame([("v", "r", *plan, 1, us(-1)), ("w", "r", *plan, 1, us(-1))], "van_id string, route_id string, lats array<double>, lons array<double>, factors array<double>, vertices array<int>, deadlines array<double>, customers array<string>, version int, created_us bigint")
    zone = spark.createDataFrame([("z", "Yard", "T", "0.50", "POLYGON((4.8 52.31, 4.9 52.31, 4.9 52.32, 4.8 52.32, 4.8 52.31))", True)], "id string, name string, zone_type string, speed_factor string, geometry string, active boolean")
    zones = active_zones(zone.withColumn("speed_factor", F.col("speed_factor").cast("decimal(3,2)")))
    keyed = keyed_pings(records, zones)
    where = fresh_path(spark, "estimates-in")
    keyed_plans(plans).coalesce(1).write.parquet(f"{where}/plans")
    for part, low, high in (("a", 0, 25), ("b", 25, 60)):
        keyed.where(f"seq >= {low} and seq < {high}").coalesce(1).write.parquet(f"{where}/{part}")
    stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/*")
    out = estimated_pings(stream.where("status <> 'PLAN'"), stream.where("status = 'PLAN'"), EstimateProcessor(window=64, reset=1000))
    got = run(spark, out, "append", "estimated").where("kind = 'released'")
    told = {(r.van_id, r.seq): (r.eta_s, r.method, r.risk, r.slack_s) for r in got.collect()}
    pings = keyed.withColumn("p", F.from_json("payload", "route_id string, location struct<latitude:double,longitude:double>, speed_kmh double, current_stop_index int, speed_factor double")).select(
        (F.col("seq") + F.when(F.col("van_id") == "w", 1000).otherwise(0)).alias("record_id"), "van_id", "p.route_id", "ts_us", F.col("p.location.latitude").alias("lat"), F.col("p.location.longitude").alias("lon"),
        "status", F.col("p.current_stop_index").alias("leg"), "p.speed_kmh", F.col("p.speed_factor").alias("zone_factor"),
    )
    want = {(r.van_id, r.record_id % 1000): (r.eta_s, r.method, r.risk, r.slack_s) for r in estimates(pings, plans).collect()}
    # what was late isn't seen by the stream, so the learned speed may differ after it; here nothing was
    assert len(told) > 100 and told == {k: want[k] for k in told}
    live = StoredTable(spark, fresh_path(spark, "live"), schemas.LIVE_VANS)
    sink = live_sink(live, "q")
    sink(got.where("seq < 30"), 0)
    sink(got, 1)
    sink(got, 1)
    last = {r.van_id: r for r in live.read().collect()}
    newest = max(k for v, k in told if v == "v")
    assert (last["v"].eta_seconds, last["v"].sla_risk) == (told["v", newest][0], told["v", newest][2]) and last["w"].sla_risk == "UNKNOWN"
    assert predictions(got).groupBy("van_id", "route_id", "stop_index").count().count() == 5


def test_timetables_and_assignments():
    from fleetloom.operators.generator import Driven, apply_assignment, timetable

    rng = np.random.default_rng(3)
    line, vertices = route(rng, 400)
    planned, due = timetable(rng, line, vertices, 1000.0, 36.0, 2.0)
    assert np.allclose(planned[0], 1000 + line.cum[vertices[0]] / 10 / 2) and np.allclose(np.diff(planned), (np.diff(line.cum[vertices]) / 10 + 40) / 2)
    slack = (due - planned) * 2
    assert slack.min() >= -60 and slack.max() <= 600 and 0.08 < (slack <= 90).mean() < 0.22 and not ((slack > 90) & (slack < 180)).any()
    line, vertices = route(rng, 5)
    vans = {"v": Driven("r", line, vertices, 0.0, 2), "gone": Driven("r", line, vertices, ended=True)}
    asked = {"van_id": "v", "route_id": "r", "latitude": 52.37, "longitude": 4.91, "insert_before": 1, "sla_deadline": "2024-01-01T00:00:00Z", "order_id": "o"}
    assert apply_assignment(vans, asked | {"latitude": None}) == ("rejected", "malformed assignment")
    assert apply_assignment(vans, asked | {"van_id": "w"}) == ("rejected", "w is not running")
    assert apply_assignment(vans, asked | {"route_id": "x"})[1] == "v has moved on to another route"
    assert apply_assignment(vans, asked | {"van_id": "gone"})[1] == "gone can no longer take stops"
    assert apply_assignment(vans, asked) == ("inserted", 2) and len(vans["v"].vertices) == 6
    assert np.allclose(vans["v"].line.lat[vans["v"].vertices[2]], 52.37)
