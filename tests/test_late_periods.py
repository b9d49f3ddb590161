from datetime import datetime, timedelta

import pytest

from fleetloom.operators.late_periods import AGGREGATES, PeriodTable, arrivals, replay
from fleetloom.session import fresh_path

BATCH = "van_id string, event_us bigint, arrival_us bigint, speed_kmh double, battery_pct int"
H = 3600 * 1_000_000


def table(spark):
    return PeriodTable(spark, fresh_path(spark, "periods-test"))


def state(t):
    return {(r.van_id, r.period_start): (r.first_pings, r.pings, r.late_pings) for r in t.current().collect()}


def cuts(t):
    return {(r.van_id, r.period_start): r.cut_pings for r in t.cut().collect()}


def test_first_published_corrected_and_cut_at_the_limits(spark):
    t = table(spark)
    on, late, cut = H + 300_000_000, H + 7_200_000_000, H + 7_200_000_001
    t.ingest(spark.createDataFrame([("v", 5, 6, 10.0, 50), ("v", 5, on, 20.0, None)], BATCH))
    assert state(t) == {("v", 0): (2, 2, 0)}
    t.ingest(spark.createDataFrame([("v", 7, on + 1, 60.0, 10), ("v", 8, late, None, 20), ("v", 9, cut, 1.0, 1), ("w", H, H + 1, 5.0, 5)], BATCH))
    assert state(t) == {("v", 0): (2, 4, 2), ("w", 3600): (1, 1, 0)}
    assert cuts(t) == {("v", 0): 1}
    row = t.current().where("van_id = 'v'").first()
    assert (row.first_avg_speed, row.avg_speed, row.min_battery, row.first_min_battery) == (15.0, 30.0, 10, 50)


def test_nulls_empty_batches_and_negative_times(spark):
    t = table(spark)
    t.ingest(spark.createDataFrame([], BATCH))
    assert state(t) == {} and cuts(t) == {}
    t.ingest(spark.createDataFrame([(None, 1, 1, 1.0, 1), ("v", None, 1, 1.0, 1), ("v", -1, None, None, None)], BATCH))
    assert state(t) == {("v", -3600): (1, 1, 0)}
    assert t.current().first().avg_speed is None
    assert sorted(t.current().columns) == sorted(c.split()[0] for c in AGGREGATES.split(", ")) and t.cut().columns == ["van_id", "period_start", "cut_pings"]


def test_a_batch_that_died_before_its_commit_leaves_no_trace(spark, monkeypatch):
    t = table(spark)
    t.ingest(spark.createDataFrame([("v", 5, 6, 10.0, 50)], BATCH))
    commit = PeriodTable._commit
    monkeypatch.setattr(PeriodTable, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    more = spark.createDataFrame([("v", 6, 7, 10.0, 50), ("v", 6, 9 * H, 1.0, 1)], BATCH)
    with pytest.raises(RuntimeError):
        t.ingest(more)
    assert state(t) == {("v", 0): (1, 1, 0)} and cuts(t) == {}
    monkeypatch.setattr(PeriodTable, "_commit", commit)
    t.ingest(more)
    assert state(t) == {("v", 0): (2, 2, 0)} and cuts(t) == {("v", 0): 1}


def test_the_result_does_not_depend_on_the_batches(spark):
    base = datetime(2024, 1, 1)
    rows = [(f"v{k % 3}", base + timedelta(seconds=37 * k), base + timedelta(seconds=37 * k + (k * k * 97) % 20_000) if k % 11 else None, float(k % 50), k % 100, "x") for k in range(400)]
    log = spark.createDataFrame(rows, "van_id string, device_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz, speed_kmh double, battery_pct int, day string")
    one, many = replay(log, 1), replay(log, 5)
    assert state(one) == state(many) and cuts(one) == cuts(many) and sum(n for *_, n in state(one).values()) > 0
    want = {}
    for r in arrivals(log).collect():
        late = r.arrival_us - (r.event_us // H + 1) * H
        if late <= 7_200_000_000:
            key = r.van_id, r.event_us // H * 3600
            a = want.setdefault(key, [0, 0, 0])
            a[0] += late <= 300_000_000
            a[1] += 1
            a[2] += late > 300_000_000
    assert state(one) == {k: tuple(v) for k, v in want.items()}


def test_an_empty_log(spark):
    log = spark.createDataFrame([], "van_id string, device_timestamp timestamp, ingestion_timestamp timestamp, speed_kmh double, battery_pct int")
    assert state(replay(log)) == {}


def test_two_writers_of_one_version_leave_each_other_s_files(spark, monkeypatch):
    path = fresh_path(spark, "periods-test")
    a, b = PeriodTable(spark, path), PeriodTable(spark, path)
    commit = PeriodTable._commit

    def other_first(self, version, attempt):
        monkeypatch.setattr(PeriodTable, "_commit", commit)
        b.ingest(spark.createDataFrame([("v", 6, 7, 10.0, 50)], BATCH))
        commit(self, version, attempt)

    monkeypatch.setattr(PeriodTable, "_commit", other_first)
    one = spark.createDataFrame([("v", 5, 6, 10.0, 50), ("w", 5, 6, 10.0, 50)], BATCH)
    with pytest.raises(FileExistsError):
        a.ingest(one)
    assert state(b) == {("v", 0): (1, 1, 0)} == state(a)
    assert a.ingest(one) == 2 and state(b) == {("v", 0): (2, 2, 0), ("w", 0): (1, 1, 0)}
    assert b.vacuum() == 3 and state(PeriodTable(spark, path)) == state(a)
