from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np

from fleetloom.operators.stops import StopRules, stops, trips, usable_pings

LOG = "van_id string, device_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz, location struct<latitude:double,longitude:double>"
BASE = datetime(2024, 1, 1, 5, 40)
M = 1 / 111_195


def track(pieces, van="v", every=20, noise=6.0, seed=0, start=0.0):
    """Pieces (seconds, metres north): a stand if no metres, else a drive."""
    rng, t, y, rows = np.random.default_rng(seed), start, 0.0, []
    for seconds, metres in pieces:
        n = int(seconds // every)
        for k in range(n):
            t += every
            y += metres / n
            at = BASE + timedelta(seconds=t)
            rows.append((van, at, at + timedelta(seconds=1), (52 + (y + rng.normal(0, noise)) * M, 5 + rng.normal(0, noise) * M / 0.615)))
    return rows


def got(spark, rows, rules=StopRules()):
    df = spark.createDataFrame(rows, LOG)
    base = (BASE - datetime(1970, 1, 1)).total_seconds()
    return sorted((r.van_id, round(r.start_s - base), round(r.end_s - base), r.pings) for r in stops(df, rules).collect())


TRIP = [(600, 6000), (700, 0), (600, 5000), (120, 0), (600, 4000), (900, 0), (300, 3000)]


def test_stops_are_found_and_short_ones_are_not(spark):
    found = got(spark, track(TRIP))
    assert len(found) == 2
    assert abs(found[0][1] - 620) <= 40 and abs(found[0][2] - 1300) <= 40 and abs(found[1][1] - 2640) <= 40 and abs(found[1][2] - 3520) <= 40


def test_strays_wrong_clocks_copies_and_nulls_change_nothing(spark):
    rows = track(TRIP)
    clean = [(a, b // 60, c // 60) for a, b, c, _ in got(spark, rows)]
    far, at = (52.5, 5.5), BASE + timedelta(seconds=1000)
    dirty = rows + [("v", at + timedelta(seconds=1), at, far), ("v", BASE + timedelta(seconds=3000, microseconds=5), BASE + timedelta(seconds=3001), far)]
    dirty += rows[10:60] + [(None, at, at, far), ("v", None, at, far), ("v", at, at, None), ("v", at, at, (None, 5.0)), ("v", at, at, (float("nan"), 5.0)), ("v", at, at, (91.0, 5.0))]
    dirty += [("v", datetime(1998, 5, 1, 0, 0, k), at, (52.0, 5.0)) for k in range(0, 60, 5)] + [("v", at + timedelta(hours=5, seconds=k), at, (52.0, 5.0)) for k in range(0, 900, 60)]
    assert [(a, b // 60, c // 60) for a, b, c, _ in got(spark, dirty)] == clean


def test_silence_within_a_stop_joins_and_a_long_one_ends_it(spark):
    rows = track([(400, 0)]) + track([(400, 0)], start=400 + 900)
    assert len(got(spark, rows)) == 1
    rows = track([(400, 0)]) + track([(400, 0)], start=400 + 1300)
    assert len(got(spark, rows)) == 2


def test_too_few_pings_are_no_stop(spark):
    at = lambda s: BASE + timedelta(seconds=s)
    rows = [("v", at(s), at(s), (52.0, 5.0)) for s in (0, 600)]
    assert got(spark, rows) == []
    assert len(got(spark, rows + [("v", at(300), at(300), (52.0, 5.0))])) == 1


def test_spans_do_not_change_the_result(spark):
    rng = np.random.default_rng(3)
    pieces = [p for _ in range(30) for p in [(int(rng.integers(200, 900)), int(rng.integers(2000, 6000))), (int(rng.choice([60, 150, 420, 800, 1500])), 0)]]
    rows = track(pieces, seed=4) + track(pieces[10:], van="w", seed=5, every=35)
    whole = got(spark, rows, replace(StopRules(), span_s=10_000_000))
    assert whole and got(spark, rows, replace(StopRules(), span_s=3600)) == whole and got(spark, rows) == whole


def test_a_crawl_is_no_stop(spark):
    assert got(spark, track([(1800, 900)], noise=1.0)) == []


def test_trips_lie_between_stops_and_measure_the_way(spark):
    df = spark.createDataFrame(track(TRIP, noise=1.0), LOG)
    (t,) = trips(df).collect()
    assert t.trip_no == 1 and 8_500 < t.distance_m < 9_500 and abs(t.duration_s - 1320) < 80
    s = {r.stop_no: r for r in stops(df).collect()}
    assert t.start_s == s[1].end_s and t.end_s == s[2].start_s


def test_empty_and_clashing_columns(spark):
    assert got(spark, []) == []
    assert trips(spark.createDataFrame([], LOG)).count() == 0
    df = spark.createDataFrame([(*r, 1, "x") for r in track(TRIP)], LOG + ", us int, span string")
    assert stops(df).count() == 2 and usable_pings(df).columns == ["van_id", "us", "lat", "lon"]
