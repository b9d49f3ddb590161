import random
from datetime import datetime, timedelta

from fleetloom.operators.intervals import SPAN_US, IntervalMap, gaps, periods, valid_intervals


def brute(rows):
    out = {}
    for k, s, e in sorted(rows):
        own = out.setdefault(k, [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    return {(k, s, e) for k, own in out.items() for s, e in own}


def test_the_map_merges_what_overlaps_nests_or_touches():
    m = IntervalMap()
    for s, e in [(10, 20), (30, 40), (20, 22), (50, 60), (35, 55), (5, 5), (1, 2), (12, 13)]:
        m.insert(s, e)
    assert m.periods() == [(1, 2), (5, 5), (10, 22), (30, 60)] and m.gaps() == [(2, 5), (5, 10), (22, 30)]


def test_random_maps_against_sorting():
    rng = random.Random(1)
    for _ in range(200):
        rows = [("k", s := rng.randrange(100), s + rng.randrange(12)) for _ in range(rng.randrange(1, 30))]
        m = IntervalMap()
        for _, s, e in rows:
            m.insert(s, e)
            own = m.periods()
            assert m.gaps() == [(a[1], b[0]) for a, b in zip(own, own[1:])]  # after every insertion
            assert all(m.around(x)[:2] == (x, y) for x, y in own)
        assert {("k", *p) for p in m.periods()} == brute(rows)


def test_periods_and_gaps_over_borders(spark):
    rng = random.Random(2)
    for width in (3600, 40_000, 300_000):
        rows = [(rng.choice(["hot", "hot", "a", "b"]), s := rng.randrange(0, 20 * 86_400) * 1_000_000, s + rng.randrange(width) * 1_000_000) for _ in range(400)]
        rows += [("edge", 0, SPAN_US), ("edge", SPAN_US, 2 * SPAN_US), ("edge", 3 * SPAN_US, 3 * SPAN_US), ("neg", -5, -1), ("neg", -SPAN_US - 9, -SPAN_US)] + rows[:50]
        df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
        want = brute(rows)
        assert {(r.k, r.s, r.e) for r in periods(df, "k").collect()} == want
        found = {(r.k, r.gap_start_us, r.gap_end_us) for r in gaps(df, "k").collect()}
        by = {}
        for k, s, e in sorted(want):
            by.setdefault(k, []).append((s, e))
        assert found == {(k, a[1], b[0]) for k, own in by.items() for a, b in zip(own, own[1:])}


def test_invalid_rows_nulls_and_extra_columns(spark):
    t = datetime(2024, 1, 1)
    h = lambda n: t + timedelta(hours=n)
    rows = [("v", h(0), h(1)), ("v", h(0), h(1)), ("v", h(2), h(1)), ("v", h(3), h(15)), ("v", h(3), h(15) + timedelta(microseconds=1)), (None, h(0), h(1)), ("v", None, h(1)), ("v", h(1), None), ("v", h(20), h(20))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "van string, a timestamp_ntz, d timestamp_ntz, s int, span int")
    got = sorted((r.e - r.s) // 3_600_000_000 for r in valid_intervals(df, "van", "a", "d", 12 * 3600).collect())
    assert got == [0, 1, 12]
    empty = spark.createDataFrame([], "k string, s bigint, e bigint")
    assert periods(empty, "k").count() == 0 and gaps(empty, "k").count() == 0
