"""State machines against the expectations that the pipeline is known by, and against slow plain versions."""

import math
import random

import numpy as np
import pytest

from fleetloom.operators.state.dedup import BloomDedup, WindowDedup, bloom_size, fnv1a, string_hash
from fleetloom.operators.state.eta import EtaTracker, Route, Stop
from fleetloom.operators.state.streams import NewestPlan, ReorderBuffer, Throttle, TokenBuckets, retried


def accepted(verdicts):
    return [v in ("new", "reset") for v in verdicts]


def plain_window(numbers, window, reset):
    highest, seen, out = None, set(), []
    for n in numbers:
        if highest is None or n > highest:
            highest = n
            seen = {s for s in seen if s > highest - window} | {n}
            out.append("new")
        elif highest - n >= reset:
            highest, seen = n, {n}
            out.append("reset")
        elif highest - n >= window:
            out.append("too_old")
        elif n in seen:
            out.append("duplicate")
        else:
            seen.add(n)
            out.append("new")
    return out


def test_window_known_cases():
    assert all(accepted(WindowDedup(64).check(np.arange(100_000))))
    shuffled = np.random.default_rng(42).permutation(np.arange(1000, 1200))
    d = WindowDedup()
    assert all(accepted(d.check(shuffled))) and not any(accepted(d.check(np.random.default_rng(7).permutation(shuffled))))
    assert accepted(WindowDedup(128).check([10, 100, 10, 200, 10, 150, 150])) == [True, True, False, True, False, True, False]
    assert list(WindowDedup(reset=10_000).check([50_000, 1, 2, 1])) == ["new", "reset", "new", "duplicate"]
    with pytest.raises(ValueError):
        WindowDedup(100)


@pytest.mark.parametrize("seed", range(6))
def test_window_against_one_by_one_in_any_batches(seed):
    rng = random.Random(seed)
    at, numbers = 0, []
    for _ in range(3000):
        at = max(0, at + rng.choice([1, 1, 1, 2, 0, -1, -5, -90, 300, -2000, 5000]))
        numbers.append(at)
    d, got, k = WindowDedup(64, 1000), [], 0
    while k < len(numbers):
        n = rng.randrange(1, 400)
        got += list(d.check(np.array(numbers[k : k + n])))
        k += n
    assert got == plain_window(numbers, 64, 1000)


def test_bloom_sizes_hashes_and_error():
    assert bloom_size(100_000, 0.001) == (1_437_758, 9)
    assert fnv1a(b"") == 0x811C9DC5 - 2**32 and fnv1a(b"a") == 0xE40C292C - 2**32 and string_hash("hello") == 99162322
    b = BloomDedup(100_000, 0.001)
    assert sum(b.is_duplicate("v", k) for k in range(10_000)) < 20
    assert all(b.is_duplicate("v", k) for k in range(10_000))
    small = BloomDedup(1000, 0.01)
    assert sum(small.is_duplicate("v", k) for k in range(20_000)) < 800 and small.rotations >= 18


@pytest.mark.parametrize("expected", [7, 100, 5000])
def test_bloom_in_batches_is_the_same_as_one_by_one(expected):
    numbers = np.random.default_rng(3).integers(-50, 900, 3000)
    one, many = BloomDedup(expected, 0.01), BloomDedup(expected, 0.01)
    single = [one.is_duplicate("van-1", int(n)) for n in numbers]
    cuts = [0, 1, 2, 500, 501, 1700, 3000]
    batched = np.concatenate([many.check("van-1", numbers[a:b]) for a, b in zip(cuts, cuts[1:])])
    assert list(batched) == single and one.rotations == many.rotations and (one.now == many.now).all()
    h1, h2 = fnv1a(b"van-1:-37"), string_hash("van-1:-37")
    wrap = lambda x: (x + 2**31) % 2**32 - 2**31
    assert list(one._places("van-1", np.array([-37]))[0]) == [abs(int(math.fmod(wrap(h1 + i * h2), one.bits))) for i in range(one.hashes)]


def test_reorder_buffer_known_cases():
    b = ReorderBuffer(grace=3000)
    for t, n in [(1000, 3), (0, 1), (500, 2)]:
        assert b.offer(t, n)
    assert [w[1] for w in b.drain(3600)] == [1, 2] and [w[1] for w in b.drain(4100)] == [3]
    assert not b.offer(0, 9) and b.offer(1000, 10)
    b = ReorderBuffer(grace=3000)
    b.offer(5, 8), b.offer(5, 7)
    assert [w[1] for w in b.drain(5 + 3001)] == [7, 8]
    b = ReorderBuffer(grace=3000)
    b.offer(100, 1), b.offer(200, 2, "RETURNED")
    assert [w[1] for w in b.drain(100)] == [1, 2]
    b = ReorderBuffer(grace=3000, most=3)
    assert [b.offer(k, k) for k in range(4)] and len(b.drain(0)) == 4


def test_throttle_plans_and_buckets():
    t = Throttle(500)
    assert [t.due(*x) for x in [(0, "A"), (200, "A"), (300, "B"), (700, "B"), (800, "B")]] == [True, False, True, False, True]
    p = NewestPlan()
    assert [p.put(*x) for x in [("r1", 1, 10), ("r1", 1, 99), ("r1", 2, 5), ("r2", 0, 4), ("r2", 0, None), ("r1", 0, 3)]] == [True, False, True, False, True, True]
    b = TokenBuckets()
    assert [b.try_acquire("a", 0) for _ in range(4)] == [True, True, True, False]
    assert b.try_acquire("a", 10) and not b.try_acquire("a", 10)
    b = TokenBuckets(burst=100, all_per_minute=5)
    assert [b.try_acquire(f"c{k}", 0) for k in range(7)] == [True] * 5 + [False] * 2 and b.clients["c6"][0] == 100
    b.try_acquire("x", 10_000)
    assert set(b.clients) == {"x"}


def test_retries_then_raises():
    calls, pauses = [], []

    def fails(n):
        calls.append(1)
        if len(calls) <= n:
            raise OSError("busy")
        return "done"

    assert retried(lambda: fails(2), 3, pauses.append) == "done" and pauses == [0.2, 0.4]
    calls.clear()
    with pytest.raises(OSError):
        retried(lambda: fails(9), 3, pauses.append)
    assert len(calls) == 4


def north():
    """41 vertices to the north, stops at vertices 20 and 30; 40 m/s."""
    lat = 52.3 + np.arange(41) * 0.0005
    return Route(lat, np.full(41, 4.85)), [Stop(20, lat[20], 4.85, 1000.0, "a"), Stop(30, lat[30], 4.85, 2000.0, "b")]


def tracker(route=None):
    line, stops = north()
    t = EtaTracker()
    t.plan("r", route or line, stops, 36.0, 4.0)
    return t, line, stops


def test_eta_known_cases():
    t, line, stops = tracker()
    step = line.cum[1]
    e = t.ping(0, "r", line.lat[10], 4.85, "EN_ROUTE", 0)
    assert e.eta_s == round(10 * step / 40) and e.method == "ROUTE" and e.risk == "NONE"
    zone = np.ones(40)
    zone[14:20] = 0.5
    t, *_ = tracker(Route(line.lat, line.lon, zone))
    assert t.ping(0, "r", line.lat[10], 4.85, "EN_ROUTE", 0).eta_s == math.floor((4 * step + 6 * step * 2) / 40 + 0.5)
    t, *_ = tracker()
    t.ping(0, "r", line.lat[4], 4.85, "EN_ROUTE", 0)
    assert t.speed is None
    t.ping(5, "r", line.lat[6], 4.85, "EN_ROUTE", 0)
    assert abs(t.speed - 2 * step / 5) < 1e-6
    t.ping(10, "r", line.lat[7], 4.85, "EN_ROUTE", 0)
    assert abs(t.speed - (0.3 * step / 5 + 0.7 * 2 * step / 5)) < 1e-6
    late, *_ = tracker()
    e = late.ping(1020, "r", stops[0].lat, 4.85, "DELIVERING", 0)
    assert (e.risk, e.slack_s, e.eta_s) == ("CRITICAL", -20, 0)
    off = late.ping(0, "r", line.lat[10], 4.86, "EN_ROUTE", 0)
    assert off.method == "STRAIGHT_LINE"
    assert late.ping(0, "other", line.lat[10], 4.85, "EN_ROUTE", 0).risk == "UNKNOWN"
    assert late.ping(0, "other", line.lat[10], 4.85, "RETURNING", 0).eta_s == -1


def test_many_pings_at_once_equal_one_by_one():
    rng = random.Random(3)
    for _ in range(150):
        n, plans, rows, at, rid = rng.randrange(2, 9), {}, [], 1000.0, "a"
        lat, lon = [52 + rng.random() * 0.02 for _ in range(n)], [4.8 + rng.random() * 0.02 for _ in range(n)]
        for name in "ab":
            r = Route(lat if name == "a" else lat[::-1], lon if name == "a" else lon[::-1], np.array([rng.choice([0.4, 0.5, 1.0]) for _ in range(n - 1)]))
            vertices = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
            plans[name] = r, [Stop(v, r.lat[v], r.lon[v], rng.choice([None, 1000.0 + rng.random() * 500]), rng.choice([None, "c", "d"])) for v in vertices]
        for _ in range(rng.randrange(1, 60)):
            at, rid, k, f = at + rng.choice([0, 0.1, 0.2, 5, 29, 31]), rng.choice([rid] * 8 + ["a", "b", "x", None]), rng.randrange(n - 1), rng.random()
            place = lat[k] + f * (lat[k + 1] - lat[k]) + rng.choice([0, 0, 0.005]) * rng.random(), lon[k] + f * (lon[k + 1] - lon[k])
            rows.append((at, rid, *place, rng.choice(["EN_ROUTE"] * 5 + ["DELIVERING", "IDLE"]), rng.choice([-1, 0, 0, 1, 1, 2, 7]), rng.choice([0.0, 20.0, math.nan]), rng.choice([1.0, 0.5])))
        one, many, want, got, k = EtaTracker(), EtaTracker(), [], [], 0
        for r in rows:
            if r[1] != one.route_id and r[1] in plans:
                one.plan(r[1], *plans[r[1]])
            e = one.ping(*r)
            want.append((e.eta_s, e.method, e.risk, e.slack_s))
        while k < len(rows):
            part = rows[k : k + rng.randrange(1, 20)]
            k += len(part)
            columns = [np.array([r[i] for r in part], dtype=object if i in (1, 4) else np.int64 if i == 5 else float) for i in range(8)]
            eta, method, risk, slack, _ = many.pings(*columns, plans.get)
            got += [(int(a), b, c, None if d != d else int(d)) for a, b, c, d in zip(eta, method, risk, slack)]
        assert got == want and many.first_prediction == one.first_prediction and many.arrivals == one.arrivals


def test_a_ping_without_a_place_is_unknown():
    t = EtaTracker()
    t.plan("r", Route([52.0, 52.1], [4.0, 4.0]), [Stop(1, 52.1, 4.0, 9e9, "c")])
    nan = np.array([math.nan])
    eta, method, risk, _, _ = t.pings(np.array([1.0]), np.array(["r"], object), nan, nan, np.array(["EN_ROUTE"], object), np.array([0]), nan, np.array([1.0]))
    assert (eta[0], method[0], risk[0]) == (-1, "NONE", "UNKNOWN")
