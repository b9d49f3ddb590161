import numpy as np
import pytest

from fleetloom.operators import quantiles
from fleetloom.operators.quantiles import RelativeSketch, above, merged, percentiles, seed_of, sketches


@pytest.mark.parametrize("make", [lambda r, n: r.lognormal(5, 1.5, n), lambda r, n: np.arange(n, dtype=float), lambda r, n: np.arange(n, 0, -1.0), lambda r, n: r.integers(0, 5, n).astype(float)])
def test_ranks_are_within_the_certain_bound_and_close_at_the_top(make):
    values = make(np.random.default_rng(1), 200_000)
    s = RelativeSketch().update(values)
    assert sum(len(c.items) for c in s.levels) < 6000
    for q in (0.01, 0.5, 0.9, 0.99, 0.999, 1.0):
        x = np.quantile(values, q)
        true = int((values <= x).sum())
        estimate, off = s.rank(x)
        assert abs(estimate - true) <= off
        assert abs(estimate - true) <= max(1, 0.03 * (len(values) - true + 1)) + 1


def test_merging_days_is_as_good_as_one_sketch_and_bytes_round_trip():
    rng = np.random.default_rng(2)
    days = [rng.exponential(100, int(n)) for n in rng.integers(1, 20_000, 40)]
    s = RelativeSketch()
    for d in days:
        s.merge(RelativeSketch.from_bytes(RelativeSketch().update(d).to_bytes()))
    values = np.concatenate(days)
    assert s.count == len(values)
    for pct in (50, 90, 99, 99.9):
        true = (values <= s.percentile(pct)).mean() * 100
        assert abs(true - pct) <= 0.03 * (100 - pct) + 0.01
    again = RelativeSketch.from_bytes(s.to_bytes())
    assert again.rank(100.0) == s.rank(100.0) and again.percentile(99) == s.percentile(99)


def test_small_sketches_are_exact_and_empty_ones_have_no_percentile():
    s = RelativeSketch().update(np.array([3.0, 1.0, np.nan, 2.0, 2.0]))
    assert [s.percentile(p) for p in (1, 25, 50, 75, 76, 100)] == [1, 1, 2, 2, 3, 3] and s.rank(2.0) == (3, 0)
    assert np.isnan(RelativeSketch().percentile(50))
    assert RelativeSketch.from_bytes(RelativeSketch().to_bytes()).count == 0


def test_decisions_are_exact_for_a_hot_key_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v), 1) for v in rng.integers(1, 400, 30_000)] + [(f"v{k % 40}", float(v), 1) for k, v in enumerate(rng.integers(1, 400, 30_000))]
    rows += [("few", 1e9, 1)] * 19 + [("same", 200.0, 1)] * 50 + [(None, 5.0, 1), ("hot", None, 1)]
    df = spark.createDataFrame(rows, "van string, v double, pct int").repartition(7)
    limits = {50: 200, 90: 360, 99: 396}
    got = {(r.van, r.pct) for r in above(merged(sketches(df, "van", "v"), "van"), df, "van", "v", limits, least=20).collect()}
    by = {}
    for k, v, _ in rows:
        if k and v is not None:
            by.setdefault(k, []).append(v)
    want = {(k, p) for k, x in by.items() if len(x) >= 20 for p, most in limits.items() if sorted(x)[-(-p * len(x) // 100) - 1] > most}
    assert got == want and ("same", 50) not in got
    table = {(r.van, r.pct): r.estimate for r in percentiles(merged(sketches(df, "van", "v"), "van"), "van", [50, 100]).collect()}
    assert table["same", 50] == 200 and table["hot", 100] == max(by["hot"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "van string, v double")
    assert merged(sketches(df, "van", "v"), "van").count() == 0
    assert above(merged(sketches(df, "van", "v"), "van"), df, "van", "v", {50: 1}).count() == 0


def test_errors_of_many_merged_parts_cancel():
    own, same = [], []
    for run in range(4):
        rng = np.random.default_rng(run)
        parts = [rng.lognormal(5, 1, 2_000) for _ in range(256)]
        values = np.sort(np.concatenate(parts))
        for seeds, out in (([seed_of("van", k, p[:64].tobytes()) for k, p in enumerate(parts)], own), ([1] * len(parts), same)):
            s = RelativeSketch(seed=0)
            for p, seed in zip(parts, seeds):
                s.merge(RelativeSketch.from_bytes(RelativeSketch(seed=seed).update(p).to_bytes()))
            out.append([(s.rank(x)[0] - np.searchsorted(values, x, "right")) / len(values) for x in np.quantile(values, [0.1, 0.3, 0.5, 0.7])])
    assert np.abs(own).max() < 0.008
    assert np.abs(np.mean(own, axis=0)).max() < 0.003 < np.abs(np.mean(same, axis=0)).max()


def test_coins_go_on_after_a_round_trip_and_differ_between_seeds():
    a = RelativeSketch(seed=5).update(np.arange(3000.0))
    b = RelativeSketch.from_bytes(a.to_bytes())
    more = np.random.default_rng(1).normal(size=5000)
    assert a.update(more).to_bytes() == b.update(more).to_bytes()
    assert RelativeSketch(seed=6).update(np.arange(3000.0)).coins != RelativeSketch(seed=7).update(np.arange(3000.0)).coins
    assert seed_of("v", 1, b"x") != seed_of("v", 2, b"x") != seed_of("v", 2, b"y")


def test_more_keys_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD", 7)
    df = spark.createDataFrame([(f"k{k % 50}", float(k)) for k in range(1000)], "van string, v double").coalesce(1)
    got = {r.van: r.n for r in merged(sketches(df, "van", "v"), "van").collect()}
    assert got == {f"k{k}": 20 for k in range(50)}
