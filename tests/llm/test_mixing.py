from collections import Counter

import pytest

from fleetloom.llm.mixing import canonical_source, integer_weights, mixture, report, schedule


def test_the_schedule_keeps_every_prefix_within_a_block():
    for shares in ({"a": 0.18, "b": 0.16, "c": 0.16, "d": 0.04, "e": 0.12, "f": 0.14, "g": 0.06, "h": 0.08, "i": 0.06}, {"a": 0.5, "b": 0.333, "c": 0.167}, {"a": 0.999, "b": 0.001}, {"a": 1.0}):
        weights, period = integer_weights(shares)
        slots = schedule(weights)
        assert len(slots) == period and Counter(slots) == weights
        done = Counter()
        for t, s in enumerate(slots, 1):
            done[s] += 1
            assert all(abs(done[k] - t * w / period) < 1 for k, w in weights.items())


def test_weights_are_whole_and_small():
    assert integer_weights({"a": 0.5, "b": 0.25, "c": 0.25}) == ({"a": 2, "b": 1, "c": 1}, 4)
    assert integer_weights({"a": 3, "b": 1}) == ({"a": 3, "b": 1}, 4) and integer_weights({"a": 0, "b": None}) == ({}, 0)
    w, period = integer_weights({"a": 1 / 3, "b": 2 / 3})
    assert sum(w.values()) == period <= 1_000_000 and abs(w["a"] / period - 1 / 3) < 1e-6


def test_small_shares_and_many_sources_keep_their_weight():
    assert integer_weights({"a": 0.9997, "b": 0.0003}) == ({"a": 9997, "b": 3}, 10_000)
    assert integer_weights({"a": 0.5, "b": float("nan"), "c": -1.0, "d": float("inf")}) == ({"a": 1}, 1)
    w, period = integer_weights({f"s{k}": 1.0 for k in range(1500)})
    assert period == 1500 and set(w.values()) == {1}
    uneven = {f"s{k}": 1 + k / 7 for k in range(1500)}
    w, period = integer_weights(uneven)
    assert sum(w.values()) == period and all(abs(w[s] / period - x / sum(uneven.values())) < 1 / period for s, x in uneven.items())
    w, period = integer_weights({"a": 1 - 1e-9, "b": 1e-9 / 3}, 1000)
    assert sum(w.values()) == period and w["b"] >= 1


def test_fifteen_hundred_sources_within_a_block():
    weights, period = integer_weights({f"s{k}": 1 + k % 3 for k in range(1500)})
    done, slots = Counter(), schedule(weights)
    assert Counter(slots) == weights
    for t, s in enumerate(slots, 1):
        done[s] += 1
        if t % 100 == 0:
            assert all(abs(done[k] - t * w / period) < 1 for k, w in weights.items())


def test_no_quota_no_rows(spark):
    df, targets = docs(spark, {"a": (20, 100), "b": (10, 100)}), goals(spark, [("a", 0.9995, 1), ("b", 0.0005, 4)])
    assert mixture(df, targets, total=0).count() == 0
    m = mixture(df, targets, total=500).collect()
    assert {r.source for r in m} == {"a"} and 400 <= sum(r.tokens for r in m) <= 600 and {r.repeat_no for r in m} == {1} and min(r.slot for r in m) == 0
    tiny = mixture(df, targets, total=100, block_tokens=1_000_000).collect()
    assert [(r.source, r.slot) for r in tiny] == [("a", 0)]


def docs(spark, per_source, extra=()):
    rows, k = [], 0
    for s, (n, size) in per_source.items():
        for j in range(n):
            k += 1
            rows.append((k, s if j % 3 else f" {s.upper().replace('_', '-')} ", size + j % 5, 1, 2))
    return spark.createDataFrame(rows + list(extra), "doc_id long, source string, tokens long, slot int, weight int")


def goals(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_are_reached_and_repeats_capped(spark):
    df = docs(spark, {"big_one": (900, 100), "mid": (200, 90), "rare": (10, 80)}, [(9001, None, 50, 1, 2), (9002, "other", 50, 1, 2), (9003, "mid", 0, 1, 2), (9004, "mid", None, 1, 2), (None, "mid", 5, 1, 2)])
    targets = goals(spark, [("big_one", 0.6, 1), ("mid", 0.3, 2), ("rare", 0.1, 4)])
    m = mixture(df, targets, block_tokens=1000).collect()
    total, by = sum(r.tokens for r in m), Counter()
    uses = Counter((r.source, r.doc_id) for r in m)
    for r in m:
        by[r.source] += r.tokens
    assert abs(by["big_one"] / total - 0.6) < 0.01 and abs(by["mid"] / total - 0.3) < 0.01 and abs(by["rare"] / total - 0.1) < 0.01
    assert max(n for (s, _), n in uses.items() if s == "rare") == 4 and max(n for (s, _), n in uses.items() if s == "big_one") == 1 and len({d for s, d in uses if s == "rare"}) == 10
    m.sort(key=lambda r: (r.slot, r.position))
    done, seen = Counter(), 0
    for a, b in zip(m, [*m[1:], None]):
        done[a.source] += a.tokens
        seen += a.tokens
        if b is None or b.slot != a.slot:
            assert all(abs(done[s] - seen * w) < 1000 + 3 * 105 for s, w in (("big_one", 0.6), ("mid", 0.3), ("rare", 0.1)))
    told = {r.source: r for r in report(mixture(df, targets, block_tokens=1000), df, targets).collect()}
    assert told["rare"].most_uses == 4 and told["other"].mixed_tokens == 0 and told[None].documents == 1 and abs(told["mid"].actual_share - by["mid"] / total) < 1e-9


def test_a_larger_total_falls_short_where_a_source_runs_out(spark):
    df, targets = docs(spark, {"a": (100, 100), "b": (5, 100)}), goals(spark, [("a", 0.5, 1), ("b", 0.5, 2)])
    m = mixture(df, targets, total=10_000).collect()
    assert 900 < sum(r.tokens for r in m if r.source == "b") < 1100 and 4500 < sum(r.tokens for r in m if r.source == "a") < 5500
    assert max(Counter(r.doc_id for r in m).values()) == 2


def test_empty_tables_and_missing_sources(spark):
    df, targets = docs(spark, {"a": (10, 10)}), goals(spark, [("a", 0.5, 1), ("gone", 0.5, 1), (None, 0.1, 1), ("zero", 0.0, 1)])
    assert {r.source for r in mixture(df, targets).collect()} == {"a"}
    assert mixture(df.where("false"), targets).count() == 0 and mixture(df, targets.where("false")).count() == 0
    assert {r.actual_share for r in report(mixture(df.where("false"), targets), df, targets).collect()} == {None}


@pytest.mark.parametrize("text,want", [(" Driver  Note ", "driver_note"), ("DRIVER-NOTE", "driver_note"), ("driver_note", "driver_note"), ("  ", None), ("--", None), (None, None)])
def test_spellings(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(canonical_source("s").alias("c")).first().c == want
