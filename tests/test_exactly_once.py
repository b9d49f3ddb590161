import random

import pytest

from fleetloom.operators.components import connected_components
from fleetloom.operators.exactly_once import advance_ranges, duplicates, exactly_once, message_rows, seen_ranges

LOG = "record_id bigint, batch_id bigint, event_id string, van_id string, sequence_number bigint, device_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz"
A, B, C = (f"{k * 8}-0000-4000-8000-{k * 12}" for k in "abc")


def ts(n):
    from datetime import datetime, timedelta

    return None if n is None else datetime(2024, 1, 1) + timedelta(seconds=n)


def table(spark, rows, schema=LOG):
    return spark.createDataFrame([(*r[:5], ts(r[5]), ts(r[6]), *r[7:]) for r in rows], schema)


def found(df, **kw):
    return {(r.record_id, r.kept_id) for r in duplicates(df, **kw).collect()}


def test_ids_written_differently_and_ids_that_denote_nothing(spark):
    rows = [
        (1, 1, A, "v", 1, 1, 10), (2, 1, A.upper(), "w", 2, 2, 11), (3, 1, "{" + A + "}", "w", 3, 3, 12), (4, 2, " urn:uuid:" + A, "w", 4, 4, 13), (5, 2, A.replace("-", ""), "w", 5, 5, 9),
        (6, 2, "0" * 8 + "-0000-0000-0000-" + "0" * 12, "x", 1, 1, 1), (7, 2, "0" * 32, "x", 2, 1, 1), (8, 2, "n/a", "x", 3, 1, 1), (9, 2, "n/a", "x", 4, 1, 1), (10, 2, None, "x", 5, 1, 1), (11, 2, "", "x", 6, 1, 1), (12, 2, "", "x", 7, 1, 1),
    ]
    assert found(table(spark, rows)) == {(1, 5), (2, 5), (3, 5), (4, 5)}


def test_chains_nulls_ties_and_reused_numbers(spark):
    rows = [
        (1, 1, A, "v", 7, 100, 50), (2, 1, B, "v", 7, 100, 40), (3, 2, B, None, None, None, 60), (4, 3, C, "v", 7, 100, None), (5, 3, C, None, 7, 100, None),
        (6, 3, None, "v", 7, 200, 70), (7, 3, None, "v", 7, 200, 70), (8, 3, None, None, 7, 200, 1), (9, 3, None, "v", None, 200, 1), (10, 3, None, "v", None, 200, 1),
    ]
    assert found(table(spark, rows)) == {(1, 2), (3, 2), (4, 2), (5, 2), (7, 6)}


def test_empty_log_and_rows_without_record_id(spark):
    assert found(spark.createDataFrame([], LOG)) == set()
    kept = exactly_once(table(spark, [(None, 1, A, "v", 1, 1, 1), (2, None, A, "v", 1, 1, 1)]))
    assert [r.record_id for r in kept.collect()] == [2]


def test_columns_with_clashing_names_are_kept(spark):
    df = table(spark, [(1, 1, A, "v", 1, 1, 1, "x", 2, "y"), (2, 1, A, "v", 1, 1, 2, "x", 2, "y")], LOG + ", node string, seq int, uuid string")
    assert [tuple(r) for r in exactly_once(df).select("record_id", "node", "seq", "uuid").collect()] == [(1, "x", 2, "y")]


def brute(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for r in rows:
        node = (r[6] if r[6] is not None else 10**9, r[0])
        parent[node] = node
        keys = ([("u", r[2])] if r[2] else []) + ([r[3:6]] if None not in r[3:6] else [])
        for k in keys:
            a, b = find(node), find(first.setdefault(k, node))
            parent[max(a, b)] = min(a, b)
    return {(n[1], find(n)[1]) for n in parent if find(n) != n}


@pytest.mark.parametrize("seed,rounds", [(1, 1), (2, 3), (3, 5)])
def test_random_logs_against_union_find(spark, seed, rounds):
    rng = random.Random(seed)
    ids = [f"{k:08x}-0000-4000-8000-000000000000" for k in range(1, 60)]
    rows = [
        (k, rng.choice([None, *range(9)]), rng.choice([None, *ids]), rng.choice([None, "v", "w"]), rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3]), rng.choice([None, *range(50)]))
        for k in range(300)
    ]
    assert found(table(spark, rows), rounds=rounds) == brute(rows)


def test_a_group_of_a_third_of_all_rows_and_a_long_chain(spark):
    rows = [(k, k % 5, A, "v", 0, k, k) for k in range(400)]
    ids = [f"{k:08x}-1111-4000-8000-000000000000" for k in range(200)]
    rows += [(1000 + 2 * k, 1, ids[k], "w", k, 1, 1000 + k) for k in range(200)] + [(1001 + 2 * k, 1, ids[k + 1], "w", k, 1, 2000 + k) for k in range(199)]
    assert found(table(spark, rows)) == brute(rows)


def test_ranges_merge_and_suspects_are_numbers_seen_before(spark):
    df = table(spark, [(k, 1, None, "v", n, n, k) for k, n in enumerate([5, 3, 4, 9, 9, 70_000, -1])])
    one = advance_ranges(message_rows(df), None)
    assert sorted((r.lo, r.hi, *r.suspects) for r in one.collect()) == [(-1, -1), (3, 5), (9, 9, 9), (70_000, 70_000)]
    more = table(spark, [(k, 2, None, "v", n, n, k) for k, n in enumerate([6, 4, 8, 7])])
    assert sorted((r.lo, r.hi, *r.suspects) for r in advance_ranges(message_rows(more), one).collect()) == [(-1, -1), (3, 9, 4), (70_000, 70_000)]


def test_ranges_do_not_depend_on_how_batches_are_grouped(spark):
    rng = random.Random(5)
    df = message_rows(table(spark, [(k, k // 20, None, rng.choice("vw"), rng.randrange(80), k, k) for k in range(200)]))
    end = lambda n: sorted((r.van_id, r.lo, r.hi) for r in seen_ranges(df, n)[-1].collect())
    assert end(1) == end(4)


def test_components_of_a_path_a_loop_and_nulls(spark):
    edges = [(k, k + 1) for k in range(40)] + [(7, 7), (None, 3), (100, 102), (102, 101), (100, 101)]
    got = {(r.a, r.b) for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {(k, 0) for k in range(1, 41)} | {(101, 100), (102, 100)}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_batches_of_a_stream_keep_what_the_whole_log_keeps(spark):
    from fleetloom.session import fresh_path
    from fleetloom.streaming.messages import MessageStore

    rng, rows = random.Random(9), []
    for k in range(120):
        uid, van, at = f"{k + 1:08x}-2222-4000-8000-000000000000", rng.choice("vw"), 10 * k
        first = (len(rows), None, uid, van, k // 3, at, at)
        rows.append(first)
        for _ in range(rng.choice([0, 0, 1, 2])):  # copies lack one of the two identifiers, or neither
            lost = rng.choice(["id", "number", "none"])
            rows.append((len(rows), None, None if lost == "id" else uid.upper(), None if lost == "number" else van, k // 3, at, at + rng.choice([0, 5, 300, 900])))
    rows = sorted(rows, key=lambda r: (r[6], r[0]))
    rows = [(*r[:1], n // 70, *r[2:]) for n, r in enumerate(rows)]
    log = table(spark, rows)
    store = MessageStore(spark, fresh_path(spark, "messages"), LOG)
    for b in (0, 1, 1, 2, 3, 4):
        store.take(log.where(f"batch_id = {b}"), b)
    want = {r[0] for r in rows} - {a for a, _ in brute([(*r[:2], r[2] and r[2].lower(), *r[3:]) for r in rows])}
    assert {r.record_id for r in store.messages.read().collect()} == want and store.messages.read().count() == len(want)
    assert {(r.van_id, r.lo, r.hi) for r in store.ranges.read().collect()} == {(r.van_id, r.lo, r.hi) for r in seen_ranges(message_rows(log), 1)[-1].collect()}
