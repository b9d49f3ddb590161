import random

import numpy as np
import pytest

from fleetloom.llm.packing import linear_groups, pack, patterns, pieces


def packed(spark, sizes, capacity, **kw):
    df = spark.createDataFrame([(k, n, 1, "x") for k, n in enumerate(sizes)], "doc_id long, tokens long, start int, room string")
    return pack(df, "doc_id", "tokens", capacity, **kw).collect()


def check(rows, sizes, capacity):
    """Every item whole and once, no container over its capacity; the number of containers."""
    by_item, by_box = {}, {}
    for r in rows:
        by_item.setdefault(r.doc_id, []).append((r.start, r.n))
        by_box[r.container_id] = by_box.get(r.container_id, 0) + r.n
    for k, n in enumerate(sizes):
        own = sorted(by_item.get(k, []))
        assert sum(x for _, x in own) == (n or 0)
        assert all(a + x == b for (a, x), (b, _) in zip(own, own[1:])) and len(own) == -(-(n or 0) // capacity)
    assert max(by_box.values(), default=0) <= capacity
    return len(by_box)


@pytest.mark.parametrize("seed,spread", [(1, "uniform"), (2, "small"), (3, "large"), (4, "mixed")])
def test_random_sizes_come_close_to_the_least_possible(spark, seed, spread):
    rng = random.Random(seed)
    draw = {"uniform": lambda: rng.randint(1, 200), "small": lambda: rng.randint(1, 20), "large": lambda: rng.randint(60, 200), "mixed": lambda: rng.choice([3, 30, 70, 101, 199, 200, 450, 999])}[spread]
    sizes = [draw() for _ in range(3000)] + [None, 0]
    n = check(packed(spark, sizes, 200), sizes, 200)
    order = sorted((x for s in sizes if s for x in [200] * (s // 200) + [s % 200] * (s % 200 > 0)), reverse=True)
    boxes = []
    for x in order:  # first fit decreasing
        for b in range(len(boxes)):
            if boxes[b] >= x:
                boxes[b] -= x
                break
        else:
            boxes.append(200 - x)
    assert n <= len(boxes) * 1.03 + 4


def test_corner_cases(spark):
    assert packed(spark, [], 100) == []
    assert packed(spark, [None, 0], 100) == []
    assert check(packed(spark, [100] * 7, 100), [100] * 7, 100) == 7
    assert check(packed(spark, [250], 100), [250], 100) == 3
    assert check(packed(spark, [1] * 1000, 100), [1] * 1000, 100) == 10
    assert check(packed(spark, [50] * 1001, 100), [50] * 1001, 100) == 501


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([("a", 60), ("a", 60), ("b", 40), (None, 10)], "k string, n long")
    rows = pack(df, "k", "n", 100).collect()
    assert sorted((r.k, r.n) for r in rows) == [("a", 60), ("a", 60), ("b", 40)]
    assert pieces(df, "k", "n", 50).count() == 5


def test_configurations_meet_demand_and_are_near_optimal():
    sizes, demand = [55, 45, 34, 33], [10, 10, 20, 20]
    plan = patterns(sizes, demand, 100)
    for k in range(4):
        assert sum(c[k] * n for c, n in plan) >= demand[k]
    assert all(sum(s * c for s, c in zip(sizes, counts)) <= 100 for counts, _ in plan)
    assert sum(n for _, n in plan) <= 24 + len(sizes)  # rounding costs at most one container a size
    assert patterns([], [], 100) == []


def test_groups_hold_equally_many():
    rng = np.random.default_rng(1)
    values, counts = np.unique(rng.integers(1, 500, 10_000), return_counts=True)
    groups = linear_groups([(int(v), int(c)) for v, c in zip(values, counts)], 20)
    assert len(groups) <= 20 and sum(g[2] for g in groups) == 10_000 and max(g[2] for g in groups) < 700
    assert all(a[1] < b[0] for a, b in zip(groups, groups[1:])) and linear_groups([], 5) == []
