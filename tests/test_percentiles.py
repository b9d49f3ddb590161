import random

import numpy as np
import pytest

from fleetloom.operators.percentiles import exact_percentiles


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_percentiles_are_exact_for_ties_few_values_and_hot_keys(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [("hot", rng.choice([float(rng.randrange(50)), rng.lognormvariate(3, 2)])) for _ in range(4000)]
    rows += [("same", 7.0)] * 30 + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, -4.0), ("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "k string, v double, n int").repartition(5)
    got = {r.k: r for r in exact_percentiles(df, "k", "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}, accuracy).collect()}
    by = {}
    for k, v in rows:
        if v is not None and v == v:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, own in by.items():
        assert got[k].n == len(own)
        assert np.allclose([got[k][c] for c in "abcd"], np.quantile(own, [0, 0.5, 0.95, 1]))
    assert exact_percentiles(df.where("false"), "k", "v", {"a": 0.5}).count() == 0
