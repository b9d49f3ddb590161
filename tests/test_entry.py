"""The registered queries on the smallest tables, and the shared folder."""

import os

import pytest

import __spark_entry__ as entry
from fleetloom.session import forget_staged, fresh_path, staged, unstage

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables here")
def test_queries_are_named_and_have_columns_and_the_flagship_runs(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {f"p{n}_found" for n in range(1, 7)} <= set(queries)
    assert entry.entry(spark).columns[0] == "van_id"
    wanted = {"p1_found": ["van_id", "period_start", "outcome"], "p2_found": ["record_id"], "p3_found": ["van_id", "mid_slot"], "p4_found": ["van_id", "pct"], "p5_found": ["record_id", "zone_id"], "p6_found": ["van_id", "gap_start", "gap_end"]}
    types = {"van_id": "string", "period_start": "bigint", "outcome": "string", "record_id": "bigint", "mid_slot": "bigint", "pct": "bigint", "zone_id": "string", "gap_start": "bigint", "gap_end": "bigint"}
    for name, columns in wanted.items():
        df = queries[name](spark, SMALLEST)
        assert df.dtypes == [(c, types[c]) for c in columns]
        df.count()


def test_staged_tables_are_deleted_on_request(spark):
    df = staged(spark.range(3), "three")
    assert df.count() == 3 and fresh_path(spark, "x") != fresh_path(spark, "x")
    assert forget_staged(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_one_staged_table_is_deleted(spark):
    a, b = staged(spark.range(3), "a"), staged(spark.range(4), "b")
    unstage(a)
    with pytest.raises(Exception):
        spark.read.parquet(a.inputFiles()[0]).count()
    assert b.count() == 4
