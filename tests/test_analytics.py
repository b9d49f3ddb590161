import time

import pytest
from pyspark.sql import functions as F

from fleetloom.plans import analytics as a
from fleetloom.plans.cache import QueryCache

ZONES = [("z1", "De Pijp", "SCHOOL", 0.60, True), ("z2", "Central Station", "TRAFFIC", 0.50, True), ("z3", "Vondelpark", "CONSTRUCTION", 0.40, True), ("z4", "Jordaan", "TRAFFIC", 0.55, True), ("z5", "Old", "TRAFFIC", 0.5, False)]
BREACHES = [("van-a", 60, "WARNING", "z1"), ("van-a", 120, "WARNING", "z1"), ("van-b", 180, "CRITICAL", "z1"), ("van-b", 30, "WARNING", "z2"), ("van-c", 500, "CRITICAL", None)]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(ZONES, "id string, name string, zone_type string, speed_factor double, active boolean")


@pytest.fixture(scope="module")
def breaches(spark):
    return spark.createDataFrame([(*b, "LATE_ARRIVAL") for b in BREACHES], "van_id string, breach_seconds int, severity string, geofence_id string, cause string")


def test_rankings_and_summaries(spark, zones, breaches):
    top = a.top_delay_zones(zones, breaches).collect()
    assert [(r.zone_name, r.breach_count, r.total_breach_seconds, r.avg_breach_seconds) for r in top] == [("De Pijp", 3, 360, 120.0), ("Central Station", 1, 30, 30.0)]
    assert a.top_delay_zones(zones, breaches, 0).count() == 1 and a.clamped(1000) == 100
    s = {r.severity: r for r in a.sla_summary(breaches).collect()}
    assert (s["WARNING"].breach_count, s["WARNING"].avg_breach_seconds, s["WARNING"].max_breach_seconds) == (3, 70.0, 120)
    heat = a.zone_heatmap(zones, breaches).collect()
    assert len(heat) == 4 and {r.zone_name: (r.hit_count, r.avg_delay_seconds) for r in heat}["Vondelpark"] == (0, 0.0)


def test_van_performance(spark):
    rows = [("van-a", 9, 1, "COMPLETED", 24.0, 30.0), ("van-b", 3, 1, "COMPLETED", 20.0, 12.0), ("van-c", 0, 0, "IN_PROGRESS", None, None), ("van-d", 0, 0, "COMPLETED", None, None)]
    df = spark.createDataFrame(rows, "van_id string, completed_stops int, failed_stops int, status string, avg_speed_kmh double, total_distance_km double")
    assert [(r.van_id, r.success_rate_pct, r.avg_speed) for r in a.van_performance(df).collect()] == [("van-a", 90.0, 24.0), ("van-b", 75.0, 20.0), ("van-d", 0.0, None)]


def test_dead_letters_by_reason(spark):
    df = spark.createDataFrame([("LATE_ARRIVAL", True), ("LATE_ARRIVAL", False), ("MALFORMED", False), ("MALFORMED", None)], "error_reason string, reconciled boolean")
    assert {tuple(r) for r in a.dlq_summary(df).collect()} == {("LATE_ARRIVAL", 2, 1, 1), ("MALFORMED", 2, 0, 2)}


def test_live_queries(spark, zones, breaches):
    live = "van_id string, status string, sla_risk string, slack_seconds bigint, eta_seconds bigint, in_zone boolean, zone_name string"
    df = spark.createDataFrame([("van-1", "EN_ROUTE", "WARNING", 40, 5, True, "De Pijp"), ("van-2", "EN_ROUTE", "NONE", 300, 5, True, "Vondelpark"), ("van-3", "EN_ROUTE", "CRITICAL", -20, 5, False, None)], live)
    got = a.live_zone_risk(df, zones, breaches).collect()
    assert [(r.van_id, r.zone_breaches, r.zone_avg_breach_seconds, r.speed_factor) for r in got] == [("van-1", 3, 120.0, 0.6), ("van-2", 0, None, 0.4)]
    df = spark.createDataFrame([("van-a", "EN_ROUTE", "CRITICAL", -30, 5, False, None), ("van-b", "EN_ROUTE", "WARNING", 20, 5, False, None), ("van-z", "EN_ROUTE", "NONE", 400, 5, False, None), ("van-u", "IDLE", "WARNING", None, 5, False, None)], live)
    got = a.at_risk_vans(df, breaches).collect()
    assert [r.van_id for r in got] == ["van-a", "van-b", "van-u"] and (got[0].past_breaches, got[0].past_avg_breach_seconds, got[2].past_breaches) == (2, 90.0, 0)


def test_empty_tables(spark, zones, breaches):
    none = breaches.where("false")
    assert a.top_delay_zones(zones, none).count() == 0 and a.zone_heatmap(zones, none).count() == 4 and a.sla_summary(none).count() == 0


def test_free_sql_and_its_plan(spark, breaches):
    breaches.createOrReplaceTempView("b")
    df = a.run_sql(spark, "SELECT van_id AS VAN, count(*) AS N FROM b WHERE breach_seconds > ? GROUP BY van_id ORDER BY N DESC, VAN FETCH FIRST 1 ROWS ONLY", 50)
    assert [tuple(r) for r in df.collect()] == [("van-a", 2)] and df.columns == ["van", "n"]
    assert "HashAggregate" in a.explain_sql(spark, "SELECT van_id, count(*) FROM b GROUP BY van_id")


def test_ranking_of_200000_breaches_adds_up_before_the_join(spark, zones):
    df = spark.range(200_000).select((F.col("id") % 600).cast("int").alias("breach_seconds"), F.concat(F.lit("z"), F.col("id") % 5 + 1).alias("geofence_id"))
    a.top_delay_zones(zones, df, 5).collect()
    began = time.time()
    assert len(a.top_delay_zones(zones, df, 5).collect()) == 4
    assert time.time() - began < 5
    plan = df._sc._jvm.PythonSQLUtils.explainString(a.top_delay_zones(zones, df, 5)._jdf.queryExecution(), "simple")
    assert "TakeOrderedAndProject" in plan


def test_cache_serves_stale_once_and_runs_once():
    now, runs = [0.0], []

    def run():
        runs.append(now[0])
        return [{"n": len(runs)}]

    c = QueryCache(ttl_s=10, stale_s=60, timeout_s=5, now=lambda: now[0])
    assert c.get("k", run).rows == [{"n": 1}] and c.get("k", run).as_of == 0
    now[0] = 30
    assert c.get("k", run).rows == [{"n": 1}]
    c.close()
    assert c._held["k"].rows == [{"n": 2}] and len(runs) == 2
    c = QueryCache(timeout_s=0.05)
    with pytest.raises(TimeoutError):
        c.get("slow", lambda: time.sleep(0.4) or [])
    c.close()
