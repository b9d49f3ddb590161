from pyspark.sql import functions as F

from fleetloom.functions import geo, text, time


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_distances_and_bearings(spark):
    lit = [F.lit(x) for x in (52.379189, 4.899431, 52.373119, 4.891999)]
    d = value(spark, geo.haversine_m(*lit))
    assert 830 < d < 845 and abs(value(spark, geo.haversine_km(*lit)) * 1000 - d) < 1e-9
    assert abs(value(spark, geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 90) < 1e-9
    assert abs(value(spark, geo.bearing_deg(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) - 180) < 1e-9
    assert value(spark, geo.haversine_m(F.lit(None), *lit[1:])) is None


def test_polylines(spark):
    from fleetloom.operators.state.eta import Route

    lats, lons = [52.3 + k * 0.0005 for k in range(9)], [4.85 + 0.0003 * (k % 3) for k in range(9)]
    route = Route(lats, lons)
    line = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in zip(lats, lons)])
    cum = value(spark, geo.cumulative_m(line))
    assert all(abs(a - b) < 1e-6 for a, b in zip(cum, route.cum))
    at = value(spark, geo.locate(line, geo.cumulative_m(line), F.lit(52.3011), F.lit(4.8502), F.lit(0), F.lit(8)))
    off, along = route.locate(52.3011, 4.8502, 0, 8)
    assert abs(at.offset_m - off) < 1e-6 and abs(at.along_m - along) < 1e-6
    one = value(spark, geo.locate(line, geo.cumulative_m(line), F.lit(52.3011), F.lit(4.8502), F.lit(3), F.lit(3)))
    assert one.segment == 3 and abs(one.along_m - cum[3]) < 1e-6
    factors = F.array(*[F.lit(0.5 if k in (2, 3) else 1.0) for k in range(8)])
    t = value(spark, geo.travel_seconds(geo.cumulative_m(line), factors, F.lit(60.0), F.lit(6), F.lit(10.0)))
    route.factor[:] = [0.5 if k in (2, 3) else 1.0 for k in range(8)]
    assert abs(t - route.travel_seconds(60.0, 6, 10.0)) < 1e-6
    assert value(spark, geo.travel_seconds(geo.cumulative_m(line), factors, F.lit(1e9), F.lit(6), F.lit(10.0))) == 0
    assert value(spark, geo.segment_at(geo.cumulative_m(line), F.lit(-5.0))) == 0 and value(spark, geo.segment_at(geo.cumulative_m(line), F.lit(1e9))) == 7
    points = value(spark, geo.densify(F.lit(52.0), F.lit(5.0), F.lit(52.001), F.lit(5.0), 50.0))
    assert len(points) == 4 and points[0] == [52.0, 5.0] and points[-1] == [52.001, 5.0]


def test_rounding_and_classes(spark):
    assert value(spark, time.round_half_up(F.lit(-2.5))) == -2 and value(spark, time.round_km(F.lit(1234.0))) == 1.23 and value(spark, time.round_1(F.lit(6.66))) == 6.7
    assert value(spark, time.floor_seconds(F.expr("timestamp'2024-01-01 00:00:01.5'"), F.expr("timestamp'2024-01-01 00:00:00'"))) == -2
    assert [value(spark, time.slack_class(F.lit(x).cast("int"))) for x in (None, -1, 0, 59, 60)] == ["UNKNOWN", "CRITICAL", "WARNING", "WARNING", "NONE"]
    assert [value(spark, time.freshness(F.lit(x).cast("int"))) for x in (None, 0, 1999, 2000, 10_000)] == ["STALE", "REAL_TIME", "REAL_TIME", "INTERPOLATED", "STALE"]
    assert [value(spark, time.severity(F.lit(x))) for x in (120, 121)] == ["WARNING", "CRITICAL"]
    assert value(spark, time.clamp_int(F.lit(2**40))) == 2**31 - 1
    assert value(spark, time.average_kmh(F.lit(30.0), F.lit(60.0), F.lit(None).cast("double"))) == 30.0
    assert value(spark, time.average_kmh(F.lit(1e6), F.lit(1.0), F.lit(1.0))) == 999.99
    assert value(spark, time.average_kmh(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))) in (None, 999.99)
    assert value(spark, time.free_flow_mps(F.lit(0.0), F.lit(0.5), F.lit(36.0), F.lit(4.0))) == 40.0


def test_labels(spark):
    dash = "—"
    of = lambda f, x: value(spark, f(F.lit(x).cast("int")))
    assert [of(text.eta_label, x) for x in (-1, 0, 9, 65, 600)] == [dash, "At stop", "9s", "1m 05s", "10m 00s"]
    assert [of(text.slack_label, x) for x in (130, 0, -45, -125, None)] == ["+2m 10s", "+0s", "45s late", "2m 05s late", dash]
    assert [of(text.since_label, x) for x in (3, 40, 125)] == ["just now", "40s ago", "2m ago"]
    assert value(spark, text.clock_label(F.lit("2026-11-08T14:05:30Z"))) == "14:05" and value(spark, text.clock_label(F.lit("soon"))) is None
    for before, now, want in [(350.0, 10.0, 370.0), (10.0, 350.0, -10.0), (725.0, 10.0, 730.0), (-350.0, 20.0, -340.0), (90.0, 90.0, 90.0)]:
        assert value(spark, text.unwrapped_heading(F.lit(before), F.lit(now))) == want
    assert value(spark, text.padded_id("van", F.lit(7))) == "van-007"
    assert value(spark, text.client_key(F.lit(" 1.2.3.4 , 5.6.7.8"), F.lit("r"))) == "1.2.3.4" and value(spark, text.client_key(F.lit(None).cast("string"), F.lit("r"))) == "r"
    assert value(spark, text.jdbc_url(F.lit("r2dbc:pool:postgresql://h/d"))) == "jdbc:postgresql://h/d"


def test_payloads_are_json_in_any_case(spark):
    import json

    df = spark.createDataFrame([('{"a": 1}',), ("{broken",), ('say "hi"\\',), ("  ",), ("1 2",), (None,)], "p string")
    got = [r.v for r in df.select(text.json_or_string(F.col("p")).alias("v")).collect()]
    assert got[0] == '{"a": 1}' and got[5] is None
    assert [json.loads(g) for g in got[1:5]] == ["{broken", 'say "hi"\\', "", "1 2"]


def test_areas_and_sql_functions(spark):
    inside = lambda lat, lon: value(spark, geo.in_area(F.lit(lat).cast("double"), F.lit(lon).cast("double"), 52.0, 4.0, 53.0, 5.0))
    assert [inside(*p) for p in [(52.0, 5.0), (51.9, 4.5), (52.5, None)]] == [True, False, False]
    geo.register(spark)
    row = spark.sql("SELECT haversine_m(52.1D, 4.9D, 52.2D, 4.8D) AS m, haversine_km(52.1D, 4.9D, 52.2D, NULL) AS k, bearing_deg(52.1D, 4.9D, 52.2D, 4.8D) AS b").first()
    lit = [F.lit(x) for x in (52.1, 4.9, 52.2, 4.8)]
    assert abs(row.m - value(spark, geo.haversine_m(*lit))) < 1e-6 and row.k is None and abs(row.b - value(spark, geo.bearing_deg(*lit))) < 1e-9
