import json

import numpy as np
import pytest

from fleetloom.functions.geo import in_zone
from fleetloom.operators.geometry import BoxTree, QuadTree, in_polygon, parse_polygons
from fleetloom.operators.spatial import CountTree, _haversine, near_counts, regions_of_points
from fleetloom.sources.zones import parsed_zones, zone_at

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2]]


@pytest.mark.parametrize(
    "text,polygons,rings",
    [
        (json.dumps({"type": "Polygon", "coordinates": [SQUARE, HOLE]}), 1, 2),
        (json.dumps({"type": "Polygon", "coordinates": [SQUARE[:-1]]}), 1, 1),
        (json.dumps({"type": "MultiPolygon", "coordinates": [[SQUARE], [HOLE]]}), 2, 1),
        ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0),(1 1,2 1,2 2,1 2,1 1))", 1, 2),
        ("SRID=4326;multipolygon (((0 0, 4 0, 4 4, 0 4)), ((5 5, 6 5, 6 6)))", 2, 1),
        ("POLYGON Z ((0 0 9, 4 0 9, 4 4 9, 0 0 9))", 1, 1),
    ],
)
def test_readable_geometries(text, polygons, rings):
    found = parse_polygons(text)
    assert len(found) == polygons and len(found[0]) == rings and all((r[0] == r[-1]).all() for p in found for r in p)


@pytest.mark.parametrize("text", [None, "", "{", '{"type":"Polygon","coordinates":[[[6.5,52.7],[6.', '{"type":"Polygon","coordinates":[]}', '{"type":"Point","coordinates":[1,2]}', "POLYGON((0 0, 1 1", "POLYGON EMPTY", "POLYGON((0 0, 1 1))", "nonsense", "POLYGON((a b, c d, e f))", "{}", "[]"])
def test_unreadable_geometries(text):
    assert parse_polygons(text) is None


def shapes(rng, n):
    out = []
    for k in range(n):
        cx, cy, r = rng.uniform(6, 7), rng.uniform(52, 53), rng.uniform(0.005, 0.2)
        a = np.sort(rng.uniform(0, 2 * np.pi, 9))
        ring = [[cx + r * np.cos(t), cy + r * np.sin(t)] for t in a]
        hole = [[cx + r / 5 * np.cos(t), cy + r / 5 * np.sin(t)] for t in a]
        out.append((f"z{k}", json.dumps({"type": "MultiPolygon", "coordinates": [[ring, hole], [ring]]} if k % 5 == 0 else {"type": "Polygon", "coordinates": [ring, hole]})))
    return out


@pytest.mark.parametrize("size", [8_000_000, 0])
def test_both_ways_against_every_pair(spark, size):
    rng = np.random.default_rng(1)
    zones = shapes(rng, 40) + [("broken", "POLYGON(("), ("null", None), (None, shapes(rng, 1)[0][1])]
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform([5.9, 51.9], [7.1, 53.1], (2000, 2)))]
    points += [(5000 + k, 6.5, 52.5) for k in range(900)]  # a third of all at one place
    extra = [(None, 6.5, 52.5), (9001, None, 52.5), (9002, float("nan"), 52.5), (9003, 500.0, 52.5)]
    p = spark.createDataFrame([(*r, 1) for r in points + extra], "pid long, lon double, lat double, leaf int")
    z = spark.createDataFrame(zones, "name string, salt string")
    got = [(r.pid, r.name) for r in regions_of_points(p, z, point_id="pid", x="lon", y="lat", region_id="name", geometry="salt", broadcast_bytes=size).collect()]
    x, y = np.array([r[1] for r in points]), np.array([r[2] for r in points])
    want = {(points[k][0], i) for i, t in zones if i and (ps := parse_polygons(t)) for k in np.flatnonzero(np.any([in_polygon(x, y, rings) for rings in ps], axis=0))}
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_tables(spark):
    p, z = spark.createDataFrame([], "id long, x double, y double"), spark.createDataFrame([], "zone string, g string")
    for size in (0, 10):
        assert regions_of_points(p, z, point_id="id", x="x", y="y", region_id="zone", geometry="g", broadcast_bytes=size).count() == 0
    assert near_counts(p, point_id="id", x="x", y="y", metres=10).count() == 0


def test_near_points_against_every_pair(spark):
    rng = np.random.default_rng(2)
    at = rng.normal([5, 52], [0.01, 0.01], (600, 2))
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(at)] + [(700 + k, 5.0, 52.0) for k in range(300)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + [(None, 5.0, 52.0), (5, None, 1.0)]], "id long, x double, y double, n int, leaf int")
    got = {r.id: (r.near, None if r.nearest_m is None else round(r.nearest_m, 6)) for r in near_counts(df, point_id="id", x="x", y="y", metres=120).collect()}
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        d = np.delete(_haversine(y[k], x[k], y, x), k)
        d = d[d <= 120]
        assert got[r[0]] == (len(d), round(float(d.min()), 6) if len(d) else None)


def test_trees_find_every_box_and_leaf():
    rng = np.random.default_rng(3)
    low = rng.uniform(0, 10, (500, 2))
    boxes = np.hstack([low, low + rng.uniform(0, 1, (500, 2))])
    x, y = rng.uniform(0, 11, 300), rng.uniform(0, 11, 300)
    got = set(zip(*map(list, BoxTree(boxes).probe(x, y))))
    assert got == {(i, j) for i in range(300) for j in range(500) if boxes[j, 0] <= x[i] <= boxes[j, 2] and boxes[j, 1] <= y[i] <= boxes[j, 3]}
    tree = QuadTree.build(x, y, 10)
    b = tree.boxes[tree.leaf(x, y)]
    assert ((b[:, 0] <= x) & (x <= b[:, 2]) & (b[:, 1] <= y) & (y <= b[:, 3])).all() and np.bincount(tree.leaf(x, y)).max() <= 10
    assert abs(((tree.boxes[:, 2] - tree.boxes[:, 0]) * (tree.boxes[:, 3] - tree.boxes[:, 1])).sum() - 360 * 180) < 1e-6


def test_containment_as_a_column_is_the_same(spark):
    rng = np.random.default_rng(4)
    zones = spark.createDataFrame([(i, f"n{i}", "T", 0.5, t) for i, t in shapes(rng, 12)], "id string, name string, zone_type string, speed_factor double, geometry string")
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform([6, 52], [7, 53], (300, 2)))]
    p = spark.createDataFrame(points, "k long, x double, y double")
    parsed = parsed_zones(zones)
    from pyspark.sql import functions as F

    got = {(r.k, r.id) for r in p.join(F.broadcast(parsed)).where(in_zone(F.col("polygons"), F.col("x"), F.col("y"))).select("k", "id").collect()}
    want = {(r.k, r.id) for r in regions_of_points(p, zones, point_id="k", x="x", y="y", region_id="id", geometry="geometry").collect()}
    assert got == want and want
    first = {r.k: r.zone_name for r in zone_at(p, parsed, "x", "y").collect()}
    assert all(first[k] == min((f"n{i}" for q, i in want if q == k), default=None) for k, _, _ in points)


def test_near_points_over_the_meridian_the_poles_and_in_a_dense_spot(spark):
    rng = np.random.default_rng(6)
    at = [(180 - 0.0005, 10.0), (-180 + 0.0005, 10.0), (180.0, 10.0), (-180.0, 10.0), (0.0, 89.9999), (180.0, 89.9999), (90.0, 90.0), (-90.0, 89.9995), (3.0, -89.9998), (-120.0, -89.9998)]
    at += [tuple(map(float, p)) for p in rng.normal([5, 52], [0.0002, 0.0002], (3000, 2))] + [(7.0, 50.0)] * 5
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "id long, x double, y double").repartition(3)
    got = {r.id: (r.near, None if r.nearest_m is None else round(r.nearest_m, 5)) for r in near_counts(df, point_id="id", x="x", y="y", metres=120).collect()}
    x, y = np.array([p[0] for p in at]), np.array([p[1] for p in at])
    assert len(got) == len(at)
    for k in [*range(10), *range(10, 3010, 50), 3011]:
        same = (x == x[k]) & (y == y[k])
        d = np.where(same, 0.0, _haversine(y[k], x[k], y, x))
        d = np.delete(d, k)
        d = d[d <= 120]
        other = d[d > 0] if not (same.sum() > 1) else d
        assert got[k][0] == len(d), k
        assert got[k][1] == (round(float(other.min()), 5) if len(other) else None), k


def test_a_count_tree_of_one_place_and_of_many():
    rng = np.random.default_rng(9)
    for n in (1, 16, 17, 1000):
        x, y, w = rng.normal(5, 0.01, n), rng.normal(52, 0.01, n), rng.integers(1, 4, n)
        qx, qy = rng.normal(5, 0.01, 50), rng.normal(52, 0.01, 50)
        near, nearest = CountTree(x, y, w).around(qx, qy, 300.0, at_once=7)
        d = _haversine(qy[:, None], qx[:, None], y[None], x[None])
        assert (near == np.where(d <= 300, w[None], 0).sum(axis=1)).all()
        assert np.allclose(nearest, np.where(d <= 300, d, np.inf).min(axis=1))
