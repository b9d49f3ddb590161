"""Distances, bearings, polygons and polylines as column expressions; none of them leaves the JVM.

Points of rings are structs ``x`` (longitude) and ``y`` (latitude); points of a polyline are arrays
``[lat, lon]``, as route plans carry them. A null argument gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean radius of the Earth in metres.
EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if any coordinate is null."""
    up = F.sin(F.radians(lat2 - lat1) / 2)
    across = F.sin(F.radians(lon2 - lon1) / 2)
    h = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    turn = F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """The value a part ``t`` of the way from a to b."""
    return a + (b - a) * t


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    of = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(F.least(value, of(high)), of(low))


def densify(lat1: Column, lon1: Column, lat2: Column, lon2: Column, step_m: float = 50.0) -> Column:
    """Points ``[lat, lon]`` on the straight line, no more than ``step_m`` apart, ends included."""
    n = F.greatest(F.lit(1), F.ceil(haversine_m(lat1, lon1, lat2, lon2) / step_m)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.array(lerp(lat1, lat2, i / n), lerp(lon1, lon2, i / n)))


def segment_lengths(line: Column) -> Column:
    """Lengths in metres of the segments of a polyline; empty for fewer than two points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda p: haversine_m(p["a"][0], p["a"][1], p["b"][0], p["b"][1]))


def cumulative_m(line: Column) -> Column:
    """Distance from the start at each vertex of a polyline, starting with 0."""
    def longer(done: Column, length: Column) -> Column:
        return F.concat(done, F.array(F.element_at(done, -1) + length))

    return F.aggregate(segment_lengths(line), F.array(F.lit(0.0)), longer)


def segment_at(cumulative: Column, distance: Column) -> Column:
    """Number from 0 of the segment that holds a distance: the last vertex at or before it, within the line."""
    found = F.size(F.filter(cumulative, lambda c: c <= distance)) - 1
    return clamp(found, 0, F.greatest(F.size(cumulative) - 2, F.lit(0)))


def travel_seconds(cumulative: Column, factors: Column, start: Column, to_vertex: Column, speed: Column) -> Column:
    """Time over a polyline from a distance to a vertex, each segment at speed times its factor.

    0 if the vertex is behind, or the speed isn't positive.
    """
    steps = F.sequence(F.lit(0), F.greatest(F.size(cumulative) - 2, F.lit(0)))
    end = F.get(cumulative, to_vertex)

    def part(i: Column) -> Column:
        low, high = F.greatest(F.get(cumulative, i), start), F.least(F.get(cumulative, i + 1), end)
        return F.greatest(high - low, F.lit(0.0)) / (speed * F.get(factors, i))

    total = F.aggregate(F.transform(steps, part), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return F.when((speed > 0) & (end > start), total).otherwise(0.0)


def locate(line: Column, cumulative: Column, lat: Column, lon: Column, first: Column, last: Column) -> Column:
    """The nearest point of a polyline between two vertices: a struct of offset_m, along_m and segment.

    Segments are flat around the point. Of equally near segments the first counts. If the leg has no
    segment, its first vertex is the nearest point.
    """
    # Fixed value: metres in a degree of latitude on the sphere.
    degree = F.lit(EARTH_RADIUS_M) * F.radians(F.lit(1.0))
    shrink = F.cos(F.radians(lat))

    def near(i: Column) -> Column:
        ax, ay = (F.get(line, i)[1] - lon) * degree * shrink, (F.get(line, i)[0] - lat) * degree
        bx, by = (F.get(line, i + 1)[1] - lon) * degree * shrink, (F.get(line, i + 1)[0] - lat) * degree
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        t = F.when(square > 0, clamp(-(ax * dx + ay * dy) / square, 0.0, 1.0)).otherwise(0.0)
        off = F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))
        along = F.get(cumulative, i) + t * (F.get(cumulative, i + 1) - F.get(cumulative, i))
        return F.struct(off.alias("offset_m"), i.alias("segment"), along.alias("along_m"))

    at_first = F.struct(haversine_m(F.get(line, first)[0], F.get(line, first)[1], lat, lon).alias("offset_m"), first.alias("segment"), F.get(cumulative, first).alias("along_m"))
    return F.when(last > first, F.array_min(F.transform(F.sequence(first, F.greatest(last - 1, first)), near))).otherwise(at_first)


def ring_box(ring: Column) -> Column:
    """Bounding box of a ring: a struct of min_x, min_y, max_x, max_y."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule, half open; the ring may be open or closed."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        split = (a["y"] > y) != (b["y"] > y)
        return F.when(split & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    crossings = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, c: s + c)
    return F.when(n >= 3, crossings % 2 == 1).otherwise(False)


def in_zone(polygons: Column, x: Column, y: Column) -> Column:
    """In any polygon's outer ring, within its bounding box, and in none of its holes.

    ``polygons`` is an array of polygons, each an array of rings, the outer one first.
    """
    def inside(polygon: Column) -> Column:
        outer = F.get(polygon, F.lit(0))
        box = ring_box(outer)
        boxed = x.between(box["min_x"], box["max_x"]) & y.between(box["min_y"], box["max_y"])
        holes = F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0)))
        return boxed & in_ring(outer, x, y) & ~F.exists(holes, lambda h: in_ring(h, x, y))

    return F.exists(polygons, inside)


def speed_factor(factor: Column) -> Column:
    """A zone's speed factor; 1 where there is no zone."""
    return F.coalesce(factor.cast("double"), F.lit(1.0))


def in_area(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Within a box, its edges included; null coordinates aren't."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def register(spark) -> None:
    """The distances as SQL functions: haversine_m and haversine_km of (lat1, lon1, lat2, lon2), and bearing_deg.

    They are expressions that the optimizer sees through, not calls into Python.
    """
    h = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
    metres = f"{2 * EARTH_RADIUS_M} * asin(sqrt(CASE WHEN {h} > 1 THEN 1 ELSE {h} END))"
    north = "cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))"
    bearing = f"pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), {north})) + 360, 360D)"
    for name, body in (("haversine_m", metres), ("haversine_km", f"({metres}) / 1000"), ("bearing_deg", bearing)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN {body}")
