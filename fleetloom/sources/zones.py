"""Zones as nested arrays, so that containment is a column expression."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetloom.functions.geo import in_zone
from fleetloom.operators.geometry import parse_polygons

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"


def parsed_zones(zones: DataFrame, id: str = "id", geometry: str = "geometry") -> DataFrame:
    """``zones`` with ``polygons`` for its geometry; null where it can't be read."""
    rest = [c for c in zones.columns if c != geometry]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [parse_polygons(t) for t in f[geometry]]
            yield f[rest].assign(polygons=[None if p is None else [[[{"x": x, "y": y} for x, y in ring.tolist()] for ring in rings] for rings in p] for p in found])

    schema = StructType([*zones.select(*rest).schema, *StructType.fromDDL(f"polygons {POLYGONS}")])
    return zones.mapInPandas(parse, schema)


def active_zones(zones: DataFrame) -> DataFrame:
    """Readable active zones, by name."""
    return parsed_zones(zones.where("active").select("id", "name", "zone_type", "speed_factor", "geometry")).where("polygons is not null").orderBy("name", "id")


def zone_at(points: DataFrame, zones: DataFrame, lon: str, lat: str, most_zones: int = 2000) -> DataFrame:
    """``points`` with zone_id, zone_name and speed_factor of the first zone by name that holds them; null and 1 outside all.

    Up to ``most_zones`` zones travel with the plan as one literal-like row. More are met by cells of their own size, each place once;
    the result is the same. A place that is null or not a number is in no zone.
    """
    sized = zones.select("name", "id", F.col("speed_factor").cast("double").alias("factor"), "polygons")
    if zones.count() > most_zones:
        return _zone_by_cell(points, sized, lon, lat)
    listed = sized.agg(F.array_sort(F.collect_list(F.struct("name", "id", "factor", "polygons"))).alias("_zones"))
    joined = points.join(F.broadcast(listed))
    hit = F.get(F.filter("_zones", lambda z: in_zone(z["polygons"], F.col(lon), F.col(lat))), F.lit(0))
    return joined.withColumn("_hit", hit).withColumn("zone_id", F.col("_hit.id")).withColumn("zone_name", F.col("_hit.name")).withColumn("speed_factor", F.coalesce("_hit.factor", F.lit(1.0))).drop("_hit", "_zones")


def _zone_by_cell(points: DataFrame, zones: DataFrame, lon: str, lat: str) -> DataFrame:
    """``zone_at`` for any number of zones: a zone lies in at most four cells of the grid that its size asks for."""
    outer = F.flatten(F.transform("polygons", lambda rings: F.get(rings, F.lit(0))))
    edge = lambda pick, c: pick(F.transform(outer, lambda p: p[c]))
    boxes = zones.withColumns({"_w": edge(F.array_min, "x"), "_e": edge(F.array_max, "x"), "_s": edge(F.array_min, "y"), "_n": edge(F.array_max, "y")})
    wide = F.greatest(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s"), F.lit(1e-6))
    boxes = boxes.where("_w is not null").withColumn("_level", F.ceil(F.log2(wide)).cast("int"))
    levels = [r[0] for r in boxes.select("_level").distinct().collect()]  # powers of two between a metre and the world: some thirty
    cell = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level))
    across = F.sequence(cell(F.col("_w"), F.col("_level")), cell(F.col("_e"), F.col("_level")))
    up = F.sequence(cell(F.col("_s"), F.col("_level")), cell(F.col("_n"), F.col("_level")))
    cells = boxes.select("name", "id", "factor", "polygons", "_level", F.explode(across).alias("_cx"), up.alias("_up")).withColumn("_cy", F.explode("_up")).drop("_up")
    places = points.select(F.col(lon).alias("_x"), F.col(lat).alias("_y")).where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)").distinct()
    asked = places.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    asked = asked.withColumns({"_cx": cell(F.col("_x"), F.col("_level")), "_cy": cell(F.col("_y"), F.col("_level"))})
    held = asked.join(cells, ["_level", "_cx", "_cy"]).where(in_zone(F.col("polygons"), F.col("_x"), F.col("_y")))
    first = held.groupBy("_x", "_y").agg(F.min(F.struct("name", "id", "factor")).alias("_hit"))
    joined = points.join(first, (points[lon] == first["_x"]) & (points[lat] == first["_y"]), "left").drop("_x", "_y")
    return joined.withColumn("zone_id", F.col("_hit.id")).withColumn("zone_name", F.col("_hit.name")).withColumn("speed_factor", F.coalesce("_hit.factor", F.lit(1.0))).drop("_hit")


def segment_factors(routes: DataFrame, zones: DataFrame, id: str = "route_id", line: str = "waypoints") -> DataFrame:
    """The speed factor of each segment of polylines, by the zone that holds its middle: id, factors.

    ``line`` is an array of ``[lat, lon]``. A line of fewer than two points has no row. A route's segments
    are gathered to one array, as long as the route itself.
    """
    mid = lambda k: (F.col("a")[k] + F.col("b")[k]) / 2
    n = F.greatest(F.size(line) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    parts = routes.select(F.col(id).alias("route"), F.posexplode(pairs).alias("pos", "pair")).select("route", "pos", "pair.a", "pair.b")
    placed = zone_at(parts.select("route", "pos", mid(0).alias("lat"), mid(1).alias("lon")), zones, "lon", "lat")
    listed = placed.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "speed_factor"))).alias("l"))
    return listed.select(F.col("route").alias(id), F.transform("l", lambda s: s["speed_factor"]).alias("factors"))
