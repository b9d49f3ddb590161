"""Stops and trips out of location pings (problem 3).

Pings are looked at in windows of at least five minutes. The movability of a window is the
net displacement over the path travelled; a window of low movability and bounded
extent is part of a stop. Stops are chains of overlapping such windows. Stops at one place
with hardly anything between them are merged before trips are measured.

A busy van's track is cut into spans of time that are worked on apart, each with a margin
of its neighbours' pings, so that every window that touches a span is seen whole. What
comes out of a span are fragments, a few per hour; only they are put in order per van.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.geo import haversine_m
from fleetloom.operators.grouped import whole_groups
from fleetloom.operators.state.eta import haversine
from fleetloom.session import micros

METRES_PER_DEGREE = 111_195.0
FRAGMENT = (
    "van_id string, is_stop boolean, joined boolean, t0 double, t1 double, pings bigint, dist_m double, "
    "lat double, lon double, lat0 double, lon0 double, lat1 double, lon1 double, lead_m double"
)


@dataclass(frozen=True)
class StopRules:
    min_stop_s: float = 300.0
    min_pings: int = 3
    radius_m: float = 60.0
    silence_s: float = 1200.0
    movability: float = 0.6  # at most this share of the path is net displacement
    merge_gap_s: float = 180.0
    clock_ahead_s: float = 120.0  # a ping can't arrive before it was taken
    clock_behind_s: float = 7 * 86_400.0  # older than this on arrival: a wrong clock, not a delay
    fastest_mps: float = 36.0  # a stray that needs more to be reached and left isn't part of the way
    span_s: int = 6 * 3600
    margin_s: int = 2400


def usable_pings(log: DataFrame, rules: StopRules = StopRules()) -> DataFrame:
    """One ping for each van and device time: van_id, us, lat, lon.

    Left out are pings without van, device time or a position on the globe, and those whose
    clock can't be right (``left_out`` counts them). Copies of a ping count once (the first that arrived).
    """
    at, arrived = micros("device_timestamp"), micros("ingestion_timestamp")
    lag = arrived - at
    lat, lon = F.col("location.latitude"), F.col("location.longitude")
    return (
        log.where(F.col("van_id").isNotNull() & at.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180))
        .where(arrived.isNull() | lag.between(int(-rules.clock_ahead_s * 1e6), int(rules.clock_behind_s * 1e6)))
        .groupBy("van_id", at.alias("us"))
        .agg(F.min(F.struct(arrived.isNull().alias("a"), arrived.alias("b"), lat.alias("lat"), lon.alias("lon"))).alias("p"))
        .select("van_id", "us", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    )


def left_out(log: DataFrame, rules: StopRules = StopRules()) -> DataFrame:
    """How many pings ``usable_pings`` doesn't use, by the first reason that applies: reason, pings."""
    at, arrived = micros("device_timestamp"), micros("ingestion_timestamp")
    lat, lon = F.col("location.latitude"), F.col("location.longitude")
    reason = (
        F.when(F.col("van_id").isNull(), "no van").when(at.isNull(), "no device time")
        .when(~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)), "no place on the globe")
        .when(arrived - at < int(-rules.clock_ahead_s * 1e6), "clock ahead").when(arrived - at > int(rules.clock_behind_s * 1e6), "clock behind")
    )
    return log.groupBy(reason.alias("reason")).agg(F.count("*").alias("pings")).where("reason is not null")


def _runs(change: np.ndarray) -> np.ndarray:
    """Starts of runs, given where a row differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], change]))


def _strays(x: np.ndarray, y: np.ndarray, seg: np.ndarray, radius: float) -> np.ndarray:
    """Pings farther than ``radius`` from the median of themselves and two neighbours on each side."""
    n = len(x)
    px, py = np.full((5, n), np.nan), np.full((5, n), np.nan)
    for row, shift in enumerate((-2, -1, 0, 1, 2)):
        to = np.arange(max(0, -shift), min(n, n - shift))
        ok = to[seg[to + shift] == seg[to]]
        px[row, ok], py[row, ok] = x[ok + shift], y[ok + shift]
    enough = np.count_nonzero(~np.isnan(px), axis=0) >= 3
    return enough & (np.hypot(x - np.nanmedian(px, axis=0), y - np.nanmedian(py, axis=0)) > radius)


def _extent(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """max - min of ``values[first..last]``, by tables of maxima over powers of two."""
    n, out = len(values), np.zeros(len(first))
    width = last - first + 1
    level = np.floor(np.log2(width)).astype(int)
    top, low = values.copy(), values.copy()
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            keep = n - (1 << k) + 1
            top, low = np.maximum(top[:keep], top[half : half + keep]), np.minimum(low[:keep], low[half : half + keep])
        at = level == k
        if at.any():
            a, b = first[at], last[at] - (1 << k) + 1
            out[at] = np.maximum(top[a], top[b]) - np.minimum(low[a], low[b])
    return out


def fragments(pings: pd.DataFrame, rules: StopRules) -> pd.DataFrame:
    """Pieces of stops and of movement in the spans of ``pings`` (van_id, span, us, lat, lon; sorted)."""
    t = pings["us"].to_numpy() / 1e6
    lat, lon = pings["lat"].to_numpy(float), pings["lon"].to_numpy(float)
    van, span = pings["van_id"].to_numpy(), pings["span"].to_numpy()
    group_change = (van[1:] != van[:-1]) | (span[1:] != span[:-1])
    starts = _runs(group_change)
    sizes = np.diff(np.append(starts, len(t)))
    middle = np.array([np.median(lat[a : a + n]) for a, n in zip(starts, sizes)])
    x = lon * METRES_PER_DEGREE * np.cos(np.radians(np.repeat(middle, sizes)))
    y = lat * METRES_PER_DEGREE
    group = np.repeat(np.arange(len(starts)), sizes)
    seg = np.concatenate([[0], np.cumsum(group_change | (np.diff(t) > rules.silence_s))])
    good = ~_strays(x, y, seg, rules.radius_m)
    # the way also leads over strays that could have been driven to: at a turn the median cuts the corner
    first = np.concatenate([[True], seg[1:] != seg[:-1]])
    step = np.concatenate([[0.0], haversine(lat[:-1], lon[:-1], lat[1:], lon[1:])])
    pace = np.where(first, np.inf, step / np.maximum(np.diff(t, prepend=t[:1] - 1), 1e-6))
    on_way = np.flatnonzero(good | ((pace <= rules.fastest_mps) & (np.append(pace[1:], np.inf) <= rules.fastest_mps)))
    leg = haversine(lat[on_way[:-1]], lon[on_way[:-1]], lat[on_way[1:]], lon[on_way[1:]])
    way = np.zeros(len(t))
    way[on_way] = np.concatenate([[0.0], np.cumsum(leg)]) if len(on_way) else []
    way = way[good]
    t, x, y, lat, lon, group, span, van = (v[good] for v in (t, x, y, lat, lon, group, span, van))
    if not len(t):
        return pd.DataFrame(columns=[c.split()[0] for c in FRAGMENT.split(", ")])
    apart = (group[1:] != group[:-1]) | (np.diff(t) > rules.silence_s)
    seg = np.concatenate([[0], np.cumsum(apart)])

    # windows: from each ping to the first one at least min_stop_s later, in the same segment
    base = np.zeros(len(t))
    first_of = _runs(apart)
    lengths = np.diff(np.append(first_of, len(t)))
    base = np.repeat(t[first_of], lengths)
    room = rules.silence_s + rules.min_stop_s + 1 + np.append(t[1:] - t[:-1], 0).clip(0)
    reach = np.repeat(np.concatenate([[0], np.cumsum(t[first_of + lengths - 1] - t[first_of] + room.max(initial=1))[:-1]]), lengths)
    clock = t - base + reach  # rises over segments, with room between them
    i = np.arange(len(t))
    j = np.searchsorted(clock, clock + rules.min_stop_s - 1e-6)
    ok = (j < len(t)) & (seg[np.minimum(j, len(t) - 1)] == seg)
    i, j = i[ok], j[ok]
    step = np.hypot(np.diff(x), np.diff(y))
    step[apart] = 0
    path = np.concatenate([[0], np.cumsum(step)])
    travelled, net = path[j] - path[i], np.hypot(x[j] - x[i], y[j] - y[i])
    still = (net <= rules.movability * travelled) | (travelled <= rules.radius_m)
    if len(i):
        still &= np.hypot(_extent(x, i, j), _extent(y, i, j)) / 2 <= rules.radius_m
    covered = np.zeros(len(t) + 1)
    np.add.at(covered, i[still], 1)
    np.add.at(covered, j[still], -1)
    inside = np.cumsum(covered)[:-1] > 0.5  # the step from this ping to the next is part of a stop
    in_stop = inside | np.concatenate([[False], inside[:-1]])

    core = np.floor(t / rules.span_s).astype(np.int64) == span
    cut = apart | (in_stop[1:] != in_stop[:-1]) | (in_stop[1:] & ~inside[:-1]) | (core[1:] != core[:-1])
    starts = _runs(cut)
    ends = np.append(starts[1:], len(t)) - 1
    kept = core[starts]
    starts, ends = starts[kept], ends[kept]
    count = ends - starts + 1
    total = lambda v: np.add.reduceat(np.append(v, 0.0), np.ravel(np.column_stack([starts, ends + 1])))[::2] if len(starts) else np.zeros(0)
    before = np.maximum(starts - 1, 0)
    lead = np.where((starts > 0) & (seg[before] == seg[starts]), way[starts] - way[before], np.nan)
    joined = (starts > 0) & inside[np.maximum(starts - 1, 0)] & (seg[np.maximum(starts - 1, 0)] == seg[starts])
    return pd.DataFrame(
        {
            "van_id": van[starts], "is_stop": in_stop[starts], "joined": joined, "t0": t[starts], "t1": t[ends], "pings": count,
            "dist_m": way[ends] - way[starts], "lat": total(lat) / np.maximum(count, 1), "lon": total(lon) / np.maximum(count, 1),
            "lat0": lat[starts], "lon0": lon[starts], "lat1": lat[ends], "lon1": lon[ends], "lead_m": lead,
        }
    )


def _ordered(pings: DataFrame, rules: StopRules) -> DataFrame:
    """Fragments of all vans, each with the number ``stop`` of the stop it is part of (null: of none)."""
    spans = [F.floor((F.col("us") + d * 1_000_000) / F.lit(rules.span_s * 1_000_000)) for d in (-rules.margin_s, 0, rules.margin_s)]
    spread = pings.withColumn("span", F.explode(F.array_distinct(F.array(*spans)))).repartition("van_id", "span")
    keys = ["van_id", "span"]
    pieces = spread.sortWithinPartitions(*keys, "us").mapInPandas(lambda it: whole_groups(it, keys, lambda p: fragments(p, rules)), FRAGMENT)
    order = Window.partitionBy("van_id").orderBy("t0", "t1")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # pieces of one stop that a border of spans cut
    numbered = pieces.withColumn("piece", F.sum(F.when(F.col("is_stop") & F.col("joined"), 0).otherwise(1)).over(so_far))
    whole = Window.partitionBy("van_id", "piece")
    n = F.sum("pings").over(whole)
    numbered = numbered.select(
        "*",
        (F.col("is_stop") & (n >= rules.min_pings) & (F.max("t1").over(whole) - F.min("t0").over(whole) >= rules.min_stop_s)).alias("long"),
        (F.sum(F.col("lat") * F.col("pings")).over(whole) / n).alias("at_lat"),
        (F.sum(F.col("lon") * F.col("pings")).over(whole) / n).alias("at_lon"),
    )
    # stops at one place with hardly anything between them
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("long"), F.struct("piece", "t1", "at_lat", "at_lon")), ignorenulls=True).over(earlier)
    numbered = numbered.withColumn("last", last)
    near = haversine_m(F.col("last.at_lat"), F.col("last.at_lon"), F.col("at_lat"), F.col("at_lon")) <= rules.radius_m
    same = (F.col("last.piece") == F.col("piece")) | ((F.col("t0") - F.col("last.t1") <= rules.merge_gap_s) & near)
    opens = F.when(F.col("long") & ~F.coalesce(same, F.lit(False)), 1).otherwise(0)
    numbered = numbered.withColumn("upto", F.sum(opens).over(so_far))
    # what lies within a merged stop belongs to it
    stop_end = F.max(F.when(F.col("long"), F.col("t0"))).over(Window.partitionBy("van_id", "upto"))
    return numbered.withColumn("stop", F.when((F.col("upto") > 0) & (F.col("t0") <= stop_end), F.col("upto")))


def stops(log: DataFrame, rules: StopRules = StopRules()) -> DataFrame:
    """Stops of each van: van_id, stop_no, start_s, end_s, duration_s, pings, lat, lon.

    Times are epoch seconds of the first and last ping. A van without a stop has no row.
    """
    return (
        _ordered(usable_pings(log, rules), rules)
        .where("stop is not null and long")
        .groupBy("van_id", F.col("stop").alias("stop_no"))
        .agg(
            F.min("t0").alias("start_s"), F.max("t1").alias("end_s"), (F.max("t1") - F.min("t0")).alias("duration_s"), F.sum("pings").alias("pings"),
            (F.sum(F.col("lat") * F.col("pings")) / F.sum("pings")).alias("lat"), (F.sum(F.col("lon") * F.col("pings")) / F.sum("pings")).alias("lon"),
        )
    )


def trips(log: DataFrame, rules: StopRules = StopRules()) -> DataFrame:
    """Movement between neighbouring stops: van_id, trip_no, start_s, end_s, duration_s, distance_m, pings.

    Trip k leads from the end of stop k to the start of stop k + 1. The distance is along the pings, strays that can't have been
    driven to left out; silences are bridged by a straight line. ``pings`` counts those that aren't strays. Movement before the first and after the last stop is no trip.
    """
    order = Window.partitionBy("van_id").orderBy("t0", "t1")
    pieces = _ordered(usable_pings(log, rules), rules)
    before = F.lag(F.struct("stop", "lat1", "lon1")).over(order)
    pieces = pieces.withColumn("before", before)
    bridge = F.coalesce(F.nanvl("lead_m", F.lit(None)), haversine_m(F.col("before.lat1"), F.col("before.lon1"), F.col("lat0"), F.col("lon0")), F.lit(0.0))
    opens = F.col("stop").isNotNull() & ~F.col("before.stop").eqNullSafe(F.col("stop"))
    moved = (
        pieces.select(
            "van_id",
            F.when(opens, F.col("stop") - 1).otherwise(F.col("upto")).alias("trip_no"),
            F.when(F.col("stop").isNull(), F.col("dist_m") + bridge).when(opens, bridge).otherwise(0.0).alias("m"),
            F.when(F.col("stop").isNull(), F.col("pings")).otherwise(0).alias("pings"),
        )
        .groupBy("van_id", "trip_no")
        .agg(F.sum("m").alias("distance_m"), F.sum("pings").alias("pings"))
    )
    ends = (
        pieces.where("stop is not null").groupBy("van_id", F.col("stop").alias("trip_no")).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    )
    following = Window.partitionBy("van_id").orderBy("trip_no")
    between = ends.select("van_id", "trip_no", F.col("t1").alias("start_s"), F.lead("t0").over(following).alias("end_s")).where("end_s is not null")
    return between.join(moved, ["van_id", "trip_no"]).select(
        "van_id", "trip_no", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "distance_m", "pings"
    )
