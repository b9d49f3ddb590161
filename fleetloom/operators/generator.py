"""Seeded fleets for tests: routes, motion along them, and what a mobile network does to the pings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.operators.state.eta import Route, haversine


def leg_ends(line: Route, metres: np.ndarray, points: np.ndarray, snap: int = 15) -> np.ndarray:
    """Vertices where the legs of a routed line end: by length, then the nearest vertex to the stop within ``snap``; rising."""
    out, low = [], 0
    for end, (lat, lon) in zip(np.cumsum(metres), points):
        k = int(np.clip(np.searchsorted(line.cum, end), 0, len(line.cum) - 1))
        a, b = max(low, k - snap), max(low, min(len(line.cum) - 1, k + snap))
        near = np.arange(a, b + 1)
        low = int(near[haversine(line.lat[near], line.lon[near], lat, lon).argmin()])
        out.append(low)
    return np.array(out)


def with_stop(line: Route, vertices: np.ndarray, along_m: float, k: int, lat: float, lon: float) -> tuple[Route, np.ndarray]:
    """A route with a stop put in before stop ``k``: what is driven already stays, the rest leads on from there.

    Stops before ``k`` keep their place, so the way never turns back to them.
    """
    done = int(np.searchsorted(line.cum, along_m, side="right"))
    keep = max(done, int(vertices[k - 1]) + 1 if k else 0)
    rest = vertices[k:]
    at = np.vstack([[line.lat[keep - 1], line.lon[keep - 1]], [lat, lon], np.column_stack([line.lat[rest], line.lon[rest]]), [line.lat[-1], line.lon[-1]]])
    new_lat, new_lon, new = straight_route(at[:, 0], at[:, 1])
    whole = Route(np.concatenate([line.lat[:keep], new_lat[1:]]), np.concatenate([line.lon[:keep], new_lon[1:]]))
    return whole, np.concatenate([vertices[:k], keep - 1 + new[1:-1]])


@dataclass(frozen=True)
class Network:
    """What the link does to pings: copies, jitter, a slow path, dead zones with a backlog."""

    copies: float = 0.05
    most_copies: int = 2
    jitter_s: float = 0.4
    slow: float = 0.05
    slow_s: float = 8.0
    dead: float = 0.01
    dead_s: float = 45.0


def nearest_first(lat: np.ndarray, lon: np.ndarray, start: tuple[float, float]) -> np.ndarray:
    """An order of stops: from each the nearest of the rest."""
    left, at, out = list(range(len(lat))), start, []
    while left:
        d = haversine(np.array([lat[k] for k in left]), np.array([lon[k] for k in left]), *at)
        k = left.pop(int(d.argmin()))
        out.append(k)
        at = lat[k], lon[k]
    return np.array(out, int)


def straight_route(lat: np.ndarray, lon: np.ndarray, step_m: float = 50.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A line through points with vertices at most ``step_m`` apart, and the vertex of each point."""
    lats, lons, vertices = [lat[:1]], [lon[:1]], [0]
    for k in range(1, len(lat)):
        n = max(1, int(np.ceil(haversine(lat[k - 1], lon[k - 1], lat[k], lon[k]) / step_m)))
        t = np.arange(1, n + 1) / n
        lats.append(lat[k - 1] + (lat[k] - lat[k - 1]) * t)
        lons.append(lon[k - 1] + (lon[k] - lon[k - 1]) * t)
        vertices.append(vertices[-1] + n)
    return np.concatenate(lats), np.concatenate(lons), np.array(vertices)


def route(rng: np.random.Generator, stops: int, hub: tuple[float, float] = (52.37, 4.90)) -> tuple[Route, np.ndarray]:
    """A round trip over stops in a few neighbourhoods, nearest first, and the stops' vertices."""
    centres = rng.normal(hub, [0.03, 0.05], size=(int(rng.integers(2, 5)), 2))
    at = centres[rng.integers(len(centres), size=stops)] + rng.normal(0, [0.004, 0.006], size=(stops, 2))
    at = at[nearest_first(at[:, 0], at[:, 1], hub)]
    line = np.vstack([hub, at, hub])
    lat, lon, vertices = straight_route(line[:, 0], line[:, 1])
    return Route(lat, lon), vertices[1:-1]


def drive(rng: np.random.Generator, line: Route, vertices: np.ndarray, start_s: float, speed_mps: float = 8.0, dwell_s: float = 40.0, every_s: float = 0.5) -> pd.DataFrame:
    """Pings of a van along its route: t, lat, lon, status, leg."""
    marks = np.concatenate([[0.0], line.cum[vertices], [line.cum[-1]]])
    arrive, leave = [0.0], [0.0]
    for k in range(1, len(marks)):
        arrive.append(leave[-1] + (marks[k] - marks[k - 1]) / (speed_mps * rng.uniform(0.8, 1.2)))
        leave.append(arrive[-1] + (dwell_s * rng.uniform(0.8, 1.5) if k < len(marks) - 1 else 0.0))
    t = np.arange(0.0, arrive[-1] + every_s, every_s)
    known = np.ravel(np.column_stack([arrive, leave]))
    along = np.interp(t, known, np.repeat(marks, 2))
    leg = np.minimum(np.searchsorted(leave, t, side="right") - 1, len(vertices))
    serving = (np.searchsorted(arrive, t, side="right") - 1 > leg) & (leg < len(vertices))
    status = np.where(serving, "DELIVERING", np.where(leg >= len(vertices), "RETURNING", "EN_ROUTE")).astype(object)
    status[-1] = "RETURNED"
    return pd.DataFrame({"t": start_s + t, "lat": np.interp(along, line.cum, line.lat), "lon": np.interp(along, line.cum, line.lon), "status": status, "leg": leg})


def through_network(rng: np.random.Generator, pings: pd.DataFrame, net: Network = Network()) -> pd.DataFrame:
    """The pings as they arrive, copies among them, in order of arrival: the columns of ``pings``, seq and at."""
    n = len(pings)
    at = pings["t"].to_numpy() + rng.exponential(net.jitter_s, n)
    at += np.where(rng.random(n) < net.slow, rng.exponential(net.slow_s, n), 0)
    lost = rng.random(n) < net.dead / max(1, net.dead_s)
    for k in np.flatnonzero(lost):  # in a dead zone pings pile up and arrive together
        back = pings["t"].iloc[k] + net.dead_s
        held = (pings["t"].to_numpy() >= pings["t"].iloc[k]) & (pings["t"].to_numpy() < back)
        at[held] = np.maximum(at[held], back)
    times = 1 + np.where(rng.random(n) < net.copies, rng.integers(1, net.most_copies + 1, n), 0)
    out = pings.assign(seq=np.arange(1, n + 1), at=at).loc[np.repeat(pings.index, times)].reset_index(drop=True)
    again = out.duplicated("seq")
    out.loc[again, "at"] += rng.exponential(2.0, int(again.sum()))
    return out.sort_values("at", kind="stable", ignore_index=True)


def _times(seconds: pd.Series) -> pd.Series:
    """Epoch seconds as times to the microsecond."""
    return pd.to_datetime((seconds * 1e6).round().astype("int64"), unit="us", utc=True)


PINGS = "van_id string, sequence_number bigint, device_timestamp timestamp, ingestion_timestamp timestamp, latitude double, longitude double, status string, current_stop_index int, route_id string"


def fleet(spark: SparkSession, vans: int, stops: int = 8, seed: int = 1, start: str = "2024-01-01 06:00:00") -> DataFrame:
    """Pings of a fleet as they arrive. Each van has its own seed, so any number of tasks gives the same rows."""
    begin = pd.Timestamp(start, tz="UTC").timestamp()

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in f["id"]:
                rng = np.random.default_rng([seed, int(k)])
                line, vertices = route(rng, stops)
                p = through_network(rng, drive(rng, line, vertices, begin + float(rng.uniform(0, 600)), every_s=5.0))
                yield pd.DataFrame({
                    "van_id": f"van-{k:03d}", "sequence_number": p["seq"], "device_timestamp": _times(p["t"]), "ingestion_timestamp": _times(p["at"]),
                    "latitude": p["lat"], "longitude": p["lon"], "status": p["status"], "current_stop_index": p["leg"].astype("int32"), "route_id": f"route-{k:03d}",
                })

    return spark.range(vans).mapInPandas(make, PINGS).withColumn("event_id", event_id(F.lit(seed), "van_id", "sequence_number"))


def event_id(*parts: Column | str) -> Column:
    """An id in the form of a UUID that is the same for the same parts: a copy of a message has its id."""
    d = F.md5(F.concat_ws("/", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))
    cut = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(cut[0], F.lit("-"), cut[1], F.lit("-4"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4])


# Seconds at a stop; the share of stops promised tightly, and the seconds that a deadline then, and else, lies after the plan.
DWELL_S, TIGHT, TIGHT_S, EASY_S = 40.0, 0.15, (-60.0, 90.0), (180.0, 600.0)


def timetable(rng: np.random.Generator, line: Route, vertices: np.ndarray, start_s: float, base_kmh: float = 30.0, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Planned arrival and deadline of each stop, in epoch seconds; ``scale`` is how much faster than the clock the plan runs."""
    way = np.diff(line.cum[vertices], prepend=0.0) / (base_kmh / 3.6)
    planned = np.cumsum(way + np.where(np.arange(len(vertices)) > 0, DWELL_S, 0.0))
    tight = rng.random(len(vertices)) < TIGHT
    slack = np.where(tight, rng.uniform(*TIGHT_S, len(vertices)), rng.uniform(*EASY_S, len(vertices)))
    return start_s + planned / scale, start_s + (planned + slack) / scale


@dataclass
class Driven:
    """A van on its way: what an assignment needs to know of it."""

    route_id: str
    line: Route
    vertices: np.ndarray
    along_m: float = 0.0
    next_stop: int = 0
    ended: bool = False


def apply_assignment(vans: dict[str, Driven], assignment: dict) -> tuple[str, str | int]:
    """Put an assigned stop into its van's route: ``("inserted", index)``, or ``("rejected", why)``.

    It comes before the stop that it was planned before, or before the next one if that is past.
    """
    read = [assignment.get(k) for k in ("van_id", "latitude", "longitude", "insert_before", "sla_deadline")]
    if not isinstance(read[0], str) or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in read[1:4]) or not read[4]:
        return "rejected", "malformed assignment"
    van = vans.get(read[0])
    if van is None:
        return "rejected", f"{read[0]} is not running"
    if van.route_id != assignment.get("route_id"):
        return "rejected", f"{read[0]} has moved on to another route"
    if van.ended or van.next_stop > len(van.vertices):
        return "rejected", f"{read[0]} can no longer take stops"
    k = min(max(int(read[3]), van.next_stop), len(van.vertices))
    van.line, van.vertices = with_stop(van.line, van.vertices, van.along_m, k, float(read[1]), float(read[2]))
    return "inserted", k
