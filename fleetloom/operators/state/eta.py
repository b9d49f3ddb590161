"""Arrival estimates of one van along its planned route."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

RADIUS = 6_371_000.0
LONGEST_S = 2**62  # the speed learned of a van that stands still goes to 0: estimates beyond a long are cut


def haversine(lat1, lon1, lat2, lon2):
    up, across = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    h = up * up + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * across * across
    return 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(1.0, h)))


@dataclass
class Route:
    """A polyline with its distances and the speed factor of each segment."""

    lat: np.ndarray
    lon: np.ndarray
    factor: np.ndarray | None = None

    def __post_init__(self):
        self.lat, self.lon = np.asarray(self.lat, float), np.asarray(self.lon, float)
        self.cum = np.concatenate([[0.0], np.cumsum(haversine(self.lat[:-1], self.lon[:-1], self.lat[1:], self.lon[1:]))])
        given = np.ones(0) if self.factor is None else np.asarray(self.factor, float)
        self.factor = given if len(given) else np.ones(max(1, len(self.lat) - 1))

    def locate(self, lat: float, lon: float, first: int, last: int) -> tuple[float, float]:
        """Offset from, and distance along, the line between two vertices; the first of equally near segments."""
        first, last = max(0, first), min(last, len(self.lat) - 1)
        if last <= first:
            return float(haversine(self.lat[first], self.lon[first], lat, lon)), float(self.cum[first])
        degree = RADIUS * np.pi / 180
        x, y = (self.lon[first : last + 1] - lon) * degree * np.cos(np.radians(lat)), (self.lat[first : last + 1] - lat) * degree
        dx, dy = np.diff(x), np.diff(y)
        square = dx * dx + dy * dy
        t = np.clip(np.divide(-(x[:-1] * dx + y[:-1] * dy), square, out=np.zeros(len(dx)), where=square > 0), 0, 1)
        off = np.hypot(x[:-1] + t * dx, y[:-1] + t * dy)
        k = int(off.argmin())
        return float(off[k]), float(self.cum[first + k] + t[k] * (self.cum[first + k + 1] - self.cum[first + k]))

    def locate_all(self, lat: np.ndarray, lon: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """``locate`` of many places between the same two vertices, a bounded number at a time."""
        first, last = max(0, first), min(last, len(self.lat) - 1)
        if last <= first:
            return haversine(self.lat[first], self.lon[first], lat, lon), np.full(len(lat), self.cum[first])
        off, along = np.empty(len(lat)), np.empty(len(lat))
        degree, step = RADIUS * np.pi / 180, max(1, 2_000_000 // (last - first))
        for a in range(0, len(lat), step):
            la, lo = lat[a : a + step, None], lon[a : a + step, None]
            x, y = (self.lon[None, first : last + 1] - lo) * degree * np.cos(np.radians(la)), (self.lat[None, first : last + 1] - la) * degree
            dx, dy = np.diff(x, axis=1), np.diff(y, axis=1)
            square = dx * dx + dy * dy
            t = np.clip(np.divide(-(x[:, :-1] * dx + y[:, :-1] * dy), square, out=np.zeros(dx.shape), where=square > 0), 0, 1)
            gap = np.hypot(x[:, :-1] + t * dx, y[:, :-1] + t * dy)
            k = gap.argmin(axis=1)
            at = np.arange(len(k))
            off[a : a + step] = gap[at, k]
            along[a : a + step] = self.cum[first + k] + t[at, k] * (self.cum[first + k + 1] - self.cum[first + k])
        return off, along

    def factors_at(self, along: np.ndarray) -> np.ndarray:
        return self.factor[np.clip(np.searchsorted(self.cum, along, side="right") - 1, 0, len(self.factor) - 1)]

    def clear_metres(self, along: np.ndarray, vertex: int) -> np.ndarray:
        """The way from places to a vertex, each segment's divided by its factor; 0 where it is behind."""
        weighted = np.concatenate([[0.0], np.cumsum(np.diff(self.cum) / self.factor[: len(self.cum) - 1])])
        end = min(max(vertex, 0), len(self.cum) - 1)
        return np.maximum(0.0, weighted[end] - np.interp(along, self.cum, weighted))

    def factor_at(self, along: float) -> float:
        k = int(np.searchsorted(self.cum, along, side="right")) - 1
        return float(self.factor[min(max(k, 0), len(self.factor) - 1)])

    def travel_seconds(self, along: float, vertex: int, speed: float) -> float:
        end = self.cum[min(max(vertex, 0), len(self.cum) - 1)]
        if speed <= 0 or end <= along:
            return 0.0
        low, high = np.maximum(self.cum[:-1], along), np.minimum(self.cum[1:], end)
        return float((np.maximum(0, high - low) / (speed * self.factor[: len(low)])).sum())


@dataclass
class Stop:
    vertex: int
    lat: float
    lon: float
    deadline: float | None = None
    customer: str | None = None


@dataclass
class Estimate:
    eta_s: int
    method: str
    risk: str
    slack_s: int | None = None
    arrival: float | None = None


@dataclass
class EtaTracker:
    """Follows one van: what it learned of its free speed outlives its routes, all else doesn't.

    The speed is learned from the way made between two pings of one leg, cleared of the zone half-way. Off the
    route, the estimate is the straight line with a surcharge for detours, at the speed of the zone that holds the van.
    """

    off_route_m: float = 200.0
    detour: float = 1.3
    weight: float = 0.3
    least_s: float = 0.2
    most_s: float = 30.0
    critical_s: int = 0
    warning_s: int = 60
    speed: float | None = None
    route_id: str | None = None
    route: Route | None = None
    stops: list[Stop] = field(default_factory=list)
    base: float = 0.0
    scale: float = 1.0
    first_prediction: dict[str, float] = field(default_factory=dict)
    arrivals: dict[str, float] = field(default_factory=dict)
    last: tuple | None = None  # time, leg, along, was under way

    def plan(self, route_id: str, route: Route, stops: list[Stop], base_kmh: float = 36.0, scale: float = 1.0) -> None:
        if route_id != self.route_id:
            self._forget(route_id)
        self.route, self.stops, self.base, self.scale = route, stops, base_kmh, scale

    def _forget(self, route_id: str | None) -> None:
        self.route_id, self.route, self.stops, self.last = route_id, None, [], None
        self.first_prediction, self.arrivals = {}, {}

    def ping(self, time: float, route_id: str, lat: float, lon: float, status: str, leg: int, speed_kmh: float = 0.0, zone_factor: float = 1.0) -> Estimate:
        if route_id != self.route_id:
            self._forget(route_id)
        under_way = status == "EN_ROUTE"
        if status not in ("EN_ROUTE", "DELIVERING"):
            self.last = (time, leg, None, False)
            return Estimate(-1, "NONE", "NONE")
        if self.route is None or not 0 <= leg < len(self.stops):
            self.last = (time, leg, None, under_way)
            return Estimate(-1, "NONE", "UNKNOWN" if self.route is None else "NONE")
        stop = self.stops[leg]
        if status == "DELIVERING":
            at = self.arrivals.setdefault(stop.customer or str(leg), time)
            self.last = (time, leg, None, False)
            late = stop.deadline is not None and at > stop.deadline
            slack = None if stop.deadline is None else int(np.floor(stop.deadline - at))
            return Estimate(0, "NONE", "CRITICAL" if late else "NONE", slack, at)
        off, along = self.route.locate(lat, lon, self.stops[leg - 1].vertex if leg else 0, stop.vertex)
        on_route = off <= self.off_route_m
        factor = self.route.factor_at(along) if on_route else zone_factor
        if on_route and self.last and self.last[1] == leg and self.last[3] and self.last[2] is not None:
            dt, ds = time - self.last[0], along - self.last[2]
            if self.least_s <= dt <= self.most_s and ds >= 0:
                seen = ds / dt / self.route.factor_at((along + self.last[2]) / 2)
                self.speed = seen if self.speed is None else self.weight * seen + (1 - self.weight) * self.speed
        speed = self.speed or (speed_kmh / factor if speed_kmh > 0 else self.base) / 3.6 * self.scale
        if on_route:
            left, method = self.route.travel_seconds(along, stop.vertex, speed), "ROUTE"
        else:
            metres = float(haversine(lat, lon, stop.lat, stop.lon)) * self.detour
            left, method = (metres / (speed * factor) if speed > 0 else 0.0), "STRAIGHT_LINE"
        self.last = (time, leg, along if on_route else None, True)
        eta = int(np.floor(min(left, LONGEST_S) + 0.5))  # rounded before arrival and slack are derived
        arrival = time + eta
        self.first_prediction.setdefault(stop.customer or str(leg), arrival)
        if stop.deadline is None:
            return Estimate(eta, method, "UNKNOWN", None, arrival)
        slack = int(np.floor(stop.deadline - arrival))
        risk = "CRITICAL" if slack < self.critical_s else "WARNING" if slack < self.warning_s else "NONE"
        return Estimate(eta, method, risk, slack, arrival)

    def pings(self, time: np.ndarray, route_id: np.ndarray, lat: np.ndarray, lon: np.ndarray, status: np.ndarray, leg: np.ndarray, speed_kmh: np.ndarray, zone_factor: np.ndarray, plan_of=lambda route_id: None):
        """``ping`` for many pings of the van, in order: arrays of eta_s, method, risk, slack_s (NaN for none) and arrival (NaN for none).

        ``plan_of`` gives the plan of a route, as ``plan`` takes it, or None. ``leg`` is -1 where it isn't known. All but the
        learned speed is worked out for a whole route at a time.
        """
        out = np.full(len(time), -1, np.int64), np.full(len(time), "NONE", object), np.full(len(time), "NONE", object), np.full(len(time), np.nan), np.full(len(time), np.nan)
        cuts = np.flatnonzero(route_id[1:] != route_id[:-1]) + 1
        for own in np.split(np.arange(len(time)), cuts) if len(time) else []:
            name = route_id[own[0]]
            if name != self.route_id:
                found = plan_of(name)
                self.plan(name, *found) if found else self._forget(name)
            self._run(own, time[own], lat[own], lon[own], status[own], leg[own], speed_kmh[own], zone_factor[own], out)
        return out

    def _run(self, own, time, lat, lon, status, leg, speed_kmh, zone_factor, out) -> None:
        eta, method, risk, slack, arrival = out
        moving, serving = status == "EN_ROUTE", status == "DELIVERING"
        known = (leg >= 0) & (leg < len(self.stops)) if self.route is not None else np.zeros(len(own), bool)
        if self.route is None:
            risk[own[moving | serving]] = "UNKNOWN"
        deadline = np.array([np.nan if s.deadline is None else s.deadline for s in self.stops] or [np.nan])[np.where(known, leg, 0)]
        who = [s.customer or str(k) for k, s in enumerate(self.stops)]
        for k in np.flatnonzero(serving & known):
            at = self.arrivals.setdefault(who[leg[k]], time[k])
            eta[own[k]], arrival[own[k]] = 0, at
            if deadline[k] == deadline[k]:
                slack[own[k]] = np.floor(deadline[k] - at)
                risk[own[k]] = "CRITICAL" if at > deadline[k] else "NONE"
        # places along the route, leg by leg
        under = moving & known
        off, along, clear = np.full(len(own), np.nan), np.full(len(own), np.nan), np.full(len(own), np.nan)
        for n in np.unique(leg[under]):
            k = np.flatnonzero(under & (leg == n))
            off[k], along[k] = self.route.locate_all(lat[k], lon[k], self.stops[n - 1].vertex if n else 0, self.stops[n].vertex)
            clear[k] = self.route.clear_metres(along[k], self.stops[n].vertex)
        on_route = off <= self.off_route_m
        along = np.where(on_route, along, np.nan)
        before_time, before_leg, before_along, before_moving = (np.concatenate([[first], rest[:-1]]) for first, rest in zip(
            (np.nan, -2, np.nan, False) if self.last is None else (self.last[0], self.last[1], np.nan if self.last[2] is None else self.last[2], self.last[3]), (time, leg, along, moving)))
        factor = zone_factor.astype(float)
        learned: list[float | None] = [self.speed] * len(own)
        if on_route.any():
            factor[on_route] = self.route.factors_at(along[on_route])
            dt, ds = time - before_time, along - before_along
            taught = on_route & (before_leg == leg) & before_moving.astype(bool) & (dt >= self.least_s) & (dt <= self.most_s) & (ds >= 0)
            where = np.flatnonzero(taught)
            seen = ds[where] / dt[where] / self.route.factors_at((along[where] + before_along[where]) / 2)
            now = self.speed
            for a, b, x in zip(where, [*where[1:], len(own)], seen.tolist()):
                now = x if now is None else self.weight * x + (1 - self.weight) * now
                learned[a:b] = [now] * (b - a)
            self.speed = now
        k = np.flatnonzero(under)
        if len(k):
            taken = np.where(speed_kmh[k] > 0, speed_kmh[k] / factor[k], self.base) / 3.6 * self.scale
            speed = np.array([v or t for v, t in zip((learned[i] for i in k), taken)])
            metres = haversine(lat[k], lon[k], np.array([self.stops[n].lat for n in leg[k]]), np.array([self.stops[n].lon for n in leg[k]])) * self.detour / factor[k]
            left = np.divide(np.where(on_route[k], clear[k], metres), speed, out=np.zeros(len(k)), where=speed > 0)
            sure = np.isfinite(left) | np.isinf(left)  # not so for a ping without a place
            whole = np.floor(np.minimum(np.where(sure, left, 0.0), LONGEST_S) + 0.5)
            at = own[k[sure]]
            eta[at], method[at], arrival[at] = whole[sure].astype(np.int64), np.where(on_route[k], "ROUTE", "STRAIGHT_LINE")[sure], (time[k] + whole)[sure]
            slack[at] = np.floor(deadline[k[sure]] - arrival[at])
            risk[at] = np.select([np.isnan(slack[at]), slack[at] < self.critical_s, slack[at] < self.warning_s], ["UNKNOWN", "CRITICAL", "WARNING"], "NONE")
            risk[own[k[~sure]]] = "UNKNOWN"
            for i, n in zip(at, leg[k[sure]]):
                if who[n] not in self.first_prediction:
                    self.first_prediction[who[n]] = float(arrival[i])
        end = len(own) - 1
        self.last = (float(time[end]), int(leg[end]), float(along[end]) if along[end] == along[end] else None, bool(moving[end]))
