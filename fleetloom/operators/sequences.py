"""Order-dependent operators over whole logs: window dedup, lateness, sampling, estimates along routes.

Each reads a van's rows in order of arrival as a stream of sorted batches and keeps one van's state at a time, so a
busy van needs no more memory than a quiet one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators.prefix import running_max
from fleetloom.operators.state.dedup import BloomDedup, WindowDedup
from fleetloom.operators.state.eta import EtaTracker, Route, Stop
from fleetloom.operators.state.streams import NewestPlan, Throttle, TokenBuckets
from fleetloom.session import micros

DAY_US = 86_400_000_000


def arrivals(log: DataFrame) -> DataFrame:
    """Usable pings as they arrive: record_id, van_id, seq, ts_us, at_us, status. A missing arrival counts as the device time; a missing number as 0."""
    return log.where("van_id is not null and device_timestamp is not null and record_id is not null").select(
        "record_id", "van_id", F.coalesce("sequence_number", F.lit(0)).alias("seq"), micros("device_timestamp").alias("ts_us"),
        F.coalesce(micros("ingestion_timestamp"), micros("device_timestamp")).alias("at_us"), "status",
    )


def by_van(rows: DataFrame, order: list[str], make: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a state machine over each van's rows in order; ``step`` takes the state and the van's next rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in frames:
            cuts = np.flatnonzero(f["van_id"].to_numpy()[1:] != f["van_id"].to_numpy()[:-1]) + 1
            for part in np.split(np.arange(len(f)), cuts):
                if not len(part):
                    continue
                own = f.iloc[part]
                if own["van_id"].iloc[0] != now:
                    now, state = own["van_id"].iloc[0], make()
                yield step(state, own)

    return rows.repartition("van_id").sortWithinPartitions("van_id", *order).mapInPandas(run, schema)


def window_verdicts(log: DataFrame, window: int = 4096, reset: int = 1_000_000) -> DataFrame:
    """The sliding-window verdict on every ping in order of arrival: record_id, van_id, verdict (new, reset, duplicate or too_old)."""
    return by_van(
        arrivals(log).select("record_id", "van_id", "seq", "at_us"), ["at_us", "record_id"], lambda: WindowDedup(window, reset),
        lambda state, own: pd.DataFrame({"record_id": own["record_id"], "van_id": own["van_id"], "verdict": state.check(own["seq"].to_numpy())}),
        "record_id bigint, van_id string, verdict string",
    )


def bloom_verdicts(log: DataFrame, expected: int = 100_000, false_rate: float = 0.001) -> DataFrame:
    """The verdict of a Bloom filter of two generations on every ping in order of arrival: record_id, van_id, repeated.

    Approximate: a few new pings are taken for repeated ones.
    """

    def step(state: BloomDedup, own: pd.DataFrame) -> pd.DataFrame:
        van = own["van_id"].iloc[0]
        return pd.DataFrame({"record_id": own["record_id"], "van_id": own["van_id"], "repeated": state.check(van, own["seq"].to_numpy())})

    rows = arrivals(log).select("record_id", "van_id", "seq", "at_us")
    return by_van(rows, ["at_us", "record_id"], lambda: BloomDedup(expected, false_rate), step, "record_id bigint, van_id string, repeated boolean")


def accepted_plans(plans: DataFrame) -> DataFrame:
    """Plans in order of arrival with the verdict whether each replaced its van's held one: van_id, route_id, version, arrival, accepted.

    The last accepted row of a van is its plan. ``plans`` has van_id, route_id, version, created_s and arrival.
    """

    def step(state: NewestPlan, own: pd.DataFrame) -> pd.DataFrame:
        taken = [state.put(r, int(v), None if c != c else c) for r, v, c in zip(own["route_id"], own["version"], own["created_s"])]
        return own[["van_id", "route_id", "version", "arrival"]].assign(accepted=taken)

    rows = plans.where("van_id is not null and route_id is not null").select("van_id", "route_id", F.coalesce("version", F.lit(0)).alias("version"), F.col("created_s").cast("double").alias("created_s"), "arrival")
    return by_van(rows, ["arrival", "route_id", "version"], NewestPlan, step, "van_id string, route_id string, version int, arrival bigint, accepted boolean")


def admitted_requests(requests: DataFrame, burst: float = 3, per_minute: float = 6, all_per_minute: float = 60) -> DataFrame:
    """Requests in order of time with the limiter's verdict: client, at_s, passed.

    The bucket for all clients makes this one sequence. It streams through one task; only the buckets of clients that
    were active within ten minutes are held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = TokenBuckets(burst, per_minute, all_per_minute)
        for f in frames:
            yield f.assign(passed=[buckets.try_acquire(c, t) for c, t in zip(f["client"], f["at_s"].tolist())])

    rows = requests.where("client is not null and at_s is not null").select("client", F.col("at_s").cast("double").alias("at_s"))
    return rows.repartition(1).sortWithinPartitions("at_s", "client").mapInPandas(run, "client string, at_s double, passed boolean")


def late_pings(log: DataFrame, grace_s: float = 3.0) -> DataFrame:
    """Pings that arrive after a later one of their van was released: record_id, van_id, ts_us, at_us.

    A ping is released once its device time lies more than the grace back. What counts is the
    running maximum of released device times when a ping arrives; it is worked out in blocks of
    a day, all inside the engine.
    """
    rows = arrivals(log)
    released = rows.select(
        "van_id", F.greatest("at_us", F.col("ts_us") + int(grace_s * 1e6) + 1).alias("clock"), F.lit(0).alias("kind"), "ts_us", F.lit(None).cast("bigint").alias("record_id"), "at_us"
    )
    asked = rows.select("van_id", F.col("at_us").alias("clock"), F.lit(1).alias("kind"), "ts_us", "record_id", "at_us")
    marked = running_max(released.unionByName(asked), "van_id", "clock", F.when(F.col("kind") == 0, F.col("ts_us")), "released_us", DAY_US, "kind")
    return marked.where("kind = 1 and released_us > ts_us").select("record_id", "van_id", "ts_us", "at_us")


def archive_sample(log: DataFrame, every_s: float = 2.0) -> DataFrame:
    """Pings at least some time after the last one taken of their van, and terminal ones: record_id, van_id."""

    def step(state: Throttle, own: pd.DataFrame) -> pd.DataFrame:
        keep = [state.due(t, s) for t, s in zip(own["ts_us"].tolist(), own["status"])]
        return own.loc[keep, ["record_id", "van_id"]]

    return by_van(
        arrivals(log), ["ts_us", "seq", "record_id"], lambda: Throttle(int(every_s * 1e6), on_change=False, always="RETURNED"), step, "record_id bigint, van_id string"
    )


def throttled(log: DataFrame, every_s: float = 0.5) -> DataFrame:
    """Updates that are published: the first of a van, every change of status, and at most one per interval else."""

    def step(state: Throttle, own: pd.DataFrame) -> pd.DataFrame:
        keep = [state.due(t, s) for t, s in zip(own["at_us"].tolist(), own["status"])]
        return own.loc[keep, ["record_id", "van_id"]]

    return by_van(arrivals(log), ["at_us", "record_id"], lambda: Throttle(int(every_s * 1e6)), step, "record_id bigint, van_id string")


def sampled(log: DataFrame, every_s: int = 60) -> DataFrame:
    """The last ping of each van in each interval of arrival: van_id, slot_s, record_id."""
    slot = F.floor(F.col("at_us") / F.lit(every_s * 1_000_000)) * every_s
    return arrivals(log).groupBy("van_id", slot.alias("slot_s")).agg(F.max_by("record_id", F.struct("at_us", "record_id")).alias("record_id"))


def plan_of_row(r) -> tuple[Route, list[Stop], float, float]:
    """A plan out of a row with lats, lons, factors, vertices, deadlines and customers, perhaps base_speed_kmh and time_scale."""
    stops = [Stop(int(v), float(r.lats[int(v)]), float(r.lons[int(v)]), None if d is None or d != d else float(d), c) for v, d, c in zip(r.vertices, r.deadlines, r.customers)]
    return Route(r.lats, r.lons, r.factors), stops, getattr(r, "base_speed_kmh", None) or 36.0, getattr(r, "time_scale", None) or 1.0


def estimates(pings: DataFrame, plans: DataFrame) -> DataFrame:
    """An arrival estimate for every ping: record_id, van_id, eta_s, method, risk, slack_s.

    ``pings`` has record_id, van_id, route_id, ts_us, lat, lon, status, leg and speed_kmh; ``plans`` has van_id,
    route_id, lats, lons (the polyline), vertices, deadlines (epoch seconds) and customers of the stops. Zones
    slow an estimate through the plans' factors, one for each segment, and the pings' zone_factor, at their
    place; without these columns, or where they are null, nothing is slowed. A plan
    joins its van's pings as one row before them, so a long polyline isn't repeated for every
    ping. A ping without a plan or a place is UNKNOWN.
    """
    plan_columns = ["lats", "lons", "factors", "vertices", "deadlines", "customers"]
    plans = plans if "factors" in plans.columns else plans.withColumn("factors", F.lit(None).cast("array<double>"))
    pings = pings.withColumn("zone_factor", F.coalesce("zone_factor", F.lit(1.0)) if "zone_factor" in pings.columns else F.lit(1.0))
    lead = plans.select("van_id", "route_id", *plan_columns, F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("ts_us"))
    both = pings.withColumn("kind", F.lit(1)).unionByName(lead, allowMissingColumns=True).where("van_id is not null and ts_us is not null")
    # a plan is sorted to the start of its van, before all pings
    columns = ["record_id", "van_id", "route_id", "ts_us", "lat", "lon", "status", "leg", "speed_kmh", "zone_factor", "kind", *plan_columns]

    def make() -> tuple[EtaTracker, dict]:
        return EtaTracker(), {}

    def step(state: tuple[EtaTracker, dict], own: pd.DataFrame) -> pd.DataFrame:
        tracker, known = state
        for r in own[own["kind"] == 0].itertuples(index=False):
            known[r.route_id] = plan_of_row(r)
        own = own[own["kind"] == 1]
        leg, numbers = own["leg"].fillna(-1).to_numpy(np.int64), {c: own[c].to_numpy(float) for c in ("lat", "lon", "speed_kmh", "zone_factor")}
        eta, method, risk, slack, _ = tracker.pings(own["ts_us"].to_numpy(np.int64) / 1e6, own["route_id"].to_numpy(object), numbers["lat"], numbers["lon"], own["status"].to_numpy(object), leg, numbers["speed_kmh"], numbers["zone_factor"], known.get)
        f = pd.DataFrame({"record_id": own["record_id"].to_numpy(), "van_id": own["van_id"].to_numpy(), "eta_s": eta, "method": method, "risk": risk, "slack_s": slack})
        return f.astype({"record_id": "Int64", "slack_s": "Int64"})

    return by_van(both.select(columns), ["kind", "ts_us", "record_id"], make, step, "record_id bigint, van_id string, eta_s bigint, method string, risk string, slack_s bigint")


def plans_from_logs(logs: DataFrame) -> DataFrame:
    """Plans out of delivered stops: a polyline through the stops of a route, in their order, each its own vertex.

    The first arrival at a stop gives its place and deadline. A route has as many stops as a van can serve in a day.
    """
    first = (
        logs.where("van_id is not null and route_id is not null and location is not null and stop_index is not null")
        .groupBy("van_id", "route_id", "stop_index")
        .agg(F.min_by(F.struct("location", "sla_deadline", "customer_id"), F.struct("created_at", "id")).alias("s"))
    )
    listed = first.groupBy("van_id", "route_id").agg(F.array_sort(F.collect_list(F.struct("stop_index", "s"))).alias("l"))
    size = F.element_at("l", -1)["stop_index"]
    # stops that were never logged keep their number: they share the place of the next known one
    at = F.transform(F.sequence(F.lit(0), size), lambda i: F.get(F.filter("l", lambda x: x["stop_index"] >= i), F.lit(0)))
    return listed.withColumn("at", at).select(
        "van_id", "route_id", F.transform("at", lambda x: x["s"]["location"]["latitude"]).alias("lats"), F.transform("at", lambda x: x["s"]["location"]["longitude"]).alias("lons"),
        F.sequence(F.lit(0), size).alias("vertices"), F.transform("at", lambda x: micros(x["s"]["sla_deadline"]) / 1e6).alias("deadlines"),
        F.transform("at", lambda x: x["s"]["customer_id"]).alias("customers"),
    )
