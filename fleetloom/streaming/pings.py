"""Dedup, reordering and arrival estimates of pings in keyed state, with late pings told apart.

One processor does all, in this order, so that a late copy counts as a copy, and estimates see pings in order. Output rows carry
``kind``: released, late, or the dedup verdict of a row that was refused. The state of a van is the same
machines that the batch operators run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from fleetloom.operators.sequences import plan_of_row
from fleetloom.operators.state.dedup import NEW, RESET, WindowDedup
from fleetloom.operators.state.eta import EtaTracker
from fleetloom.operators.state.streams import ReorderBuffer
from fleetloom.session import micros
from fleetloom.sources.zones import zone_at

PLAN = "PLAN"  # the status of a row that is a plan, not a ping
PLANS_HELD = 4  # of a van: the newest
OUTPUT = "kind string, van_id string, seq bigint, ts_us bigint, at_us bigint, status string, payload string"
ESTIMATED = f"{OUTPUT}, eta_s bigint, method string, risk string, slack_s bigint, arrival_us bigint"
STATE = "highest bigint, seen binary, waiting string, released bigint, flush boolean, clock bigint"


class PingProcessor(StatefulProcessor):
    """Pings of one van per call, in order of arrival.

    With ``event_clock`` the time that decides on releases is the newest arrival, so a run over stored data is
    repeatable; else it is processing time, and a timer releases what waits.
    """

    def __init__(self, window: int = 4096, reset: int = 1_000_000, grace_us: int = 3_000_000, most: int = 50, event_clock: bool = True):
        self.window, self.reset, self.grace_us, self.most, self.event_clock = window, reset, grace_us, most, event_clock

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("van", STATE)

    def _load(self) -> tuple[WindowDedup, ReorderBuffer]:
        if not self.state.exists():
            return WindowDedup(self.window, self.reset), ReorderBuffer(self.grace_us, self.most)
        highest, seen, waiting, released, flush, _ = self.state.get()
        dedup = WindowDedup(self.window, self.reset, highest, np.frombuffer(seen, np.int64).copy())
        return dedup, ReorderBuffer(self.grace_us, self.most, waiting=[tuple(w) for w in json.loads(waiting)], released=released, flush=flush)

    def _save(self, dedup: WindowDedup, buffer: ReorderBuffer, clock: int) -> None:
        self.state.update((dedup.highest, dedup.seen.tobytes(), json.dumps(buffer.waiting), buffer.released, buffer.flush, clock))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        dedup, buffer = self._load()
        frame = pd.concat(list(rows)).sort_values(["at_us", "seq"], kind="stable")
        verdicts = dedup.check(frame["seq"].to_numpy())
        out, now = [], 0
        for r, verdict in zip(frame.itertuples(index=False), verdicts):
            now = r.at_us if self.event_clock else timerValues.getCurrentProcessingTimeInMs() * 1000
            out += [("released", key[0], n, t, now, s, p) for t, n, s, p in buffer.drain(now)]
            row = (key[0], r.seq, r.ts_us, r.at_us, r.status, r.payload)
            if verdict not in (NEW, RESET):
                out.append((verdict, *row))
            elif not buffer.offer(r.ts_us, r.seq, r.status, r.payload):
                out.append(("late", *row))
        self._save(dedup, buffer, now)
        if buffer.waiting and not self.event_clock:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 100)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        dedup, buffer = self._load()
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        out = [("released", key[0], n, t, now, s, p) for t, n, s, p in buffer.drain(now)]
        self._save(dedup, buffer, now)
        if buffer.waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 100)
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


_CARRIED = ("event_id", "route_id", "location", "speed_kmh", "battery_pct", "current_stop_index", "total_stops")


class EstimateProcessor(PingProcessor):
    """The same with arrival estimates on the pings that are released, in their order.

    Rows of status PLAN bring plans: the newest ``PLANS_HELD`` of a van are held (by creation, then version; a lower version of a
    held route changes nothing), and replace an older plan of their route from then on.
    """

    def init(self, handle) -> None:
        super().init(handle)
        self.estimates = handle.getValueState("estimates", "plans string, tracker string")

    def _tracker(self) -> tuple[EtaTracker, dict]:
        tracker, plans = EtaTracker(), {}
        if self.estimates.exists():
            plans, held = map(json.loads, self.estimates.get())
            route = held.pop("route_id")
            if route in plans:
                tracker.plan(route, *plan_of_row(SimpleNamespace(**plans[route])))
            tracker.route_id = route
            for name, value in held.items():
                setattr(tracker, name, tuple(value) if name == "last" and value is not None else value)
        return tracker, plans

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        tracker, plans = self._tracker()
        for r in frame[frame["status"] == PLAN].itertuples(index=False):
            plan = json.loads(r.payload) | {"created_us": r.ts_us}
            plan = {"lats": [], "lons": [], "factors": None, "vertices": [], "deadlines": [], "customers": []} | plan
            held = plans.get(plan["route_id"])
            if held is None or (held["version"] or 0) < (plan["version"] or 0):
                plans[plan["route_id"]] = plan
                if plan["route_id"] == tracker.route_id:
                    tracker.plan(plan["route_id"], *plan_of_row(SimpleNamespace(**plan)))
        for name in sorted(plans, key=lambda n: (plans[n]["created_us"], plans[n]["version"] or 0))[:-PLANS_HELD]:
            del plans[name]
        out = []
        pings = frame[frame["status"] != PLAN]
        if len(pings):
            out = [f for f in super().handleInputRows(key, iter([pings]), timerValues)]
        yield self._estimated(tracker, plans, pd.concat(out) if out else self._frame([]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = pd.concat(list(super().handleExpiredTimer(key, timerValues, expiredTimerInfo)))
        yield self._estimated(*self._tracker(), out)

    def _estimated(self, tracker: EtaTracker, plans: dict, out: pd.DataFrame) -> pd.DataFrame:
        known = {name: plan_of_row(SimpleNamespace(**p)) for name, p in plans.items()}
        out = out.reset_index(drop=True)
        out = out.assign(eta_s=pd.array([None] * len(out), "Int64"), method=None, risk=None, slack_s=pd.array([None] * len(out), "Int64"), arrival_us=pd.array([None] * len(out), "Int64"))
        at = np.flatnonzero(out["kind"] == "released")
        if len(at):
            read = [json.loads(p) for p in out["payload"].to_numpy()[at]]
            place = np.array([[(r.get("location") or {}).get(c, np.nan) for c in ("latitude", "longitude")] for r in read], float)
            number = lambda name, missing: np.array([missing if r.get(name) is None else r[name] for r in read])
            eta, method, risk, slack, arrival = tracker.pings(
                out["ts_us"].to_numpy(np.int64)[at] / 1e6, np.array([r.get("route_id") for r in read], object), place[:, 0], place[:, 1], out["status"].to_numpy(object)[at],
                number("current_stop_index", -1).astype(np.int64), number("speed_kmh", np.nan).astype(float), number("speed_factor", 1.0).astype(float), known.get,
            )
            for name, values in (("eta_s", eta), ("method", method), ("risk", risk), ("slack_s", pd.array(slack, "Int64")), ("arrival_us", pd.array(np.floor(arrival * 1e6), "Int64"))):
                out.loc[at, name] = values
        held = {n: getattr(tracker, n) for n in ("route_id", "speed", "last", "first_prediction", "arrivals")}
        self.estimates.update((json.dumps(plans), json.dumps(held)))
        return out


def keyed_pings(records: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Usable ping records as the processor takes them; with ``zones`` (``sources.zones.active_zones``) also the zone that holds each."""
    if zones is not None:
        placed = zone_at(records.withColumns({"_x": F.col("location.longitude"), "_y": F.col("location.latitude")}), zones, "_x", "_y")
        records = placed.drop("_x", "_y")
        return _keyed(records, *_CARRIED, "zone_name", "speed_factor")
    return _keyed(records, *_CARRIED)


def keyed_plans(plans: DataFrame) -> DataFrame:
    """Plans (as ``sequences.estimates`` takes them, with version and created_us) as rows that the processor takes beside the pings."""
    plans = plans if "factors" in plans.columns else plans.withColumn("factors", F.lit(None).cast("array<double>"))
    held = F.struct("route_id", "version", "lats", "lons", "factors", "vertices", "deadlines", "customers", *[c for c in ("base_speed_kmh", "time_scale") if c in plans.columns])
    return plans.select("van_id", F.col("version").cast("bigint").alias("seq"), F.col("created_us").alias("ts_us"), F.col("created_us").alias("at_us"), F.lit(PLAN).alias("status"), F.to_json(held).alias("payload"))


def _keyed(records: DataFrame, *carried: str) -> DataFrame:
    arrived = F.coalesce(micros("ingestion_timestamp"), micros("device_timestamp"))
    return records.select(
        "van_id", F.col("sequence_number").alias("seq"), micros("device_timestamp").alias("ts_us"), arrived.alias("at_us"), "status", F.to_json(F.struct(*carried)).alias("payload"),
    )


def estimated_pings(pings: DataFrame, plans: DataFrame, processor: EstimateProcessor | None = None) -> DataFrame:
    """The tagged stream of ``ESTIMATED``: pings (``keyed_pings``) with the plans (``keyed_plans``) that came before or with them."""
    processor = processor or EstimateProcessor()
    mode = "None" if processor.event_clock else "ProcessingTime"
    return pings.unionByName(plans).groupBy("van_id").transformWithStateInPandas(processor, outputStructType=ESTIMATED, outputMode="Append", timeMode=mode)


def ordered_pings(pings: DataFrame, processor: PingProcessor | None = None) -> DataFrame:
    """The tagged stream of ``OUTPUT``. Needs the RocksDB state store (``use_rocksdb``)."""
    processor = processor or PingProcessor()
    mode = "None" if processor.event_clock else "ProcessingTime"
    return pings.groupBy("van_id").transformWithStateInPandas(processor, outputStructType=OUTPUT, outputMode="Append", timeMode=mode)


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
