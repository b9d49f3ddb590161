"""Mergeable percentiles with an error relative to the distance from the upper end (problem 4).

A sketch is a ladder of relative-rank compactors (Cormode, Karnin, Liberty, Thaler and
Vesely, "Relative Error Streaming Quantiles", PODS 2021). An item at level h stands for 2**h
values. When a compactor overflows it sorts its items, leaves the largest ones alone and
passes every second of the others to the level above; how many are left alone follows a
schedule of sections, so that the top of the distribution stays exact or nearly so. Two
sketches, of partitions or of days, are merged level by level.

Besides the usual estimate, a sketch knows a certain bound: a compaction at level h
shifts the rank of a value by at most 2**h, and not at all if the value is at or above all
compacted items. Each level counts its compactions and remembers its highest
compacted item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.session import staged

SECTION = 32  # k: larger is more exact; the error falls as 1 / k
LEAST_SECTION = 4.0
HELD = 5_000  # sketches in one task


class Compactor:
    """One level: unsorted items and the state of its compaction schedule."""

    __slots__ = ("items", "state", "sections", "width", "compactions", "top")

    def __init__(self, width: float = SECTION):
        self.items = np.empty(0)
        self.state, self.sections, self.width = 0, 3, float(width)
        self.compactions, self.top = 0, -np.inf

    @property
    def section(self) -> int:
        return max(4, 2 * round(self.width / 2))

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.section

    def compact(self, coin: int) -> np.ndarray:
        """Thin out the lower items; what is returned weighs twice as much as here."""
        if self.state >= 1 << (self.sections - 1) and self.width > LEAST_SECTION:
            self.sections, self.width = self.sections * 2, self.width / 2**0.5
        run = 1
        while self.state >> (run - 1) & 1:
            run += 1
        self.items.sort()
        spared = self.capacity // 2 + (self.sections - min(run, self.sections)) * self.section
        cut = max(0, len(self.items) - spared)
        cut -= cut % 2
        if not cut:
            return self.items[:0]
        low, self.items = self.items[:cut], self.items[cut:]
        self.state += 1
        self.compactions += 1
        self.top = max(self.top, low[-1])
        return low[coin::2]


_ALL = (1 << 64) - 1


def _mixed(x: int) -> int:
    """A 64-bit number whose every bit depends on every bit of ``x`` (the finaliser of splitmix64)."""
    x &= _ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def seed_of(*parts) -> int:
    """A seed out of what tells a sketch from others: its key, its partition, its first values."""
    return xxhash.xxh64_intdigest(b"\0".join(p if isinstance(p, bytes) else str(p).encode() for p in parts))


class RelativeSketch:
    """Percentiles of a stream, exact at the top and with bounded rank error below.

    NaN is not a value and is skipped. The coins come from ``seed``, whose state goes on in the bytes and is mixed when
    sketches are merged: one sequence of calls always gives one sketch. Sketches that will be
    merged need seeds of their own, else their errors add up instead of cancelling.
    """

    def __init__(self, section: int = SECTION, seed: int = 1):
        self.section, self.count = section, 0
        self.levels = [Compactor(section)]
        self.coins = _mixed(seed)

    def _coin(self) -> int:
        self.coins = (self.coins + 0x9E3779B97F4A7C15) & _ALL
        return _mixed(self.coins) >> 63

    def update(self, values: np.ndarray) -> RelativeSketch:
        values = np.asarray(values, dtype=float)
        values = values[~np.isnan(values)]
        self.count += len(values)
        while len(values):
            room = max(1, self.levels[0].capacity - len(self.levels[0].items))
            self.levels[0].items = np.concatenate([self.levels[0].items, values[:room]])
            values = values[room:]
            self._settle()
        return self

    def merge(self, other: RelativeSketch) -> RelativeSketch:
        self.count += other.count
        self.coins = _mixed(self.coins ^ (other.coins << 1 | other.coins >> 63))
        while len(self.levels) < len(other.levels):
            self.levels.append(Compactor(self.section))
        for mine, theirs in zip(self.levels, other.levels):
            mine.items = np.concatenate([mine.items, theirs.items])
            mine.state |= theirs.state
            if theirs.sections > mine.sections:
                mine.sections, mine.width = theirs.sections, theirs.width
            mine.compactions += theirs.compactions
            mine.top = max(mine.top, theirs.top)
        self._settle()
        return self

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            while len(level.items) >= level.capacity:
                raised = level.compact(self._coin())
                if not len(raised):
                    break
                if h + 1 == len(self.levels):
                    self.levels.append(Compactor(self.section))
                self.levels[h + 1].items = np.concatenate([self.levels[h + 1].items, raised])
            h += 1

    def rank(self, value: float) -> tuple[int, int]:
        """How many values are at most ``value``: the estimate and the most it can be off."""
        estimate = sum(int(np.count_nonzero(c.items <= value)) << h for h, c in enumerate(self.levels))
        return estimate, sum(c.compactions << h for h, c in enumerate(self.levels) if c.top > value)

    def percentile(self, pct: float) -> float:
        """The smallest item that at least ``pct`` percent of the values don't exceed; NaN if empty."""
        if not self.count:
            return float("nan")
        items = np.concatenate([c.items for c in self.levels])
        weight = np.concatenate([np.full(len(c.items), 1 << h, dtype=np.int64) for h, c in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        at = np.searchsorted(np.cumsum(weight[order]), np.ceil(pct * self.count / 100))
        return float(items[order][min(at, len(items) - 1)])

    def to_bytes(self) -> bytes:
        head = [self.section, self.count, len(self.levels), self.coins - (1 << 63)]
        meta = [[c.state, c.sections, c.compactions, len(c.items)] for c in self.levels]
        real = [[c.width, c.top] for c in self.levels]
        return b"".join(
            [np.array(head, "<i8").tobytes(), np.array(meta, "<i8").tobytes(), np.array(real, "<f8").tobytes(), *(c.items.astype("<f8").tobytes() for c in self.levels)]
        )

    @staticmethod
    def from_bytes(data: bytes) -> RelativeSketch:
        section, count, n, coins = np.frombuffer(data, "<i8", 4).tolist()
        meta = np.frombuffer(data, "<i8", 4 * n, 32).reshape(n, 4)
        real = np.frombuffer(data, "<f8", 2 * n, 32 + 32 * n).reshape(n, 2)
        sketch, at = RelativeSketch(section), 32 + 48 * n
        sketch.count, sketch.levels, sketch.coins = count, [], coins + (1 << 63)
        for (state, sections, compactions, size), (width, top) in zip(meta.tolist(), real.tolist()):
            c = Compactor(width)
            c.state, c.sections, c.compactions, c.top = state, sections, compactions, top
            c.items = np.frombuffer(data, "<f8", size, at).copy()
            at += 8 * size
            sketch.levels.append(c)
        return sketch


SKETCHES = "{key} string, n bigint, sketch binary"


def sketches(values: DataFrame, key: str, value: str, section: int = SECTION) -> DataFrame:
    """A sketch for each key and input partition: key, n, sketch.

    Rows with a null key or value are skipped. A task holds at most ``HELD`` sketches, each of logarithmic size, and hands
    them on when more keys come: a key then has several, which are merged like those of partitions.
    """

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, RelativeSketch] = {}
        where = context.partitionId() if (context := TaskContext.get()) else 0

        def handed_on() -> pd.DataFrame:
            out = pd.DataFrame({key: list(held), "n": [s.count for s in held.values()], "sketch": [s.to_bytes() for s in held.values()]})
            held.clear()
            return out

        for frame in frames:
            for k, part in frame.groupby(key, sort=False)[value]:
                own = part.to_numpy(float)
                if k not in held:
                    if len(held) >= HELD:
                        yield handed_on()
                    held[k] = RelativeSketch(section, seed_of(k, where, own[:64].tobytes()))
                held[k].update(own)
        if held:
            yield handed_on()

    rows = values.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key), F.col(value).cast("double").alias(value))
    return rows.mapInPandas(build, SKETCHES.format(key=key))


def merged(parts: DataFrame, key: str, fan_in: int = 64) -> DataFrame:
    """Sketches of partitions or days merged to one for each key.

    A key with very many parts is merged in two steps, the first on ``fan_in`` salts, so that no
    task reads all of them.
    """

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sketch = None, None
        for frame in frames:
            out = []
            for k, data in zip(frame[key], frame["sketch"]):
                if k == now:
                    sketch.merge(RelativeSketch.from_bytes(data))
                else:
                    if sketch is not None:
                        out.append((now, sketch.count, sketch.to_bytes()))
                    now, sketch = k, RelativeSketch.from_bytes(data)
            if out:
                yield pd.DataFrame(out, columns=[key, "n", "sketch"])
        if sketch is not None:
            yield pd.DataFrame([(now, sketch.count, sketch.to_bytes())], columns=[key, "n", "sketch"])

    schema = SKETCHES.format(key=key)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(fan_in)))
    once = salted.repartition(key, "salt").drop("salt").sortWithinPartitions(key).mapInPandas(merge, schema)
    return once.repartition(key).sortWithinPartitions(key).mapInPandas(merge, schema)


def percentiles(sketched: DataFrame, key: str, pcts: list[float]) -> DataFrame:
    """Estimates out of merged sketches: key, n, pct, estimate."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, n, float(p), s.percentile(p)) for k, n, d in zip(frame[key], frame["n"], frame["sketch"]) for s in [RelativeSketch.from_bytes(d)] for p in pcts]
            yield pd.DataFrame(rows, columns=[key, "n", "pct", "estimate"])

    return sketched.mapInPandas(read, f"{key} string, n bigint, pct double, estimate double")


def above(sketched: DataFrame, values: DataFrame, key: str, value: str, limits: dict[int, float], least: int = 1) -> DataFrame:
    """Keys and percentiles that exceed their limit: key, pct.

    The percentile pct is the smallest value that at least pct percent of the key's values don't
    exceed; it is above the limit if fewer values than that are at or below the limit. Most
    keys are decided by the sketch's certain bound; for the rest, and only them,
    the values at or below the limit are counted. Keys with fewer than ``least`` values
    have no rows.
    """

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, n, data in zip(frame[key], frame["n"], frame["sketch"]):
                if n >= least:
                    sketch = RelativeSketch.from_bytes(data)
                    for pct, limit in limits.items():
                        need = -(-pct * int(n) // 100)
                        rank, off = sketch.rank(limit)
                        rows.append((k, pct, float(limit), need, None if rank - off < need <= rank + off else rank < need))
            if rows:
                yield pd.DataFrame(rows, columns=[key, "pct", "limit", "need", "above"]).astype({"above": object})

    verdicts = staged(sketched.mapInPandas(judge, f"{key} string, pct bigint, limit double, need bigint, above boolean"), "verdicts")
    open_ = verdicts.where("above is null").drop("above")
    # an inner join with three small rows per open key; the counts are combined before the shuffle
    counted = (
        values.select(key, F.col(value).alias("_value")).join(open_, key)
        .groupBy(key, "pct", "need")
        .agg(F.count_if(F.col("_value") <= F.col("limit")).alias("at_most"))
        .where("at_most < need")
    )
    return verdicts.where("above").select(key, "pct").union(counted.select(key, "pct"))
