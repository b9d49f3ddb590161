"""Overlapping and gapped intervals merged to continuous periods, with the gaps (problem 6).

``IntervalMap`` keeps an entity's disjoint intervals in order; an insertion finds by binary
search what it overlaps or touches, merges that, and updates the gaps around it. The batch
operator keeps one map at a time for an entity and a span of time (intervals are cut
at the borders of spans, so that a busy entity is worked on by many tasks); one row per
span is then enough to join periods and gaps across borders. The streaming operator
keeps the map in keyed state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.session import micros, staged

SPAN_US = 86_400_000_000


class IntervalMap:
    """Disjoint closed intervals in order, that neither overlap nor touch, and the gaps between them.

    ``gap_starts[k]`` and ``gap_ends[k]`` bound the gap between intervals k and k + 1.
    """

    __slots__ = ("starts", "ends", "gap_starts", "gap_ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = list(starts or []), list(ends or [])
        self.gap_starts, self.gap_ends = self.ends[:-1], self.starts[1:]

    def insert(self, start: int, end: int) -> tuple[int, int]:
        """Add [start, end], update the gaps around it, and return the period that it is part of now."""
        a = bisect_left(self.ends, start)  # the first interval that ends at or after the start
        b = bisect_right(self.starts, end)  # past the last that starts at or before the end
        if a < b:
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        before, after = ([self.ends[a - 1]] if a else []), ([self.starts[b]] if b < len(self.starts) else [])
        # the gaps from the one before the first interval merged to the one after the last give way to those around the period
        first, past = max(0, a - 1), max(0, min(b, len(self.starts) - 1))
        self.gap_starts[first:past], self.gap_ends[first:past] = before + [end] * len(after), [start] * len(before) + after
        self.starts[a:b], self.ends[a:b] = [start], [end]
        return start, end

    def around(self, start: int) -> tuple[int, int, int | None, int | None]:
        """The period that holds ``start``, with the end of the one before and the start of the one after."""
        k = bisect_right(self.starts, start) - 1
        return self.starts[k], self.ends[k], self.gap_starts[k - 1] if k else None, self.gap_ends[k] if k < len(self.gap_ends) else None

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.gap_starts, self.gap_ends))


def valid_intervals(logs: DataFrame, key: str, start: str, end: str, longest_s: int) -> DataFrame:
    """Intervals that can be true: key, s, e in microseconds, equal ones once.

    Left out are rows with a null key or time, an end before the start, or a length over
    ``longest_s``. An interval of no length is one.
    """
    rows = logs.where(F.col(key).isNotNull()).select(F.col(key), micros(start).alias("s"), micros(end).alias("e"))
    return rows.where((F.col("e") >= F.col("s")) & (F.col("e") - F.col("s") <= longest_s * 1_000_000)).distinct()


def spans(intervals: DataFrame, key: str) -> DataFrame:
    """One row for each key and span of time: the map's periods (s, e) and its gaps (gap_s, gap_e), as arrays.

    ``intervals`` has ``key``, ``s`` and ``e`` (s <= e); a null key or time is skipped. Intervals are cut at the borders of spans.
    """
    over = F.floor(F.col("s") / F.lit(SPAN_US)), F.floor(F.col("e") / F.lit(SPAN_US))
    cut = intervals.where(F.col(key).isNotNull() & (F.col("s") <= F.col("e"))).select(key, "s", "e", F.explode(F.sequence(*over)).alias("span"))
    cut = cut.select(key, "span", F.greatest("s", F.col("span") * SPAN_US).alias("s"), F.least("e", (F.col("span") + 1) * SPAN_US).alias("e")).distinct()
    columns = [key, "span", "s", "e", "gap_s", "gap_e"]

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, IntervalMap()
        for f in frames:
            out = []
            for k, p, s, e in zip(f[key], f["span"].tolist(), f["s"].tolist(), f["e"].tolist()):
                if (k, p) != now:
                    if now is not None:
                        out.append((*now, held.starts, held.ends, held.gap_starts, held.gap_ends))
                    now, held = (k, p), IntervalMap()
                held.insert(s, e)
            yield pd.DataFrame(out, columns=columns)
        if now is not None:
            yield pd.DataFrame([(*now, held.starts, held.ends, held.gap_starts, held.gap_ends)], columns=columns)

    lists = "s array<bigint>, e array<bigint>, gap_s array<bigint>, gap_e array<bigint>"
    merged = cut.repartition(key, "span").sortWithinPartitions(key, "span").mapInPandas(merge, f"{key} string, span bigint, {lists}")
    return staged(merged, "spans")  # read twice


def _borders(spans: DataFrame, key: str) -> DataFrame:
    """What joins a span's map to its neighbours': ``before``, the last end of an earlier span, and ``until``, where its last period ends.

    One short row for each key and span is all that comes together.
    """
    order = Window.partitionBy(key).orderBy("span")
    short = spans.select(key, "span", F.col("s")[0].alias("first_s"), F.col("e")[0].alias("first_e"), F.element_at("e", -1).alias("last_e"), F.size("s").alias("n"))
    linked = short.withColumn("before", F.lag("last_e").over(order))
    # where a period ends that reaches this span from earlier ones; null if it goes on through it
    stops = F.when(F.col("before") < F.col("first_s"), F.col("before")).when(F.col("n") > 1, F.col("first_e"))
    later = order.rowsBetween(1, Window.unboundedFollowing)
    until = F.coalesce(F.first("stops", ignorenulls=True).over(later), F.last("last_e").over(order.rowsBetween(0, Window.unboundedFollowing)))
    return linked.withColumn("stops", stops).select(key, "span", "before", "first_s", until.alias("until"))


def periods(intervals: DataFrame, key: str) -> DataFrame:
    """Continuous periods of each key, with the end of the one before: key, s, e, before (null for the first).

    ``intervals`` has ``key``, ``s`` and ``e`` (s <= e). Intervals that overlap or touch are one period.
    """
    own = spans(intervals, key)
    both = own.join(_borders(own, key).drop("first_s"), [key, "span"])
    piece = F.posexplode(F.arrays_zip(F.col("s").alias("s"), F.col("e").alias("e"))).alias("_at", "_piece")
    pieces = both.withColumn("_earlier", F.concat(F.array("before"), F.col("gap_s"))).withColumn("_last", F.size("s") - 1).select(key, "until", "_last", "_earlier", piece)
    # a span's first period may go on from the span before, its last into the next
    end = F.when(F.col("_at") == F.col("_last"), F.col("until")).otherwise(F.col("_piece.e"))
    found = pieces.select(key, F.col("_piece.s").alias("s"), end.alias("e"), F.col("_earlier")[F.col("_at")].alias("before"))
    return found.where(F.col("before").isNull() | (F.col("before") < F.col("s")))


def gaps(intervals: DataFrame, key: str) -> DataFrame:
    """Gaps between neighbouring periods of each key: key, gap_start_us, gap_end_us.

    Within spans they are the maps' own; at a border it is what lies between two maps.
    """
    own = spans(intervals, key)
    inside = own.select(key, F.explode(F.arrays_zip(F.col("gap_s").alias("gap_s"), F.col("gap_e").alias("gap_e"))).alias("g")).select(key, "g.gap_s", "g.gap_e")
    across = _borders(own, key).where(F.col("before") < F.col("first_s")).select(key, "before", "first_s")
    return inside.union(across).toDF(key, "gap_start_us", "gap_end_us")
