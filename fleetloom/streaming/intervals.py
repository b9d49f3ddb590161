"""Busy periods and gaps of entities while intervals arrive, with an ordered interval map in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetloom.operators.intervals import IntervalMap

OUTPUT = "key string, period_start bigint, period_end bigint, before bigint, after bigint"


def _insert(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = IntervalMap(*state.get) if state.exists else IntervalMap()
    touched: set[int] = set()
    for f in frames:
        for s, e in zip(f["s"].tolist(), f["e"].tolist()):
            start, _ = held.insert(s, e)
            touched.add(start)
    state.update((held.starts, held.ends))
    rows = sorted({(key[0], *held.around(t)) for t in touched}, key=lambda r: r[1])
    f = pd.DataFrame(rows, columns=["key", "period_start", "period_end", "before", "after"])
    yield f.astype({"before": "Int64", "after": "Int64"})


def merged_periods(intervals: DataFrame, key: str) -> DataFrame:
    """For each micro-batch, the periods that it changed, with the ends of the gaps around them.

    ``intervals`` has ``key``, ``s`` and ``e``. A period that was swallowed by a larger one isn't reported again: a sink
    deletes periods of the key that lie within a reported one, then inserts it.
    """
    return intervals.groupBy(key).applyInPandasWithState(_insert, OUTPUT, "starts array<bigint>, ends array<bigint>", "update", GroupStateTimeout.NoTimeout)
