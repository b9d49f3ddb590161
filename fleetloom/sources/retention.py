"""Old rows taken out of the stored tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators import tables as ops
from fleetloom.sources.tables import KeyedTable, StoredTable


@dataclass(frozen=True)
class Ages:
    """How old rows get."""

    archive: timedelta = timedelta(hours=6)
    letters: timedelta = timedelta(days=2)
    history: timedelta = timedelta(days=7)


def _drain(table: StoredTable, kept: DataFrame, gone: int) -> int:
    if gone:  # a table without old rows isn't rewritten
        table.replace(kept)
    return gone


def run_once(now: datetime, archive: StoredTable | None = None, letters: StoredTable | None = None, logs: StoredTable | None = None, breaches: StoredTable | None = None, routes: KeyedTable | None = None, ages: Ages = Ages(), archive_at: str = "device_timestamp") -> dict[str, int]:
    """One pass over the tables given: how many rows each lost.

    Rows without a time stay. A route goes, after its deliveries, once it is old and nothing that is kept refers to it. Tables are
    files here, so deleting is one rewrite without batches; for a database ``tables.expired_batch`` gives them.
    """
    out: dict[str, int] = {}
    for name, table, at, age in (("archive", archive, archive_at, ages.archive), ("letters", letters, "created_at", ages.letters), ("breaches", breaches, "detected_at", ages.history), ("logs", logs, "created_at", ages.history)):
        if table is not None:
            cutoff, rows = F.lit(now - age), table.read()
            out[name] = _drain(table, ops.retained(rows, at, cutoff), ops.expired(rows, at, cutoff).count())
    if routes is not None:
        rows, old = routes.read(), ops.expired(routes.read(), "created_at", F.lit(now - ages.history))
        for child in (logs, breaches):
            if child is not None:
                old = old.join(child.read().select("route_id"), "route_id", "left_anti")
        out["routes"] = _drain(routes.table, ops.without(rows, old, "route_id").withColumn("_version", F.lit(0).cast("bigint")), old.count())
    return out
