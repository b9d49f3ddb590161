"""Documents packed into containers of fixed capacity (problem 7).

Items of more than the capacity are cut into full containers and a rest; nothing else is
split. Large items go by linear grouping (Fernandez de la Vega and Lueker): sorted by size, cut
into groups of equal number, and rounded up to the largest size of their group. For the few
sizes that are left, configurations (how many of each size share a container) are optimised
by column generation on the linear programme. Actual items then take the places of
the rounded ones, and small items are put, best fit, into the space that is left.

The plan is made on the driver from a histogram, which has at most one row for each size up to
the capacity, however many items there are. Numbering the items of a group, giving them
their containers and filling the space are distributed, and split by hash, so no
group of items is ever in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.llm.offsets import before_part
from fleetloom.operators.grouped import whole_groups
from fleetloom.session import staged

CAPACITY = 2048
GROUPS = 48
SMALL = 8  # an item of at most a capacity-th of this is small
PART_ROWS = 50_000  # small items that one task fills in at a time


def patterns(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used, so that every demand is met.

    The linear relaxation of cutting stock is solved by column generation; it is rounded down, and
    what it leaves is packed best fit decreasing. Sizes are at most ``capacity``.
    """
    m = len(sizes)
    if not m:
        return []
    size, need = np.array(sizes), np.array(demand, float)
    columns = [np.eye(m)[k] * max(1, capacity // sizes[k]) for k in range(m)]
    basis = np.column_stack(columns)
    inverse = np.diag(1 / np.diag(basis))
    level = inverse @ need
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # every container costs one
        column, worth = _best_column(price, size, need, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[out] = column
        inverse = np.linalg.inv(np.column_stack(columns))
        level = np.maximum(0, inverse @ need)
    made: dict[tuple[int, ...], int] = {}
    rest = np.array(demand, dtype=np.int64)
    for column, n in sorted(zip(columns, level), key=lambda c: -c[1]):
        column = column.astype(np.int64)
        times = int(min([int(np.floor(n + 1e-7)), *(int(rest[k] // column[k]) for k in np.flatnonzero(column))]))
        if times > 0:
            made[tuple(column.tolist())] = made.get(tuple(column.tolist()), 0) + times
            rest -= column * times
    for counts in _best_fit([k for k in np.argsort(-size) for _ in range(int(rest[k]))], sizes, capacity):
        key = tuple(counts.get(k, 0) for k in range(m))
        made[key] = made.get(key, 0) + 1
    return list(made.items())


def _best_column(price: np.ndarray, size: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable configuration that fits: an unbounded knapsack, an item's copies added one at a time."""
    useful = [k for k in range(len(size)) if price[k] > 1e-12 and need[k] > 0]
    value = np.zeros(capacity + 1)  # of the best that a capacity holds, space left over or not
    for k in useful:
        w, p = int(size[k]), price[k]
        for _ in range(capacity // w):
            better = value[:-w] + p
            if not (better > value[w:] + 1e-12).any():
                break
            value[w:] = np.maximum(value[w:], better)
    column, c = np.zeros(len(size)), capacity
    weights, prices = np.array([int(size[k]) for k in useful], int), np.array([price[k] for k in useful])
    while c > 0 and value[c] > 1e-9:
        rest = c - weights
        fits = np.where(rest >= 0, np.abs(value[np.maximum(rest, 0)] + prices - value[c]), np.inf)
        k = int(fits.argmin())
        if fits[k] > 1e-9:
            c -= 1
            continue
        column[useful[k]] += 1
        c = int(rest[k])
    return column, float(value[capacity])


def _best_fit(items: list[int], sizes: list[int], capacity: int) -> list[dict[int, int]]:
    """Best fit, in the given order; at most a few items for each size get here."""
    room: list[tuple[int, int]] = []
    out: list[dict[int, int]] = []
    for k in items:
        at = bisect_left(room, (sizes[k], -1))
        left, b = room.pop(at) if at < len(room) else (capacity, len(out))
        if b == len(out):
            out.append({})
        out[b][k] = out[b].get(k, 0) + 1
        insort(room, (left - sizes[k], b))
    return out


def linear_groups(histogram: list[tuple[int, int]], groups: int) -> list[tuple[int, int, int]]:
    """Groups of about equally many items: least size, largest size, number. Equal sizes stay together."""
    total, out, held = sum(n for _, n in histogram), [], []
    for size, n in sorted(histogram):
        held.append((size, n))
        if sum(c for _, c in held) * groups >= total:
            out.append((held[0][0], size, sum(c for _, c in held)))
            held = []
    return out + ([(held[0][0], held[-1][0], sum(c for _, c in held))] if held else [])


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Items cut to pieces of at most the capacity: key, piece_no, start, n. An item of no size has no piece."""
    rows = items.where((F.col(size) > 0) & F.col(key).isNotNull()).select(F.col(key), F.col(size).alias("whole"))
    cut = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("whole") - 1) / F.lit(capacity)))))
    start = F.col("piece_no") * capacity
    return cut.select(key, "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("whole") - start).cast("bigint").alias("n"))


def _ranked(rows: DataFrame, group: str, parts: int, *order: Column | str) -> DataFrame:
    """Rows with a number ``rank`` from 0 within their group, without gaps, worked out in ``parts`` parts of each group."""
    spread = staged(rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts))), "ranked")
    # one row for each group and part
    sizes = spread.groupBy(group, "part").agg(F.count("*").alias("rows"))
    offset = before_part(sizes, [group], "part", "rows")
    inner = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    return spread.withColumn("inner", inner).join(offset, [group, "part"]).withColumn("rank", F.col("offset") + F.col("inner") - 1).drop("inner", "offset", "part")


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Containers for items: container_id, key, piece_no, start, n (the piece's first unit and its length).

    Every piece is in exactly one container, and no container holds more than ``capacity``. Items with
    a null key, or null or no size, take no space and have no row. Rows that are equal are
    several items. An empty table needs no container.
    """
    spark = items.sparkSession
    cut = staged(pieces(items, key, size, capacity), "pieces")
    histogram = [(int(r.n), int(r.rows)) for r in cut.groupBy("n").agg(F.count("*").alias("rows")).collect()]  # at most ``capacity`` rows
    small = max(1, capacity // SMALL)
    whole = sum(c for n, c in histogram if n == capacity)
    grouped = linear_groups([(n, c) for n, c in histogram if small < n < capacity], groups)
    plan = patterns([g[1] for g in grouped], [g[2] for g in grouped], capacity)
    parts = max(1, sum(c for _, c in histogram) // PART_ROWS)

    # places: container numbers of each group, in order
    rows, first = [], 0
    for p, (counts, times) in enumerate(plan):
        rows += [(g, first, times, c, sum(c2 * t2 for (cs, t2) in plan[:p] for c2 in (cs[g],))) for g, c in enumerate(counts) if c]
        first += times
    runs = spark.createDataFrame(rows or [], "grp int, first bigint, times bigint, each bigint, rank0 bigint")
    bounds = spark.createDataFrame([(g, lo, hi) for g, (lo, hi, _) in enumerate(grouped)], "grp int, lo bigint, hi bigint")
    large = cut.where((F.col("n") > small) & (F.col("n") < capacity)).join(F.broadcast(bounds), F.col("n").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    numbered = _ranked(large, "grp", parts, F.col(key), F.col("piece_no"))
    # a run of one pattern gives its group times * each places: a range join with few runs (groups * patterns)
    runs = runs.withColumnRenamed("grp", "g")
    at = F.col("rank") - F.col("rank0")
    placed = numbered.join(
        F.broadcast(runs), (F.col("grp") == F.col("g")) & (at >= 0) & (at < F.col("times") * F.col("each"))
    ).select((F.col("first") + F.floor(at / F.col("each"))).alias("container_id"), key, "piece_no", "start", "n")

    full = _ranked(cut.where(F.col("n") == capacity).withColumn("one", F.lit(0)), "one", parts, F.col(key), F.col("piece_no"))
    full = full.select((F.col("rank") + first).alias("container_id"), key, "piece_no", "start", "n")
    placed = staged(placed, "placed")

    # space that is left, and small pieces, spread alike over parts
    room = placed.groupBy("container_id").agg((F.lit(capacity) - F.sum("n")).alias("room"))
    fill = (
        room.select(F.pmod(F.xxhash64("container_id"), F.lit(parts)).alias("part"), F.lit(0).alias("kind"), F.col("container_id").alias("id"), F.lit(None).cast("bigint").alias("piece_no"),
                    F.lit(None).cast("bigint").alias("start"), F.col("room").alias("n"))
    )
    kind = cut.schema[key].dataType.simpleString()
    tiny = cut.where(F.col("n") <= small).select(
        F.pmod(F.xxhash64(key, "piece_no"), F.lit(parts)).alias("part"), F.lit(1).alias("kind"), F.col(key).cast("string").alias("item"), "piece_no", "start", "n"
    )
    both = fill.select("part", "kind", F.col("id").cast("bigint").alias("id"), F.lit(None).cast("string").alias("item"), "piece_no", "start", "n").unionByName(
        tiny.withColumn("id", F.lit(None).cast("bigint"))
    )

    def best_fit(f: pd.DataFrame) -> pd.DataFrame:
        """Small items, largest first, each into the container that it fills best; new containers are numbered within the part."""
        f = f.sort_values(["part", "kind", "n", "item", "piece_no"], ascending=[True, True, False, True, True], kind="stable")
        out = []
        for part, own in f.groupby("part", sort=False):
            boxes = own[own["kind"] == 0]
            space = sorted(zip(boxes["n"].tolist(), boxes["id"].tolist()))
            fresh = 0
            rows = own[own["kind"] == 1]
            for item, no, start, n in zip(rows["item"], rows["piece_no"].tolist(), rows["start"].tolist(), rows["n"].tolist()):
                at = bisect_left(space, (n, -(2**62)))
                if at < len(space):
                    left, box = space.pop(at)
                else:
                    fresh += 1
                    left, box = capacity, -fresh
                if left > n:
                    insort(space, (left - n, box))
                out.append((part, box, item, int(no), int(start), int(n)))
        return pd.DataFrame(out, columns=["part", "box", "item", "piece_no", "start", "n"])

    filled = both.repartition("part").sortWithinPartitions("part").mapInPandas(
        lambda frames: whole_groups(frames, ["part"], best_fit), "part bigint, box bigint, item string, piece_no bigint, start bigint, n bigint"
    )
    filled = staged(filled, "filled")
    fresh = filled.where("box < 0").groupBy("part").agg((-F.min("box")).alias("made"))  # one row for each part
    offset = before_part(fresh, [], "part", "made")
    box = F.when(F.col("box") >= 0, F.col("box")).otherwise(F.lit(first + whole - 1) + F.col("offset") - F.col("box"))
    filled = filled.join(offset, "part", "left").select(box.alias("container_id"), F.col("item").cast(kind).alias(key), "piece_no", "start", "n")
    return placed.unionByName(full).unionByName(filled)
