"""Sources mixed to target weights (problem 8).

Each source is a stream of blocks of tokens. As in Pfair scheduling (Baruah, Cohen, Plaxton and
Varvel), block j of a source with weight w is released at (j - 1) / w and due at j / w, and of
the released blocks the one due first is taken next. Up to any slot, each source has
had its share to within less than one block.

The weights are integers over a common denominator H: the targets' own, where that is at most a
million, else parts in a million (more if a target or the number of sources asks for it). The schedule then repeats
every H slots, so only one period is worked out, on the driver (H entries, whatever the
corpus); the slot of any block follows by arithmetic. Positions in a source's stream are running
sums of tokens, worked out in parts of each source, so that a large source is never in one task.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush
from math import ceil, gcd, isfinite, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.llm.offsets import before_part
from fleetloom.session import staged

DENOMINATOR = 1_000_000  # the longest period, if targets and number of sources don't need a longer one
BLOCK_TOKENS = 8192
PART_TOKENS = 20_000_000  # about as many tokens are added up in one part of a source


def canonical_source(col: Column | str) -> Column:
    """One spelling: lower case, words joined by one underscore; null for null and blank."""
    name = F.regexp_replace(F.lower(F.trim(col)), r"[\s_-]+", "_")
    return F.when(name.rlike("[a-z0-9]"), name)


def integer_weights(shares: dict[str, float], denominator: int = DENOMINATOR) -> tuple[dict[str, int], int]:
    """Weights as integers that sum to H; shares needn't sum to 1, and those that aren't positive are left out.

    The shares are read as decimals and kept exactly if their common denominator is at most ``denominator``. Else they are
    rounded, by largest remainder, to parts of H: ``denominator``, or as many as make each
    source at least ten parts, so that no target moves by more than a twentieth of the least one.
    """
    exact = {s: Fraction(str(w)) for s, w in shares.items() if w and w > 0 and isfinite(w)}
    if not exact:
        return {}, 0
    total = sum(exact.values())
    part = {s: w / total for s, w in exact.items()}
    period = lcm(*(w.denominator for w in part.values()))
    if period <= denominator:
        return {s: int(w * period) for s, w in part.items()}, period
    period = max(denominator, ceil(10 / min(part.values())))
    whole = {s: int(w * period) for s, w in part.items()}
    for s in sorted(part, key=lambda s: (int(part[s] * period) - part[s] * period, s))[: period - sum(whole.values())]:
        whole[s] += 1
    common = gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}, period // common


def schedule(weights: dict[str, int]) -> list[str]:
    """One period of slots: of the blocks that are released, the one that is due first."""
    period = sum(weights.values())
    waiting = [(0, s, 1) for s in weights]  # release, source, block
    waiting.sort()
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heappop(waiting)
            due = -(-j * period // weights[s])
            # of two due at once, the one whose next window overlaps goes first
            heappush(ready, (due, 0 if j * period % weights[s] else 1, s, j))
        _, _, s, j = heappop(ready)
        out.append(s)
        if j < weights[s]:
            heappush(waiting, (j * period // weights[s], s, j + 1))
    return out


def _slots(weights: dict[str, int]) -> pa.Table:
    """One period as a table: the source of each slot, which of the source's blocks it is, and the source's weight."""
    names = list(weights)
    number = {s: k for k, s in enumerate(names)}
    slots = np.array([number[s] for s in schedule(weights)], np.int64)
    order = np.argsort(slots, kind="stable")
    nth = np.empty(len(slots), np.int64)
    nth[order] = np.arange(len(slots)) - np.searchsorted(slots[order], slots[order])
    each = np.array([weights[s] for s in names] or [0], np.int64)[slots]
    return pa.table({"s": pa.array(np.array(names or [""], dtype=object)[slots], pa.string()), "slot_in_period": np.arange(len(slots)), "block_in_period": nth, "weight": each})


def mixture(documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", source: str = "source", tokens: str = "tokens", block_tokens: int = BLOCK_TOKENS, total: int | None = None) -> DataFrame:
    """The mixture: slot, source, position, repeat_no, key, tokens; in reading order by slot, then position.

    ``documents`` has key, source (in any spelling) and tokens; ``targets`` has source, target_share and
    max_repeats. The mixture has ``total`` tokens, by default as many as the sources allow when each is used at
    most max_repeats times: every source then reaches its share, up to its last document. With
    a larger ``total``, sources that run out fall short. Documents are taken in a fixed
    shuffled order, all once before any again. Documents without tokens, key or a targeted
    source aren't used; a source without documents but with a target makes the default
    mixture leave it out, and its share goes to the others.
    """
    spark = documents.sparkSession
    goals = {r.source: r for r in targets.select(canonical_source("source").alias("source"), "target_share", "max_repeats").collect() if r.source}
    rows = documents.where(F.col(key).isNotNull() & (F.col(tokens) > 0)).select(canonical_source(source).alias("source"), F.col(key), F.col(tokens).cast("bigint").alias("tokens"))
    rows = staged(rows.where(F.col("source").isin(list(goals))), "mixed")
    size = {r.source: int(r.n) for r in rows.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    usable = {s: g for s, g in goals.items() if size.get(s) and (g.target_share or 0) > 0 and (g.max_repeats or 0) > 0}
    weights, period = integer_weights({s: g.target_share for s, g in usable.items()})
    schema = "s string, slot_in_period bigint, block_in_period bigint, weight bigint"
    if total is None:
        total = min((size[s] * int(usable[s].max_repeats) * period // weights[s] for s in weights), default=0)
    quota = {s: min(total * weights[s] // period, size[s] * int(usable[s].max_repeats)) for s in weights}
    slots = spark.createDataFrame(_slots(weights), schema)
    # a source whose quota is 0 has no round
    limits = spark.createDataFrame(
        [(s, n, size[s], -(-n // size[s]), max(1, size[s] // PART_TOKENS)) for s, n in quota.items() if n > 0], "source string, quota bigint, size bigint, rounds bigint, parts bigint"
    )
    shuffled = F.xxhash64(F.col(key), F.lit("order"))
    known = staged(rows.join(F.broadcast(limits), "source").withColumn("at", shuffled).withColumn("part", F.pmod(F.shiftright("at", 8), F.col("parts"))), "mixed")
    sums = known.groupBy("source", "part").agg(F.sum("tokens").alias("n"))  # one row for each part
    offsets = before_part(sums, ["source"], "part", "n")
    inner = Window.partitionBy("source", "part").orderBy("at", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(offsets, ["source", "part"])
    placed = placed.withColumn("repeat_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rounds"))))
    position = (F.col("repeat_no") - 1) * F.col("size") + F.col("offset") + F.col("inner")
    # a document is taken if most of it lies within the quota: shares are off by at most half a document
    placed = placed.withColumn("position", position).where(F.col("position") + F.floor(F.col("tokens") / F.lit(2)) < F.col("quota"))
    block = F.floor(F.col("position") / F.lit(block_tokens))
    placed = placed.withColumn("block", block)
    # a period has at most as many rows as parts of a share; adaptive execution broadcasts a short one
    placed = placed.join(slots, (F.col("source") == F.col("s")) & (F.col("block_in_period") == F.pmod(F.col("block"), F.col("weight"))))
    slot = F.floor(F.col("block") / F.col("weight")) * F.lit(period) + F.col("slot_in_period")
    return placed.select(slot.cast("bigint").alias("slot"), "source", "position", "repeat_no", key, "tokens")


def report(mixed: DataFrame, documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", source: str = "source", tokens: str = "tokens") -> DataFrame:
    """What each source really contributes: target and actual share, tokens, uses, documents used and at hand, most uses of one.

    Sources without a target have no target_share and no actual tokens; documents without a source
    are under the null source.
    """
    uses = mixed.groupBy("source", key).agg(F.count("*").alias("uses"), F.sum("tokens").alias("used"))
    got = uses.groupBy("source").agg(F.sum("used").alias("mixed_tokens"), F.sum("uses").alias("uses"), F.count("*").alias("documents_used"), F.max("uses").alias("most_uses"))
    at_hand = documents.groupBy(canonical_source(source).alias("source")).agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens"))
    goals = targets.select(canonical_source("source").alias("source"), "target_share", "max_repeats")
    both = at_hand.join(goals, at_hand["source"].eqNullSafe(goals["source"]), "full").select(
        F.coalesce(at_hand["source"], goals["source"]).alias("source"), "target_share", "max_repeats", "documents", "tokens"
    )
    whole = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    out = both.join(got.withColumnRenamed("source", "s"), F.col("source") == F.col("s"), "left").join(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        "source", "target_share", (F.coalesce("mixed_tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"), zero("mixed_tokens"), zero("uses"),
        zero("documents_used"), zero("most_uses"), "max_repeats", zero("documents"), zero("tokens"),
    )
