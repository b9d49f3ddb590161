"""Messages delivered at least once, each kept exactly once (problem 2).

A message can be recognised by its event_id and by its producer's identifier: van, sequence
number and device time. Sequence numbers come from counters, so what a producer has sent
so far is nearly a contiguous range. The operator keeps, per producer, disjoint
ranges of numbers seen; a delivered number outside all ranges is new and is accepted
without looking at any message. Only numbers that are covered already (copies, counters
that restarted, a missing number written as 0) need the exact keyed lookup, and so do the UUIDs that
numbers leave open: of rows whose producer's identifier is malformed, or that differing identifiers share.

Ranges are cut at multiples of ``BLOCK``, so that the ranges of a busy producer lie in many
independent groups and no group outgrows ``BLOCK`` numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.operators.components import connected_components
from fleetloom.session import micros, staged

BLOCK = 65_536
NEVER = 2**63 - 1  # arrival of a row without ingestion time: after all others
RANGES = "van_id string, block bigint, lo bigint, hi bigint, suspects array<bigint>"


def with_uuid(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the 16 bytes of the UUID that a text denotes, however written; null for none or the nil UUID.

    Case, white space, hyphens, braces and the prefix ``urn:uuid:`` don't matter. A text that
    isn't 32 hexadecimal digits then denotes nothing. The steps are columns of their own,
    so that each is worked out once for a row.
    """
    text, plain, bare, key = F.col(column), F.col("_plain"), F.col("_bare"), F.col("_key")
    # nearly all ids are in the common form, which takes one replacement to read
    common = (F.octet_length(text) == 36) & (F.octet_length(plain) == 32)
    return (
        rows.withColumn("_plain", F.replace(text, F.lit("-")))
        .withColumn("_bare", F.when(common, plain).otherwise(F.translate(F.lower(text), "{}- \t\r\n", "")))
        .withColumn("_bare", F.when(bare.startswith("urn:uuid:"), F.substring(bare, 10, 100)).otherwise(bare))
        .withColumn("_key", F.unhex(F.when(F.octet_length(bare) == 32, bare)))
        .withColumn(name, F.when((F.octet_length(key) == 16) & (key != F.unhex(F.lit("0" * 32))), key))
        .drop("_plain", "_bare", "_key")
    )


def message_rows(log: DataFrame) -> DataFrame:
    """The columns that identify and order messages; ``node`` orders rows by arrival.

    Rows without record_id can't be told apart or kept, and are left out.
    """
    rows = log.where(F.col("record_id").isNotNull()).select(
        F.struct(F.coalesce(micros("ingestion_timestamp"), F.lit(NEVER)).alias("at"), F.col("record_id").alias("id")).alias("node"),
        "batch_id",
        "van_id",
        F.col("sequence_number").alias("seq"),
        micros("device_timestamp").alias("device_us"),
        "event_id",
    )
    return with_uuid(rows, "event_id", "uuid").drop("event_id")


def has_producer_id() -> Column:
    return F.col("van_id").isNotNull() & F.col("seq").isNotNull() & F.col("device_us").isNotNull()


def advance_ranges(batch: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """Admit one batch against the ranges seen so far.

    ``batch`` has van_id, seq and device_us; ``ranges`` is the result of the batch before,
    or None. Returns the new ranges; ``suspects`` are this batch's numbers in a
    range that were already covered or came more than once, to be looked up
    exactly. Every other number of the batch is accepted.
    """
    numbers = (
        batch.where(has_producer_id())
        .groupBy("van_id", "seq")
        .agg(F.count("*").alias("n"))  # combined before the shuffle: a hot number is one row per task
        .select("van_id", F.floor(F.col("seq") / F.lit(BLOCK)).alias("block"), F.col("seq").alias("lo"), F.col("seq").alias("hi"), "n")
    )
    if ranges is not None:
        numbers = numbers.unionByName(ranges.select("van_id", "block", "lo", "hi", F.lit(0).cast("bigint").alias("n")))
    before = Window.partitionBy("van_id", "block").orderBy("lo", "n").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("van_id", "block").orderBy("lo", "n").rowsBetween(Window.unboundedPreceding, 0)
    marked = numbers.withColumn("reach", F.max("hi").over(before))
    opens = F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1), 1).otherwise(0)
    suspect = (F.col("n") > 1) | ((F.col("n") > 0) & (F.col("reach") >= F.col("lo")))
    return (
        marked.withColumn("island", F.sum(opens).over(upto))
        .groupBy("van_id", "block", "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.when(suspect, F.col("lo"))).alias("suspects"))
        .select("van_id", "block", "lo", "hi", "suspects")
    )


def seen_ranges(rows: DataFrame, rounds: int) -> list[DataFrame]:
    """The states after each of ``rounds`` groups of delivery batches, in order of batch_id (null last)."""
    low, high = rows.agg(F.min("batch_id"), F.max("batch_id")).first()
    if low is None or rounds < 2:
        return [staged(advance_ranges(rows, None), "ranges")]
    states: list[DataFrame] = []
    for k in range(rounds):
        since, until = low + (high - low + 1) * k // rounds, low + (high - low + 1) * (k + 1) // rounds
        here = (F.col("batch_id") >= since) & (F.col("batch_id") < until)
        if k == rounds - 1:
            here = here | F.col("batch_id").isNull()
        states.append(staged(advance_ranges(rows.where(here), states[-1] if states else None), "ranges"))
    return states


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of groups of more than one row that are equal in ``keys``, with the group's first row as ``root``."""
    firsts = rows.groupBy(*keys).agg(F.min("node").alias("root"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(firsts, list(keys)).select("node", "root")


def open_uuids(rows: DataFrame) -> DataFrame:
    """Hashes of the UUIDs that producers' numbers leave open: ``h``.

    A UUID whose rows all have one and the same van, number and time needs no lookup of its own, as those rows are one message
    already; nor does one that a single row has. What is left are UUIDs of rows with a malformed producer's identifier,
    and any that differing identifiers share. Only hashes are compared here, combined to one row each; a chance
    meeting of two hashes costs a lookup and decides nothing.
    """
    # a row without a producer's identifier is like no other
    who = F.when(has_producer_id(), F.xxhash64("van_id", "seq", "device_us")).otherwise(F.xxhash64("node.at", "node.id", F.lit("alone")))
    hashed = rows.where(F.col("uuid").isNotNull()).select(F.xxhash64("uuid").alias("h"), who.alias("who"))
    return hashed.groupBy("h").agg(F.min("who").alias("a"), F.max("who").alias("b")).where("a != b").select("h")


def duplicates(log: DataFrame, rounds: int = 3) -> DataFrame:
    """Every row that is a later copy of a message: record_id and the record_id ``kept_id`` of the row kept.

    ``log`` has record_id, batch_id, event_id, van_id, sequence_number, device_timestamp and
    ingestion_timestamp; other columns are ignored. Rows are one message if their event_ids
    denote the same UUID, or if van, number and device time are present and equal, or through
    a chain of such rows. The earliest ingestion is kept (null last, then the least
    record_id). Rows without any identifier are never copies. An empty log has none.

    The delivery batches are taken in ``rounds`` groups, each admitted against the ranges that
    the groups before left.
    """
    rows = staged(message_rows(log), "messages")  # read several times, and much narrower than the log
    suspects = reduce(DataFrame.union, [s.select("van_id", F.explode("suspects").alias("seq")) for s in seen_ranges(rows, rounds)]).distinct()
    produced = rows.where(has_producer_id()).select("node", "van_id", "seq", "device_us").join(suspects, ["van_id", "seq"], "left_semi")
    # written, so that its size is known when the join is planned: a short list is broadcast, a long one isn't
    asked = staged(open_uuids(rows), "open-uuids").withColumnRenamed("h", "_h")
    named = rows.where(F.col("uuid").isNotNull()).select("node", "uuid").join(asked, F.xxhash64("uuid") == F.col("_h"), "left_semi")
    members = _groups(produced, "van_id", "seq", "device_us").union(_groups(named, "uuid"))
    # A row is in at most two groups. Where their first rows differ, the groups are one message.
    labelled = staged(members.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "members")
    merged = connected_components(labelled.where("lo != hi").select(F.col("hi").alias("a"), F.col("lo").alias("b")))
    return (
        labelled.join(merged.select(F.col("a").alias("lo"), F.col("b").alias("least")), "lo", "left")
        .select("node", F.coalesce("least", "lo").alias("kept"))
        .where("node != kept")
        .select(F.col("node.id").alias("record_id"), F.col("kept.id").alias("kept_id"))
    )


def exactly_once(log: DataFrame, rounds: int = 3) -> DataFrame:
    """The log with one row for each message, all columns kept (rows without record_id are left out)."""
    return log.where(F.col("record_id").isNotNull()).join(duplicates(log, rounds).select("record_id"), "record_id", "left_anti")
