"""Messages kept exactly once while batches of deliveries arrive (problem 2 as a stream).

What is held between batches are each producer's ranges of seen numbers, the keys of the messages that were delivered, and
the messages themselves. A number outside the ranges is new without a lookup; keys are looked up only for
numbers inside and for event ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.operators.exactly_once import RANGES, advance_ranges, duplicates, has_producer_id, message_rows
from fleetloom.session import staged
from fleetloom.sources.tables import StoredTable

KEYS = "uuid binary, van_id string, seq bigint, device_us bigint"


class MessageStore:
    """A table of messages that takes each batch of deliveries once, and each message once.

    Of copies in one batch the first ingested is kept; a message that an earlier batch delivered stays as it was. A
    delivery that joins two messages that were both kept before doesn't take one of them back: that is what the
    batch operator is for.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, query: str = "messages"):
        self.query = query
        self.messages = StoredTable(spark, f"{path}/messages", schema)
        self.keys = StoredTable(spark, f"{path}/keys", KEYS)
        self.ranges = StoredTable(spark, f"{path}/ranges", RANGES)

    def take(self, batch: DataFrame, number: int) -> None:
        """Add a batch of deliveries (columns as for ``duplicates``). A batch that is repeated changes nothing."""
        batch = staged(batch.where(F.col("record_id").isNotNull()), "delivered")
        rows = staged(message_rows(batch), "delivered-keys")
        ranges = staged(advance_ranges(rows, self.ranges.read()), "ranges")
        suspects = ranges.select("van_id", F.explode("suspects").alias("seq")).distinct()
        held = self.keys.read()
        numbered = rows.where(has_producer_id()).join(suspects, ["van_id", "seq"], "left_semi")
        known = numbered.join(held, ["van_id", "seq", "device_us"], "left_semi").select(F.col("node.id").alias("record_id")).union(
            rows.join(held.where("uuid is not null"), "uuid", "left_semi").select(F.col("node.id").alias("record_id"))
        )
        # if one copy in the batch is known, the whole message is
        copies = staged(duplicates(batch, rounds=1), "copies")
        message = F.coalesce("kept_id", "record_id").alias("record_id")
        old = known.distinct().join(copies, "record_id", "left").select(message)
        gone = copies.select("record_id").union(old).distinct()
        self.messages.append(batch.join(gone, "record_id", "left_anti"), (self.query, number))
        fresh = rows.select("uuid", *[F.when(has_producer_id(), F.col(c)).alias(c) for c in ("van_id", "seq", "device_us")])
        self.keys.append(fresh.where("uuid is not null or van_id is not null").distinct(), (self.query, number))
        self.ranges.replace(ranges, (self.query, number))
