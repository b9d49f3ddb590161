"""Running maxima over long ordered groups, worked out block by block.

A window over a whole group puts the group into one task. Here the order is cut into blocks:
one row per block carries the maximum of all blocks before it, and the windows run within
blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max(rows: DataFrame, key: str, at: str, value: Column, name: str, block: int, *ties: str) -> DataFrame:
    """``rows`` with the maximum of ``value`` over all rows of the same key before it in the order of ``at``, then ``ties``.

    ``at`` is a number; ``block`` is the width of a block in it. Nulls of ``value`` don't count; null where nothing
    comes before.
    """
    cut = rows.withColumn("_v", value).withColumn("_block", F.floor(F.col(at) / F.lit(block)))
    tops = cut.groupBy(key, "_block").agg(F.max("_v").alias("_top"))
    over = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(key, "_block", F.max("_top").over(over).alias("_carried"))
    inner = Window.partitionBy(key, "_block").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, -1)
    within = F.max("_v").over(inner)
    return cut.withColumn("_within", within).join(carried, [key, "_block"]).withColumn(name, F.greatest("_within", "_carried")).drop("_v", "_block", "_within", "_carried")
