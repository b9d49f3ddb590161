"""Running sums over numbered parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1000  # parts in one span


def before_part(sums: DataFrame, keys: list[str], part: str, n: str, width: int = WIDTH) -> DataFrame:
    """keys, part and ``offset``: the sum of ``n`` over all earlier parts of the same keys (nulls count as 0).

    ``sums`` has one row for each part. Spans of ``width`` parts are added up first, so that the window over
    all of a key sees one row for each span.
    """
    own = Window.partitionBy(*keys, "_span").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("_span", F.floor(F.col(part) / F.lit(width)))
    spans = cut.groupBy(*keys, "_span").agg(F.sum(n).alias("_n"))
    carried = spans.select(*keys, "_span", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_carried"))
    within = cut.withColumn("_within", F.coalesce(F.sum(n).over(own), F.lit(0)))
    return within.join(carried, [*keys, "_span"]).select(*keys, part, (F.col("_within") + F.col("_carried")).alias("offset"))
