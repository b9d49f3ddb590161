"""Exact percentiles without a group's values in one task.

A summary of bounded size tells, with a certain error, between which two values a percentile lies; one more pass counts
what is below, and only the values between are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # the summary's rank is off by at most this part of all rows; about four such parts are put in order


def exact_percentiles(rows: DataFrame, key: str, value: str, percentiles: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """key, n and one column for each of ``percentiles`` (name: share), linear between neighbouring values.

    Nulls and NaN of ``value`` don't count; a key without any value has no row. A null key is a key. Equal values are combined before
    they are moved. ``rows`` is read twice.
    """
    rows = rows.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    names, shares = list(percentiles), [float(q) for q in percentiles.values()]
    low, high = [max(0.0, q - 2 / accuracy) for q in shares], [min(1.0, q + 2 / accuracy) for q in shares]
    bounds = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.percentile_approx("_v", low, accuracy).alias("_low"), F.percentile_approx("_v", high, accuracy).alias("_high"))
    near = rows.join(bounds.withColumnRenamed("_k", "_b"), F.col("_k").eqNullSafe(F.col("_b"))).drop("_b")
    # Between the bounds: by value. Below and above: combined to one row per key and share, with the value next to the bound, as
    # in a short group a rank can lie one place outside.
    kind = lambda i: F.when(F.col("_v") < F.col("_low")[i], 0).when(F.col("_v") <= F.col("_high")[i], 1).otherwise(2)
    place = lambda i: F.struct(F.lit(i).alias("i"), kind(i).alias("kind"), F.when(kind(i) == 1, F.col("_v")).alias("v"), F.col("_v").alias("own"))
    placed = near.select("_k", "_n", F.explode(F.array(*[place(i) for i in range(len(shares))])).alias("p")).select("_k", "_n", "p.*")
    counted = placed.groupBy("_k", "_n", "i", "kind", "v").agg(F.count("*").alias("c"), F.max("own").alias("most"), F.min("own").alias("least"))
    upto = F.sum("c").over(Window.partitionBy("_k", "i").orderBy("kind", "v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).withColumn("v", F.when(F.col("kind") == 0, F.col("most")).otherwise(F.col("least")))
    out = []
    for i, (name, q) in enumerate(zip(names, shares)):
        rank = (F.col("_n") - 1) * F.lit(q)
        at = lambda r, i=i: F.min(F.when((F.col("i") == i) & (F.col("upto") > r), F.col("v")))
        a, b = at(F.floor(rank)), at(F.ceil(rank))
        out.append((a + (b - a) * (F.first((F.col("_n") - 1) * F.lit(q)) - F.floor(F.first((F.col("_n") - 1) * F.lit(q))))).alias(name))
    return ranked.groupBy("_k").agg(F.first("_n").alias("n"), *out).withColumnRenamed("_k", key)
