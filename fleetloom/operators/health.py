"""Rolling health of a pipeline out of counters that only grow, and alert rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the report.
WINDOW_S, SAMPLE_S = 300, 15
MOST_REJECTED, MOST_SILENT, LEAST_DISK = 0.20, 0.05, 0.15
COUNTERS = ("received", "processed", "rejected")


def deltas(samples: DataFrame, counters: tuple[str, ...], window_s: int = WINDOW_S, key: str | None = None) -> DataFrame:
    """Each sample with the growth of its counters over the window that ends with it, and the seconds it spans.

    ``samples`` has at_s and the counters. The newest sample at or before the window's start is its base, if there
    is one, so that a window is as long as it says; else the oldest within.
    """
    keys = [key] if key else []
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy("at_s")
    upto = w.rangeBetween(Window.unboundedPreceding, -window_s)
    inside = w.rangeBetween(-window_s, 0)
    out = samples.withColumn("window_s", F.col("at_s") - F.coalesce(F.last("at_s").over(upto), F.first("at_s").over(inside)))
    for c in counters:
        out = out.withColumn(f"d_{c}", F.col(c) - F.coalesce(F.last(c).over(upto), F.first(c).over(inside)))
    return out


def report(samples: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Status, rates and problems at each sample.

    ``samples`` has at_s, received, processed, rejected (since the start), vans, silent_vans and disk_free (a share). Until a window
    is half full the status is WARMING_UP, unless there is a problem.
    """
    d = deltas(samples, COUNTERS, window_s)
    rejected = F.when(F.col("d_received") > 0, F.col("d_rejected") / F.col("d_received")).otherwise(0.0)
    silent = F.when(F.col("vans") > 0, F.col("silent_vans") / F.col("vans")).otherwise(0.0)
    problems = F.array_compact(
        F.array(
            F.when(rejected > MOST_REJECTED, F.format_string("rejection rate %.1f%%", rejected * 100)),
            F.when((F.col("d_received") > 0) & (F.col("d_processed") == 0), "pings arrive but none is processed"),
            F.when((F.col("d_received") == 0) & (F.col("window_s") >= window_s), "no pings arrive"),
            F.when(F.col("disk_free") < LEAST_DISK, F.format_string("disk free %.1f%%", F.col("disk_free") * 100)),
            F.when(silent > MOST_SILENT, F.format_string("%d of %d vans are silent", F.col("silent_vans"), F.col("vans"))),
        )
    )
    status = F.when(F.size(problems) > 0, "DEGRADED").when(F.col("window_s") < window_s / 2, "WARMING_UP").otherwise("OK")
    one = lambda v: F.floor(v * 10 + 0.5) / 10
    return d.select(
        "at_s", status.alias("status"), "window_s", one(rejected * 100).alias("rejected_pct"),
        one(F.when(F.col("window_s") > 0, F.col("d_received") / F.col("window_s")).otherwise(0.0)).alias("received_per_s"), problems.alias("problems"),
    )


def held_for(samples: DataFrame, on: Column, for_s: int, name: str, key: str | None = None) -> DataFrame:
    """Samples with a flag: the condition has held at every sample over the last ``for_s`` seconds, and for that long."""
    w = Window.partitionBy(*[key] if key else [F.lit(0)]).orderBy("at_s")
    span = w.rangeBetween(-for_s, 0)
    old_enough = F.first("at_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("at_s") - for_s
    return samples.withColumn("_on", F.coalesce(on, F.lit(False))).withColumn(name, F.min("_on").over(span) & old_enough).drop("_on")


# The alert rules as counters, window and time to hold, in seconds.
RULES = {
    "dedup_rejection_high": ("d_deduplicated > 0.20 * d_received and d_received > 0", 300, 600),
    "stream_stalled": ("d_received = 0", 300, 300),
    "not_processed": ("d_received > 0 and d_processed = 0", 300, 0),
    "malformed_gps": ("d_malformed > 0", 300, 0),
    "deliveries_dead_lettered": ("d_dead_lettered > 0", 900, 0),
    "archive_dropping": ("d_archive_dropped > 0", 300, 600),
}
ALERT_COUNTERS = ("received", "processed", "deduplicated", "malformed", "dead_lettered", "archive_dropped")


def alerts(samples: DataFrame) -> DataFrame:
    """Firing rules: at_s, rule. ``samples`` has at_s and the counters of ``ALERT_COUNTERS``."""
    out = None
    for name, (condition, window_s, for_s) in RULES.items():
        d = deltas(samples, ALERT_COUNTERS, window_s).withColumn("_full", F.col("window_s") >= window_s)
        on = F.expr(condition) & F.col("_full")
        firing = held_for(d, on, for_s, "firing").where("firing").select("at_s", F.lit(name).alias("rule"))
        out = firing if out is None else out.unionByName(firing)
    return out


def silent_vans(newest: DataFrame, now_ms: Column, after_s: int = 300) -> DataFrame:
    """How many vans there are and how many weren't heard of for a while. ``newest`` has updated_epoch_ms by van."""
    return newest.agg(F.count("*").alias("vans"), F.count_if(F.col("updated_epoch_ms") < now_ms - after_s * 1000).alias("silent_vans"))


def latency_buckets(rows: DataFrame, value: str, bounds: list[float], key: str) -> DataFrame:
    """A cumulative histogram of each key: key, le, n; the last bound is infinite. Nulls aren't counted."""
    ends = [*sorted(bounds), float("inf")]
    counts = rows.where(F.col(value).isNotNull()).groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(ends)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(ends)])
    return counts.select(key, F.explode(pairs).alias("b")).select(key, "b.le", "b.n")


def heard_of(rows: DataFrame, received_ms: str, now_ms: Column, within_s: int = 120) -> DataFrame:
    """Vans that were heard of within a time, by when they were received."""
    return rows.where(F.col(received_ms) >= now_ms - within_s * 1000)


def histogram_quantile(buckets: DataFrame, q: float, key: str) -> DataFrame:
    """A percentile out of cumulative buckets (key, le, n): linear within its bucket, the last finite bound beyond."""
    w = Window.partitionBy(key).orderBy("le")
    total = F.max("n").over(Window.partitionBy(key))
    rows = buckets.withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("from", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("need", total * q)
    hit = rows.where((F.col("n") >= F.col("need")) & (F.col("below") < F.col("need")))
    inf = F.col("le") == float("inf")
    value = F.when(inf, F.col("from")).otherwise(F.col("from") + (F.col("le") - F.col("from")) * (F.col("need") - F.col("below")) / (F.col("n") - F.col("below")))
    return hit.select(key, value.alias("value"))


def pipeline_samples(log: DataFrame, every_s: int = 900) -> DataFrame:
    """Counters of a log of pings at regular times of arrival, as the pipeline would have counted them."""
    from fleetloom.sources.streams import gps_error
    from fleetloom.session import micros

    slot = F.floor(micros("ingestion_timestamp") / F.lit(every_s * 1_000_000)) * every_s
    bad = gps_error().isNotNull()
    counts = log.where("ingestion_timestamp is not null").groupBy(slot.alias("at_s")).agg(F.count("*").alias("received"), F.count_if(~bad).alias("processed"), F.count_if(bad).alias("rejected"))
    w = Window.orderBy("at_s").rowsBetween(Window.unboundedPreceding, 0)  # one row per interval
    return counts.select("at_s", *[F.sum(c).over(w).alias(c) for c in COUNTERS])


def with_silence(samples: DataFrame, log: DataFrame, every_s: int = 900, after_s: int = 300) -> DataFrame:
    """``samples`` of ``pipeline_samples`` with vans, those heard of so far, and silent_vans, those not heard of for a while.

    A van is heard of when a valid ping of it arrives. As the counters, both are those at the end of a sample's interval.
    """
    from fleetloom.sources.streams import gps_error
    from fleetloom.session import micros

    slot = F.floor(micros("ingestion_timestamp") / F.lit(every_s * 1_000_000))
    heard = log.where(F.col("ingestion_timestamp").isNotNull() & gps_error().isNull()).groupBy("van_id", slot.alias("slot")).agg(F.max(micros("ingestion_timestamp")).alias("us"))
    new = heard.groupBy("van_id").agg(F.min("slot").alias("slot")).groupBy((F.col("slot") * every_s).alias("at_s")).agg(F.count("*").alias("_new"))
    until = F.floor((F.col("us") + after_s * 1_000_000) / F.lit(every_s * 1_000_000)) - 1  # the last interval at whose end the van isn't silent
    alive = heard.withColumn("until", until).where("until >= slot").select("van_id", F.explode(F.sequence("slot", "until")).alias("slot"))
    alive = alive.groupBy((F.col("slot") * every_s).alias("at_s")).agg(F.countDistinct("van_id").alias("_alive"))
    w = Window.orderBy("at_s").rowsBetween(Window.unboundedPreceding, 0)  # one row per interval
    out = samples.join(new, "at_s", "left").join(alive, "at_s", "left").withColumn("vans", F.coalesce(F.sum("_new").over(w), F.lit(0)))
    return out.withColumn("silent_vans", F.col("vans") - F.coalesce("_alive", F.lit(0))).drop("_new", "_alive")
