"""The cheapest place for a new stop in the planned routes of all vans.

Every position of every van is an option; its cost is the detour, with a surcharge for each
later stop that it makes late and for coming late itself. The option table is as long as all
remaining stops together, for each order; the best is an aggregation, not a sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.geo import haversine_m

# Detour factor of straight lines, seconds at a stop, cost in km of a late stop.
DETOUR, DWELL_S, LATE_KM = 1.3, 40.0, 5.0
BLOCK = 1000  # requests that are sent out at once


def options(orders: DataFrame, vans: DataFrame) -> DataFrame:
    """All insertions: order_id, van_id, k, extra_m, arrival_s, stops_made_late, on_time, cost.

    ``orders`` has order_id, lat, lon, now_s and deadline_s, and is a block of at most some thousand requests (``assignments`` cuts longer lists). ``vans`` has van_id, lat, lon, serving
    (boolean), next (index of the next stop), speed_mps, delay_s, and stops: an array of lat, lon, planned_s and deadline_s,
    followed by hub_lat and hub_lon. A van whose next stop lies past its plan has no option.
    """
    n = F.size("stops")
    positions = vans.where((F.col("next") >= 0) & (F.col("next") <= n)).withColumn("k", F.explode(F.sequence("next", n)))
    stop = lambda i: F.get("stops", i)
    serving, k, first = F.col("serving"), F.col("k"), F.col("k") == F.col("next")
    before = F.when(first & ~serving, F.struct("lat", "lon")).otherwise(F.struct(stop(k - 1)["lat"].alias("lat"), stop(k - 1)["lon"].alias("lon")))
    after = F.when(k < n, F.struct(stop(k)["lat"].alias("lat"), stop(k)["lon"].alias("lon"))).otherwise(F.struct(F.col("hub_lat").alias("lat"), F.col("hub_lon").alias("lon")))
    placed = positions.select("van_id", "k", "next", "serving", "speed_mps", "delay_s", "stops", before.alias("p"), after.alias("q"), stop(k - 1)["planned_s"].alias("planned_before"))
    # every request must meet every position: a block of requests is sent to where the positions are
    both = placed.join(F.broadcast(orders.select("order_id", F.col("lat").alias("olat"), F.col("lon").alias("olon"), "now_s", "deadline_s")))
    to = haversine_m(F.col("p.lat"), F.col("p.lon"), F.col("olat"), F.col("olon"))
    on = haversine_m(F.col("olat"), F.col("olon"), F.col("q.lat"), F.col("q.lon"))
    straight = haversine_m(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon"))
    at_first = F.col("k") == F.col("next")
    leave = (
        F.when(at_first & ~F.col("serving"), F.col("now_s"))
        .when(at_first, F.col("now_s") + DWELL_S)
        .otherwise(F.greatest(F.col("now_s"), F.col("planned_before") + F.col("delay_s")) + DWELL_S)
    )
    extra = DETOUR * (to + on - straight)
    both = both.withColumn("extra_m", extra).withColumn("arrival_s", leave + DETOUR * to / F.col("speed_mps"))
    added = F.greatest(F.lit(0.0), F.col("extra_m")) / F.col("speed_mps") + DWELL_S

    def made_late(s: Column) -> Column:
        projected = s["planned_s"] + F.col("delay_s")
        return (projected <= s["deadline_s"]) & (s["deadline_s"] < projected + added)

    later = F.slice("stops", F.col("k") + 1, F.greatest(F.size("stops") - F.col("k"), F.lit(0)))
    both = both.withColumn("stops_made_late", F.size(F.filter(later, made_late))).withColumn("on_time", F.col("arrival_s") <= F.col("deadline_s"))
    cost = F.col("extra_m") / 1000 + LATE_KM * F.col("stops_made_late") + F.when(F.col("on_time"), 0.0).otherwise(LATE_KM)
    return both.select("order_id", "van_id", "k", "extra_m", "arrival_s", "stops_made_late", "on_time", cost.alias("cost"))


def assignments(orders: DataFrame, vans: DataFrame) -> DataFrame:
    """The best option of each order, ties by earlier arrival, then van and position; also how many there were.

    An order without any option has no row.
    """
    blocks = -(-orders.count() // BLOCK)
    of = F.pmod(F.xxhash64("order_id"), F.lit(max(1, blocks)))
    found = reduce(DataFrame.union, [options(orders.where(of == b) if blocks > 1 else orders, vans) for b in range(max(1, blocks))])
    found = found.where("cost is not null")  # null: a place isn't known
    best = F.min(F.struct("cost", "arrival_s", "van_id", "k", "extra_m", "stops_made_late", "on_time"))
    return found.groupBy("order_id").agg(best.alias("b"), F.count("*").alias("options_considered")).select(
        "order_id", "b.van_id", F.col("b.k").alias("insert_before"), (F.floor(F.col("b.extra_m") / 10 + 0.5) / 100).alias("extra_km"),
        F.col("b.arrival_s").alias("predicted_arrival_s"), "b.stops_made_late", "b.on_time", "options_considered",
    )
