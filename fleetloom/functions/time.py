"""Durations, classes of lateness and roundings, all with the rounding that the results need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetloom.session import micros


def floor_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, rounded down: -1.5 s is -2."""
    return F.floor((micros(end) - micros(start)) / F.lit(1_000_000))


def minutes_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(60_000_000.0)


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves up: -2.5 is -2."""
    return F.floor(value + 0.5)


def round_km(metres: Column) -> Column:
    """Kilometres to two places, halves up."""
    return round_half_up(metres / 10) / 100


def round_1(value: Column) -> Column:
    return round_half_up(value * 10) / 10


def clamp_int(value: Column) -> Column:
    # Fixed value: the largest 32-bit integer.
    return F.least(value, F.lit(2_147_483_647)).cast("int")


def slack_class(slack_s: Column, critical_s: int = 0, warning_s: int = 60) -> Column:
    """CRITICAL below the first limit, WARNING below the second, else NONE; UNKNOWN for null."""
    return F.when(slack_s.isNull(), "UNKNOWN").when(slack_s < critical_s, "CRITICAL").when(slack_s < warning_s, "WARNING").otherwise("NONE")


def freshness(lag_ms: Column, fresh_ms: int = 2_000, stale_ms: int = 10_000) -> Column:
    """REAL_TIME, INTERPOLATED or STALE by the lag of a ping; STALE for null."""
    return F.when(lag_ms < fresh_ms, "REAL_TIME").when(lag_ms < stale_ms, "INTERPOLATED").otherwise("STALE")


def severity(late_s: Column, critical_s: int = 120) -> Column:
    return F.when(late_s > critical_s, "CRITICAL").otherwise("WARNING")


def lag_ms(earlier: Column, later: Column) -> Column:
    """Milliseconds, never negative."""
    return F.greatest(F.lit(0), F.floor((micros(later) - micros(earlier)) / F.lit(1000)))


def free_flow_mps(speed_kmh: Column, factor: Column, base_kmh: Column, time_scale: Column) -> Column:
    """Speed in metres a second if no zone slowed it: the measured speed, or the base where it is 0."""
    return F.when(speed_kmh > 0, speed_kmh / factor).otherwise(base_kmh) / 3.6 * time_scale


def average_kmh(km: Column, minutes: Column, time_scale: Column) -> Column:
    """Speed over the ground at real pace, at most 999.99; that too where distance or time is missing or no time passed."""
    hours = minutes / 60 * F.coalesce(time_scale, F.lit(1.0))
    return F.least(F.lit(999.99), km / F.nullif(hours, F.lit(0.0)))
