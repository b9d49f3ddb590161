"""Texts: JSON payloads, labels and durations as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_or_string(payload: Column) -> Column:
    """A valid JSON text unchanged, anything else as a JSON string; blank as the empty one; null for null."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.to_json(F.struct(payload.alias("v"))), r'^\{"v":"', ""), r'"\}$', ""), F.lit('"'))
    # the parser stops after the first value: only what is whole in a list and in an object is one value
    listed = F.concat(F.lit("["), payload, F.lit("]"))
    one = F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), payload, F.lit("}"))).isNotNull()
    return F.when(F.trim(payload) == "", F.lit('""')).when(one, payload).when(payload.isNotNull(), quoted)


def truncated(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def client_key(forwarded_for: Column, remote: Column) -> Column:
    """The first forwarded address, else the remote one."""
    first = F.trim(F.split(forwarded_for, ",")[0])
    return F.when(F.length(first) > 0, first).otherwise(remote)


def padded_id(prefix: str, number: Column, width: int = 3) -> Column:
    return F.concat(F.lit(prefix + "-"), F.lpad(number.cast("string"), width, "0"))


UNKNOWN = "\u2014"  # fixed value: shown where nothing is known


def duration_label(seconds: Column) -> Column:
    """125 as '2m 05s', 5 as '5s'."""
    s = seconds.cast("bigint")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), s % 60))


def eta_label(seconds: Column) -> Column:
    """A duration; 'At stop' for 0, a dash for a negative one and null."""
    return F.when(seconds == 0, "At stop").when(seconds > 0, duration_label(seconds)).otherwise(UNKNOWN)


def slack_label(seconds: Column) -> Column:
    """'+2m 10s' to spare or '45s late'; a dash for null."""
    late = F.concat(duration_label(-seconds), F.lit(" late"))
    return F.when(seconds < 0, late).when(seconds >= 0, F.concat(F.lit("+"), duration_label(seconds))).otherwise(UNKNOWN)


def clock_label(at: Column) -> Column:
    """Hour and minute in the session's time zone; null for what isn't a time."""
    return F.date_format(F.try_to_timestamp(at.cast("string")), "HH:mm")


def since_label(seconds: Column) -> Column:
    """How long ago: 'just now', '40s ago', '2m ago'."""
    s = F.floor(seconds)
    return F.when(s < 5, "just now").when(s < 60, F.format_string("%ds ago", s)).when(s >= 60, F.format_string("%dm ago", F.floor(s / 60)))


def unwrapped_heading(before: Column, now: Column) -> Column:
    """``now`` plus whole turns, so that it is at most half a turn from ``before``."""
    return before + F.pmod(now - before + 180, F.lit(360.0)) - 180


def jdbc_url(url: Column) -> Column:
    """A connection string of the reactive driver as one for JDBC; others as they are."""
    return F.regexp_replace(url, r"r2dbc:(pool:)?postgresql", "jdbc:postgresql")
