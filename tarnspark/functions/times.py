"""Times, offsets and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c


def micros(ts) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def seconds_between(a, b) -> Column:
    return (micros(b) - micros(a)) / 1e6


def event_time(start, seconds) -> Column:
    """A start time and seconds into the stream; the start itself if these are missing."""
    return F.timestamp_micros(micros(start) + F.coalesce((_c(seconds) * 1000000).cast("long"), F.lit(0).cast("long"))).cast("timestamp_ntz")


def utc_offset(seconds) -> Column:
    """±HH:MM of an offset in seconds."""
    s = _c(seconds).cast("long")
    minutes = F.floor(F.abs(s) / 60)
    return F.format_string("%s%02d:%02d", F.when(s < 0, "-").otherwise("+"), F.floor(minutes / 60).cast("long"), (minutes % 60).cast("long"))


def time_zone(text) -> Column:
    """The zone's name behind the bracket of "(GMT-07:00) America/Denver"; UTC if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(text), r"\)\s*(.+)$", 1), F.lit("")), F.lit("UTC"))


def iso(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hours_to_midnight(ts) -> Column:
    """Hours to the next UTC midnight, half an hour at least."""
    return F.greatest(F.lit(0.5), 24 - F.hour(_c(ts)) - F.minute(_c(ts)) / 60.0)


def near_in_time(a, b, seconds: float = 300) -> Column:
    return F.abs(micros(a) - micros(b)) <= int(seconds * 1e6)


def duration(seconds) -> Column:
    """Seconds with a decimal below a minute, minutes and seconds below an hour, else hours and minutes."""
    x = _c(seconds).cast("double")
    s = F.floor(x).cast("long")
    minutes = F.floor(s / 60).cast("long")
    return F.when(x < 60, F.format_string("%.1fs", x)).when(x < 3600, F.format_string("%dm %ds", minutes, s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600).cast("long"), minutes % 60))


def from_local(wall_clock, offset) -> Column:
    """The instant of a local wall-clock text and an offset such as -07:00; parts of a second are dropped."""
    return F.to_timestamp(F.concat(F.substring(_c(wall_clock), 1, 19), _c(offset)), "yyyy-MM-dd'T'HH:mm:ssXXX")


def local_text(ts, offset_seconds) -> Column:
    """The wall clock at an offset, with the offset behind it."""
    local = F.timestamp_micros(micros(ts) + _c(offset_seconds).cast("long") * 1000000).cast("timestamp_ntz")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), utc_offset(offset_seconds))
