"""Scores and classes of site visits and of matches, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the detector, by data mode: enter and exit distance in metres, acceptance threshold.
ENTER = {"A": 100.0, "B": 80.0, "C": 60.0, "D": 50.0}
EXIT = {"A": 150.0, "B": 120.0, "C": 100.0, "D": 80.0}
ACCEPT = {"A": 0.55, "B": 0.50, "C": 0.60, "D": 0.65}
RESET_SECONDS = 180.0
REJECT = 0.40
TOLERANCE_M, PENALTY_M = 75.0, 150.0


def mode(has_altitude: Column, has_elevation: Column) -> Column:
    return F.when(has_altitude & has_elevation, "A").when(has_altitude, "B").when(has_elevation, "C").otherwise("D")


def by_mode(mode_column: Column, values: dict[str, float]) -> Column:
    return F.when(mode_column == "A", values["A"]).when(mode_column == "B", values["B"]).when(mode_column == "C", values["C"]).otherwise(values["D"])


def distance_score(metres: Column) -> Column:
    return F.exp(-metres / 60.0)


def elevation_score(mean_altitude: Column, elevation: Column) -> Column:
    off = F.abs(mean_altitude - elevation)
    return F.when(off.isNull() | (off <= TOLERANCE_M), 1.0).otherwise(F.greatest(F.lit(0.2), 1 - (off - TOLERANCE_M) / PENALTY_M * 0.6))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def approach_shape(n: Column, before: Column, after: Column, here: Column) -> Column:
    """By the mean altitudes in front of and behind the closest point, and the one there; ``n`` altitudes in all."""
    rise = here - F.least(before, after)
    shape = F.when(rise >= 5, F.least(F.lit(1.15), 1 + rise / 100)).when(rise >= 0, 0.85).otherwise(0.6)
    return F.when(n < 3, 0.85).otherwise(shape)


def approach_split(n: Column, nearest: Column) -> Column:
    """How many of n altitudes count as in front of the closest point."""
    return F.least(F.greatest(F.lit(1), nearest), n - 1)


def approach_score(altitudes: Column, nearest: Column) -> Column:
    """``altitudes``: samples within reach in order; ``nearest``: the closest point's index behind the visit's first."""
    n = F.size(altitudes)
    at = approach_split(n, nearest)
    before, after = _mean(F.slice(altitudes, F.lit(1), at)), _mean(F.slice(altitudes, at + 1, n))
    here = F.when((nearest >= 0) & (nearest < n), F.get(altitudes, nearest)).otherwise((before + after) / 2)
    return approach_shape(n, before, after, here)


def dwell_score(samples: Column, seconds: Column) -> Column:
    return 0.7 + 0.3 * F.greatest(F.least(F.lit(1.0), samples / 5.0), F.least(F.lit(1.0), seconds / 45.0))


def confidence_of(mode_column: Column, metres: Column, samples: Column, seconds: Column, mean: Column, approach: Column, elevation: Column) -> Column:
    base = distance_score(metres) * dwell_score(samples, seconds)
    full = F.when(mode_column == "A", base * elevation_score(mean, elevation) * approach).when(mode_column == "B", base * approach).otherwise(base)
    return F.least(F.lit(1.0), full)


def mean_altitude(altitudes: Column) -> Column:
    return F.when(F.size(altitudes) > 0, _mean(altitudes))


def confidence(mode_column: Column, metres: Column, samples: Column, seconds: Column, altitudes: Column, nearest: Column, elevation: Column) -> Column:
    return confidence_of(mode_column, metres, samples, seconds, mean_altitude(altitudes), approach_score(altitudes, nearest), elevation)


def visit_class(score: Column, mode_column: Column) -> Column:
    return F.when(score < REJECT, "reject").when(score < by_mode(mode_column, ACCEPT), "confirm").otherwise("accept")


def match_elevation(a: Column, b: Column) -> Column:
    """1 below 50 m apart, 0 beyond 200 m, linear between; 0.5 if either is missing or 0."""
    off = F.abs(a - b)
    missing = a.isNull() | b.isNull() | (a == 0) | (b == 0)
    return F.when(missing, 0.5).when(off < 50, 1.0).when(off > 200, 0.0).otherwise(1 - (off - 50) / 150.0)


def match_score(name: Column, metres: Column, radius: float, elevation: Column) -> Column:
    return name * 0.5 + (1 - metres / radius) * 0.3 + elevation * 0.2


def match_level(name: Column, metres: Column) -> Column:
    """How sure a best match is."""
    return F.when(metres.isNull(), "none").when((metres < 100) & (name > 0.7), "high").when((metres < 300) & (name > 0.4), "medium").when(metres < 100, "medium").otherwise("low")


def zone_type(area: Column) -> Column:
    """What a summit zone of so many square metres is called. Fixed values."""
    return F.when(area < 50, "knife-edge / point summit").when(area < 200, "small summit area").when(area < 1000, "moderate summit plateau").otherwise("large / flat summit")


def budget(short_limit: Column, short_usage: Column, daily_limit: Column, daily_usage: Column, hours_left: Column) -> Column:
    """Messages that a run may take: twelve runs an hour, two requests each, with a margin of 2 %."""
    short, daily = short_limit - short_usage, daily_limit - daily_usage
    spread = F.floor(daily * 0.98 / F.greatest(F.lit(0.5), hours_left) / 12 / 2)
    room = F.least(spread, F.floor((short - 2) / 2))
    least = F.when(daily >= 2, 1).otherwise(0).cast("long")
    return F.when((short <= 0) | (daily <= 0), F.lit(0).cast("long")).otherwise(F.greatest(least, room))


def area_text(area: Column) -> Column:
    """Square metres, in thousands from 1000 on."""
    return F.when(area < 1, F.format_string("%.2f sq m", area)).when(area < 1000, F.format_string("%.0f sq m", area)).otherwise(F.format_string("%.1fk sq m", area / 1000.0))


def even_share(short_limit: Column, short_usage: Column, daily_limit: Column, daily_usage: Column) -> Column:
    """The simpler allowance: a third of what is left of either limit."""
    return F.greatest(F.lit(0).cast("long"), F.floor(F.least(short_limit - short_usage, daily_limit - daily_usage) / 3))


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k
