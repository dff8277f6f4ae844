"""Visits of tracks of any length, by chunks of a track that are worked on apart.

What a chunk does to a (track, site) pair depends on one number from before it, the last time within reach. So each chunk is
summarised by its own last time within reach; a window over the summaries, one row for each chunk, hands each chunk the last one
of those before it; and each chunk is replayed with it. The rows within reach, and each chunk's count of closings, are all that is
kept of the replay; closings are added up over the chunks, which numbers the visits. Measures of a visit are sums, minima and
counts; altitudes in front of and behind the closest point are told apart by their ranks, which are counted in chunks, too.
No window, group or array holds more than a chunk of a track, or a row for each of its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.geo import coarse_box, haversine
from ..session import cut
from .visits import each_site, pairs_near, spots

#: Points of a chunk.
CHUNK = 100_000

PAIR = ["track_id", "site_id"]


def pair_rows(points: DataFrame, sites: DataFrame, size: int) -> DataFrame:
    """Every point of a track with every site that the track came near: distance, mode, whether it is within reach, in the box and
    beyond the exit; ``_chunk`` is the part of the track. The join is on track and chunk, so a long track is many keys."""
    p = points.withColumn("t", F.coalesce("t", F.col("idx").cast("double"))).withColumn("_chunk", F.floor(F.col("idx") / size).cast("long"))
    chunks = p.groupBy("track_id", "_chunk").agg(F.bool_or(F.col("alt").isNotNull()).alias("_alt"))
    tracks = chunks.groupBy("track_id").agg(F.bool_or("_alt").alias("_any_alt"))
    near = pairs_near(points, sites, max(scores.ENTER.values()))
    site = sites.select("site_id", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), "elevation")
    near = near.join(site, "site_id").join(tracks, "track_id").join(chunks.select("track_id", "_chunk"), "track_id")
    rows = p.join(near, ["track_id", "_chunk"]).withColumn("mode", scores.mode(F.col("_any_alt"), F.col("elevation").isNotNull()))
    rows = rows.withColumn("dist", haversine("lat", "lng", "s_lat", "s_lng"))
    enter, leave = scores.by_mode(F.col("mode"), scores.ENTER), scores.by_mode(F.col("mode"), scores.EXIT)
    half_lat, half_lng = coarse_box(enter, F.col("s_lat"))
    box = (F.abs(F.col("s_lat") - F.col("lat")) <= half_lat) & (F.abs(F.col("s_lng") - F.col("lng")) <= half_lng)
    return rows.select(*PAIR, "_chunk", "idx", "t", "lat", "lng", "alt", "mode", "elevation", "dist", (F.col("dist") <= enter).alias("_in"), box.alias("_box"), (F.col("dist") >= leave).alias("_far"))


def before(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """keys, _chunk and ``name``: the sum of ``value`` over the chunks before, from one row for each chunk."""
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_n"))
    return sums.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(name))


def visit_rows(points: DataFrame, sites: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows within reach with the visit they belong to, as ``visits.visit_rows`` has them, and their ``_chunk``; written to the shared folder."""
    rows = pair_rows(points, sites, size)
    # what each chunk hands on: its last time within reach, or else what it was handed
    last = rows.groupBy(*PAIR, "_chunk").agg(F.max_by("t", F.when(F.col("_in"), F.col("idx"))).alias("_last"))
    handed = F.last("_last", ignorenulls=True).over(Window.partitionBy(*PAIR).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    carried = cut(last.select(*PAIR, "_chunk", handed.alias("_carried")))
    # the replay
    part = Window.partitionBy("track_id", "_chunk", "site_id").orderBy("idx")
    own = F.last(F.when(F.col("_in"), F.col("t")), ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(carried, [*PAIR, "_chunk"])
    closes = ~F.col("_in") & F.col("_far") & (F.col("t") - F.coalesce(own, F.col("_carried")) >= scores.RESET_SECONDS)
    rows = rows.withColumn("_cut", F.coalesce(closes.cast("int"), F.lit(0))).withColumn("_cuts", F.sum("_cut").over(part))
    ends = F.lead("idx").over(part).isNull()
    kept = cut(rows.withColumn("_end", ends).where(F.col("_in") | F.col("_end")).drop("_cut", "_carried", "_far"))
    closed = before(kept.where("_end"), PAIR, F.col("_cuts"), "_before")
    inside = kept.where("_in").join(closed, [*PAIR, "_chunk"]).withColumn("visit", F.col("_cuts") + F.col("_before"))
    opened = inside.groupBy(*PAIR, "visit").agg(F.min(F.when(F.col("_box"), F.col("idx"))).alias("_open"))
    found = inside.join(opened, [*PAIR, "visit"]).where(F.col("idx") >= F.col("_open"))
    return cut(found.drop("_in", "_box", "_end", "_cuts", "_before", "_open"))


def measure_visits(rows: DataFrame) -> DataFrame:
    """One row for each visit, as ``visits.measure_visits`` has it, without its altitudes ever being an array."""
    visit = [*PAIR, "visit"]
    # ranks of the samples with an altitude: those of the chunks before and those before in the chunk
    high = rows.where(F.col("alt").isNotNull()).select(*visit, "_chunk", "idx", "alt")
    rank = F.row_number().over(Window.partitionBy(*visit, "_chunk").orderBy("idx")) - 1
    high = high.withColumn("_rank", rank).join(before(high, visit, F.lit(1), "_before"), [*visit, "_chunk"])
    grouped = rows.groupBy(*visit).agg(
        F.first("mode").alias("mode"),
        F.first("elevation").alias("elevation"),
        F.count("*").alias("samples"),
        F.min("idx").alias("start_idx"),
        (F.max("t") - F.min("t")).alias("seconds"),
        F.min(F.struct("dist", "idx", "lat", "lng", "t")).alias("_near"),
        F.count("alt").alias("_n"),
        F.avg("alt").alias("_mean"),
    )
    grouped = grouped.withColumn("_nearest", F.col("_near.idx") - F.col("start_idx"))
    split = grouped.select(*visit, "_nearest", scores.approach_split(F.col("_n"), F.col("_nearest")).alias("_at"))
    place = F.col("_rank") + F.col("_before")
    sides = high.join(split, visit).groupBy(*visit).agg(
        F.avg(F.when(place < F.col("_at"), F.col("alt"))).alias("_ahead"),
        F.avg(F.when(place >= F.col("_at"), F.col("alt"))).alias("_behind"),
        F.max(F.when(place == F.col("_nearest"), F.col("alt"))).alias("_here"),
    )
    joined = grouped.join(sides, visit, "left")
    here = F.coalesce("_here", (F.col("_ahead") + F.col("_behind")) / 2)
    approach = scores.approach_shape(F.col("_n"), F.col("_ahead"), F.col("_behind"), here)
    return joined.select(*visit, "mode", F.col("_near.lat").alias("lat"), F.col("_near.lng").alias("lng"), "elevation", F.col("_near.idx").alias("idx"), F.col("_near.t").alias("t"), F.col("_near.dist").alias("min_dist"), "samples", "seconds", "_mean", approach.alias("_approach"))


def detect_visits(points: DataFrame, sites: DataFrame, size: int = CHUNK) -> DataFrame:
    """Visits that aren't rejected, as ``visits.detect_visits`` has them, for tracks of any length. ``size``: points of a chunk.

    idx is a point's number in its track, unique there. No points or no sites give no visits.
    """
    at, members = spots(sites)
    found = each_site(measure_visits(visit_rows(points, at, size)), members).where(F.col("class") != "reject")
    return found.withColumn("needs_confirmation", F.col("class") == "confirm")
