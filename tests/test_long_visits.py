"""Visits by chunks equal those by windows over whole tracks."""

import random

import pytest
from pyspark.sql import functions as F

from tarnspark.operators import long_visits, visits

from .test_visits import CASES, HIGH, POINT, SITE, frames


def rounded(found):
    return sorted((r.track_id, r.site_id, r.visit, r.mode, r.lat, r.lng, r.elevation, r.idx, r.t, round(r.min_dist, 6), r.samples, round(r.seconds, 6), round(r.confidence, 9), r["class"], r.needs_confirmation) for r in found.collect())


@pytest.mark.parametrize("size", [2])
def test_known_tracks_in_chunks(spark, size):
    points = sites = None
    for name in CASES:
        p, s = frames(spark, name)
        # each case has its own sites, of which some share an id
        p, s = p.withColumn("lat", F.col("lat")), s.withColumn("site_id", F.concat(F.lit(f"{name}/"), "site_id"))
        found = rounded(long_visits.detect_visits(p, s, size)) if name in ("two passes", "climb") else None
        if found is not None:
            assert found == rounded(visits.detect_visits(p, s))
        points, sites = p if points is None else points.union(p), s if sites is None else sites.union(s)
    assert rounded(long_visits.detect_visits(points, sites, size)) == rounded(visits.detect_visits(points, sites))


@pytest.mark.parametrize("size", [7])
def test_random_tracks_with_gaps_and_clocks_that_jump(spark, size):
    rng, rows = random.Random(size), []
    for k in range(25):
        t = 0.0
        for i in range(rng.randint(1, 160)):
            t += rng.choice([1, 20, 90, 200, 500, -30])
            off = rng.choice([0.0, 0.0003, 0.0008, 0.0012, 0.0014, 0.003, 0.003])
            alt = None if k % 3 == 0 or rng.random() < 0.2 else 4290.0 + rng.random() * 20
            rows.append((str(k), 2 * i, None if k % 5 == 1 else t, 40.0 + off * rng.random(), -105.0 - off, alt))
    points = spark.createDataFrame(rows, POINT)
    sites = spark.createDataFrame([*HIGH, ("bare", 40.0005, -105.0005, None)], SITE)
    want = rounded(visits.detect_visits(points, sites))
    assert len(want) > 50
    assert rounded(long_visits.detect_visits(points, sites, size)) == want


def test_one_track_of_a_million_points_in_64_chunks(spark):
    n = 1_000_000
    off = F.when(F.col("id") % 5000 < 600, F.abs(F.col("id") % 600 - 300) / 250_000.0).otherwise(0.01)
    points = spark.range(n).select(F.lit("long").alias("track_id"), F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("t"), (40.0 + off).alias("lat"), F.lit(-105.0).alias("lng"), (4250.0 + F.col("id") % 97).alias("alt"))
    sites = spark.createDataFrame(HIGH[:1], SITE)
    found = rounded(long_visits.detect_visits(points, sites, -(-n // 64)))
    assert len(found) == 200 and found == rounded(visits.detect_visits(points, sites))


def test_nothing_from_nothing(spark):
    points, sites = frames(spark, "high")
    assert long_visits.detect_visits(points.limit(0), sites).count() == 0
    assert long_visits.detect_visits(points, sites.limit(0)).count() == 0
