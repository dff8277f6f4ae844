"""Operators that SQL can't express, against plain loops; and edge cases."""

import random

from pyspark.sql import functions as F

from tarnspark.functions import geo, text
from tarnspark.operators import cells, claims, cover, ledger, matching, ml, raster


def test_cells_meet_every_pair(spark):
    rng = random.Random(4)
    pts = [(i, rng.choice([0, 40, 70, 84, -60]) + rng.random(), rng.choice([-180, 179, 0, -105]) + rng.random()) for i in range(400)]
    a = spark.createDataFrame([(i, la, (lo + 180) % 360 - 180) for i, la, lo in pts], "id int, lat double, lng double")
    b = a.select(F.col("id").alias("rid"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    near = sorted(tuple(r) for r in cells.within_distance(a, b, 20000.0).select("id", "rid").collect())
    every = a.crossJoin(b).where(geo.haversine("lat", "lng", "r_lat", "r_lng") <= 20000).select("id", "rid")
    assert near == sorted(tuple(r) for r in every.collect())


def test_greedy_pairs_equal_one_pass(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(30), rng.randrange(30)): round(rng.random(), 2) for _ in range(200)}.items())
    rows = [(e, s, w) for (e, s), w in edges]
    got = {(r.ext_id, r.site_id) for r in matching.greedy_pairs(spark.createDataFrame(rows, "ext_id int, site_id int, score double")).collect()}
    left, right, want = set(), set(), set()
    for e, s, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if e not in left and s not in right:
            left.add(e), right.add(s), want.add((e, s))
    assert got == want


def test_claims_equal_one_pass(spark):
    rng = random.Random(3)
    seeds = [(f"s{i:02d}", None if i % 9 == 0 else float(rng.randrange(100))) for i in range(60)]
    cands = [(s, k, 40 + rng.randrange(12) * 0.0003, -105 + rng.randrange(12) * 0.0004) for s, _ in seeds for k in (1, 2, 3)]
    got = {r.seed_id: (r["rank"], r.collided) for r in claims.assign_unclaimed(spark.createDataFrame(seeds, "seed_id string, elevation double"), spark.createDataFrame(cands, "seed_id string, rank int, lat double, lng double")).collect()}
    taken, want = [], {}
    for s, e in sorted(seeds, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])):
        own = sorted(c for c in cands if c[0] == s)
        free = next((c for c in own if all(claims._metres(c[2:], t) > 50 for t in taken)), None)
        taken.append((free or own[0])[2:])
        want[s] = ((free or own[0])[1], free is None)
    assert got == want


def test_snap_keeps_its_distance(spark):
    rng = random.Random(5)
    cells_ = spark.createDataFrame([(t, r, c, round(rng.random() * 50, 3)) for t in range(3) for r in range(8) for c in range(8)], "tile_id int, row int, col int, elev double")
    out = raster.snap(cells_, spark.createDataFrame([(t, 3, 4) for t in range(3)], "tile_id int, seed_row int, seed_col int"), k=3, least=3.0, size=3).collect()
    for t in range(3):
        own = [r for r in out if r.tile_id == t]
        assert sorted(r["rank"] for r in own) == list(range(1, len(own) + 1))
        assert all((a.row - b.row) ** 2 + (a.col - b.col) ** 2 >= 9 for a in own for b in own if a is not b)


def test_smoothing_keeps_a_plane_and_nulls(spark):
    rows = [(0, r, c, None if (r, c) == (3, 3) else 7.0) for r in range(8) for c in range(8)]
    out = raster.smooth(spark.createDataFrame(rows, "tile_id int, row int, col int, elev double"), 1.0).collect()
    assert all(abs(r.elev - 7.0) < 1e-9 if (r.row, r.col) != (3, 3) else r.elev is None for r in out)


def test_upsert_and_ignore(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, v double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 3.0)], "k int, s string, v double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ledger.upsert(old, new, ["k"])) == [(1, "a", 1.0), (2, None, 5.0), (3, "c", 3.0)]
    assert rows(ledger.upsert(old, new, ["k"], preserve=True)) == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", 3.0)]
    assert rows(ledger.upsert(old, new, ["k"], ["v"])) == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", 3.0)]
    assert rows(ledger.insert_ignore(old, new, [["k"]])) == [(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)]


def test_polygon_with_a_hole(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    polygon = spark.createDataFrame([("p", [ring(0.0, 4.0), ring(1.0, 2.0)])], "poly_id string, rings array<array<struct<lng:double,lat:double>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.0, 3.5), (4, 5.0, 1.0)], "id int, lat double, lng double")
    assert sorted(r.id for r in cover.in_polygons(points, polygon).collect()) == [1, 3]


def test_names(spark):
    pairs = [("Mt. Elbert", "Mount Elbert", 1.0), ("Pikes Peak", "Pike's Pk", 1.0), ("North Maroon Peak", "Maroon Peak", 0.8), ("Alpha", "Beta", 0.0), ("", "x", 0.0), (None, "Alpha", 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(text.name_similarity("a", "b").alias("s"))
    assert [round(r.s, 3) for r in df.collect()][3:] == [0.0, 0.0, 0.0]
    assert [r.s for r in df.collect()][1] == 1.0


def test_forest_learns(spark):
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 * 2.0 + F.rand(1)).alias("a"), F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.rand(2)).alias("b"))
    out = ml.cross_validate(rows, ["a", "b"], "id", k=2, trees=5).collect()
    assert len(out) == 2 and all(r.accuracy > 0.95 for r in out)
