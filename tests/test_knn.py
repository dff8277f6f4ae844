"""Nearest sites against comparing all."""

import math
import random

import pytest

from tarnspark.operators import cells, knn


def metres(a, b):
    lat1, lat2 = math.radians(a[0]), math.radians(b[0])
    c = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(c), math.sqrt(1 - c))


def check(spark, points, sites, k):
    found = {}
    p = spark.createDataFrame(points, "point_id long, lat double, lng double")
    s = spark.createDataFrame(sites, "site_id long, lat double, lng double")
    for r in knn.nearest(p, s, k).orderBy("point_id", "rank").collect():
        found.setdefault(r.point_id, []).append((round(r.distance_m, 4), r.site_id))
    for i, lat, lng in points:
        if lat is not None:
            want = sorted((metres((lat, lng), (a, b)), j) for j, a, b in sites if a is not None)[:k]
            assert [d for d, _ in found[i]] == pytest.approx([d for d, _ in want], abs=0.01), (i, lat, lng)
            assert len({j for _, j in found[i]}) == len(want)
    return found


def test_crowded_and_empty_places(spark):
    rng = random.Random(1)
    # nine of ten sites lie within a few hundred metres; the others anywhere, with poles and the date line
    crowd = [(i, 39.1 + rng.random() / 500, -105.2 + rng.random() / 500) for i in range(2700)]
    sites = crowd + [(3000 + i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(300)]
    sites += [(4000, 89.9, 10.0), (4001, 89.8, -170.0), (4002, 10.0, 179.999), (4003, 10.0, -179.999), (4004, 10.0, 180.0), (4005, None, 1.0)]
    points = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(150)]
    points += [(200 + i, 39.1 + rng.uniform(-1, 2) / 500, -105.2 + rng.uniform(-1, 2) / 500) for i in range(60)]
    points += [(300, 89.95, -100.0), (301, 10.0, -179.9999), (302, 10.0, 179.99), (303, -90.0, 0.0), (304, 90.0, 0.0), (305, None, 2.0), (306, 39.101, -105.199)]
    found = check(spark, points, sites, 5)
    assert 305 not in found and len(found) == len(points) - 1


def test_more_copies_than_a_leaf_holds(spark, monkeypatch):
    monkeypatch.setattr(knn, "HOT", 40)
    sites = [(i, 10.0, 20.0) for i in range(200)] + [(500 + i, 11.0, 20.0 + i) for i in range(5)]
    found = check(spark, [(1, 10.0, 20.0), (2, 50.0, 60.0)], sites, 3)
    assert [j for _, j in found[1]] == [0, 1, 2]


def test_few_sites(spark):
    found = check(spark, [(1, 0.0, 0.0)], [(7, 5.0, 5.0), (8, -60.0, 170.0)], 5)
    assert [j for _, j in found[1]] == [7, 8]
    none = spark.createDataFrame([], "site_id long, lat double, lng double")
    points = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, lat double, lng double")
    assert knn.nearest(points, none, 2).collect() == []
    assert knn.nearest(points.limit(0), none.union(spark.createDataFrame([(1, 1.0, 1.0)], none.schema)), 2).collect() == []


def test_not_itself(spark):
    rows = spark.createDataFrame([(i, 40.0 + i / 100, -105.0) for i in range(50)], "point_id long, lat double, lng double")
    found = knn.nearest(rows, rows.withColumnRenamed("point_id", "site_id"), 1, others=True).collect()
    assert len(found) == 50 and all(abs(r.point_id - r.site_id) == 1 for r in found)
    assert {r.rank for r in found} == {1}


def test_a_place_of_many_sites_is_one_entry(spark):
    """Sites that share places make no node deeper, and a point meets each place once, with as many ids as are asked for."""
    sites = [(i, 10.0 + i % 3, 20.0) for i in range(300)]
    at = cells.places(spark.createDataFrame(sites, "site_id long, lat double, lng double"), 4).withColumnsRenamed({"r_lat": "lat", "r_lng": "lng"})
    nodes, placed = knn.tree(at)
    assert nodes.where("inner").count() == 0 and placed.count() == 3 and {len(r.ids) for r in placed.collect()} == {4}
    found = check(spark, [(1, 10.4, 20.0), (2, -50.0, 60.0)], sites, 4)
    assert [j for _, j in found[1]] == [0, 3, 6, 9]
    rows = spark.createDataFrame(sites, "point_id long, lat double, lng double")
    near = knn.nearest(rows, rows.withColumnRenamed("point_id", "site_id"), 2, others=True).where("point_id in (0, 3, 299)").orderBy("point_id", "rank").collect()
    assert [(r.point_id, r.site_id, r.rank) for r in near] == [(0, 3, 1), (0, 6, 2), (3, 0, 1), (3, 6, 2), (299, 2, 1), (299, 5, 2)]
