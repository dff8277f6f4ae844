"""Polygon covers against ray casting over whole polygons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import cover

RINGS = "id int, rings array<array<struct<lng:double,lat:double>>>"


def wave(n, x, y, radius, seed, jitter=None):
    """A closed ring; a small jitter makes a coast, a large one a hairball."""
    rng = np.random.default_rng(seed)
    a = np.arange(n) / n * 2 * np.pi
    r = radius * (0.8 + 0.15 * np.cos(5 * a) + (2 / n if jitter is None else jitter) * rng.random(n))
    ring = np.stack([x + r * np.cos(a), y + r * np.sin(a)], axis=1)
    return np.concatenate([ring, ring[:1]])


def inside(rings, places):
    n = np.zeros(len(places), int)
    x, y = places[:, :1], places[:, 1:]
    for ring in rings:
        for at in range(0, len(ring) - 1, 1000):
            a, b = ring[:-1][at : at + 1000], ring[1:][at : at + 1000]
            with np.errstate(all="ignore"):
                n += (((a[:, 1] > y) != (b[:, 1] > y)) & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])).sum(axis=1)
    return n % 2 == 1


def looked_up(rings, places):
    found = {}
    for level, x, y, whole, parts in cover.cells_of(rings):
        assert (level, x, y) not in found
        found[level, x, y] = whole, parts
    out = []
    for lng, lat in places:
        keys = [(level, int(np.floor((lng + 180) / cover.width(level))), int(np.floor((lat + 180) / cover.width(level)))) for level in {k[0] for k in found}]
        met = [found[k] for k in keys if k in found]
        assert len(met) <= 1, "the cells of a cover are disjoint"
        out.append(bool(met) and (met[0][0] or bool(inside(met[0][1], np.array([[lng, lat]]))[0])))
    return np.array(out), found


@pytest.mark.parametrize(("n", "jitter"), [(3, None), (7, None), (500, None), (500, 0.5), (20_000, None), (3000, 0.9)])
def test_cover_equals_the_whole_polygon(n, jitter):
    rings = [wave(n, -105.3, 39.2, 1.5, n, jitter), wave(max(3, n // 3), -105.3, 39.2, 0.5, n + 1, jitter), wave(50, -100.1, 30.0, 0.3, 3)]
    places = np.random.default_rng(n).uniform([-107, 37.5], [-103.5, 41], (1500, 2))
    places = np.concatenate([places, np.random.default_rng(1).uniform([-100.5, 29.6], [-99.7, 30.4], (200, 2))])
    got, found = looked_up(rings, places)
    assert (got == inside(rings, places)).all()
    corners = sum(len(r) for _, parts in found.values() for r in parts)
    assert corners <= 2 * max(cover.LEAST, cover.SPREAD * sum(map(len, rings)))
    if jitter is None:
        assert all(sum(map(len, parts)) <= cover.CORNERS + 2 * len(parts) for _, parts in found.values())


def test_edges_on_the_cells_borders():
    side = cover.width(6)
    x, y = -180 + 3 * side, -180 + 35 * side
    square = np.array([[x, y], [x + 3 * side, y], [x + 3 * side, y + 2 * side], [x, y + 2 * side], [x, y]])
    hole = np.array([[x + side, y], [x + 2 * side, y], [x + 2 * side, y + side], [x + side, y + side], [x + side, y]])
    places = np.array([[x + i * side / 4, y + j * side / 4] for i in range(-2, 15) for j in range(-2, 11)])
    for rings in ([square], [square, hole], [square[::-1], hole]):
        got, _ = looked_up(rings, places)
        assert (got == inside(rings, places)).all()


def test_join_with_a_hundred_thousand_corners(spark):
    rings = [wave(100_000, -105.0, 39.0, 2.0, 1), wave(30_000, -105.0, 39.0, 1.0, 2)]
    other = [wave(60, -104.0, 39.5, 1.0, 5)]
    as_rows = lambda parts: [[(float(x), float(y)) for x, y in r] for r in parts]
    polygons = spark.createDataFrame([(1, as_rows(rings)), (2, as_rows(other)), (3, None), (4, []), (5, [[(float("nan"), 1.0), (2.0, 2.0), (3.0, 1.0)]])], RINGS)
    places = np.random.default_rng(9).uniform([-107.2, 36.8], [-102.8, 41.2], (2000, 2))
    points = spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(places)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "n int, lat double, lng double")
    cells = cover.cover(polygons).persist()
    got = sorted((r.n, r.id) for r in cover.in_cover(points, cells).select("n", "id").collect())
    want = sorted([(i, 1) for i in np.flatnonzero(inside(rings, places)).tolist()] + [(i, 2) for i in np.flatnonzero(inside(other, places)).tolist()])
    assert got == want
    # most of the area needs no ray: whole cells hold nearly all places inside
    whole = cover.in_cover(points, cells.where("whole")).where("id = 1").count()
    assert whole > 0.9 * sum(i == 1 for _, i in got)
    assert cells.agg(F.max(F.size(F.flatten("rings")))).first()[0] <= cover.CORNERS + 40
    cells.unpersist()


def test_no_polygons(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0)], "n int, lat double, lng double")
    assert cover.in_polygons(points, spark.createDataFrame([], RINGS)).collect() == []
    assert cover.in_polygons(points.limit(0), spark.createDataFrame([(1, [[(0.0, 0.0), (2.0, 0.0), (1.0, 2.0)]])], RINGS)).collect() == []


def test_crowds_are_met_in_blocks(spark, monkeypatch):
    """Many places in the same cut cells of many polygons: a block of each at a time, and the same pairs."""
    shapes = [[wave(300, -105.0 + i / 50, 39.0, 1.0, i), wave(100, -105.0 + i / 50, 39.0, 0.4, i + 50)] for i in range(9)]
    as_rows = lambda parts: [[(float(x), float(y)) for x, y in r] for r in parts]
    polygons = spark.createDataFrame([(i, as_rows(s)) for i, s in enumerate(shapes)], RINGS)
    places = np.random.default_rng(4).uniform([-106.2, 37.8], [-103.6, 40.2], (3000, 2)).round(2)
    points = spark.createDataFrame([(i, float(y), float(x), {"a": i}) for i, (x, y) in enumerate(places)], "n int, lat double, lng double, more map<string,int>")
    cells = cover.cover(polygons).persist()
    want = sorted((i, k) for k, s in enumerate(shapes) for i in np.flatnonzero(inside(s, places)).tolist())
    for crowd in (1, 20_000):
        monkeypatch.setattr(cover, "CROWD", crowd)
        monkeypatch.setattr(cover, "BLOCK", (100, 2))
        monkeypatch.setattr(cover, "PAIRS", 500)
        met = cover.in_cover(points, cells)
        assert "CoGroups" in met._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.n, r.id) for r in met.where("more['a'] = n").collect()) == want
    cells.unpersist()


def test_columns_that_points_and_polygons_share(spark, monkeypatch):
    """Both have a key, and polygons a place of their own: pairs are the same whether they meet in blocks or one by one."""
    shapes = [wave(300, -105.0 + i / 2, 39.0, 1.0, i) for i in range(3)]
    rows = [(10 + i, 0.0, [[(float(x), float(y)) for x, y in s]], -i) for i, s in enumerate(shapes)]
    polygons = spark.createDataFrame(rows, f"poly int, lat double, {RINGS.removeprefix('id int, ')}, key int")
    places = np.random.default_rng(4).uniform([-106.2, 37.8], [-102.6, 40.2], (500, 2))
    points = spark.createDataFrame([(i, float(y), float(x), 7 * i) for i, (x, y) in enumerate(places)], "n int, lat double, lng double, key int")
    want = sorted((i, float(places[i, 1]), float(places[i, 0]), 7 * i, 10 + k, 0.0, -k) for k, s in enumerate(shapes) for i in np.flatnonzero(inside([s], places)).tolist())
    for crowd in (1, 10**9):
        monkeypatch.setattr(cover, "CROWD", crowd)
        met = cover.in_polygons(points, polygons)
        assert met.columns == ["n", "lat", "lng", "key", "poly", "lat", "key"]
        assert sorted(map(tuple, met.collect())) == want
        assert met.select("n", "poly").count() == len(want)
