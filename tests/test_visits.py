"""Visit detection on small tracks, and against a plain sequential machine."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarnspark.functions import scores
from tarnspark.operators import visits

HIGH = [("p1", 40.0, -105.0, 4300.0), ("p2", 40.001, -105.002, 4280.0)]
BARE = [("p3", 40.0, -105.0, None), ("p4", 40.001, -105.002, None)]
SITE = "site_id string, lat double, lng double, elevation double"
POINT = "track_id string, idx int, t double, lat double, lng double, alt double"


def ring(*middle):
    return [(0.005, 40.0), (0.002, 40.0002), *middle, (0.002, 40.0002), (0.005, 40.0)]


SUMMIT = ring((0.0002, 40.0001), (0.0001, 40.0), (0.0002, 40.0001))
NEAR = ring((0.0004, 40.0001), (0.0003, 40.0), (0.0004, 40.0001))
WIDE = ring((0.0006, 40.0001), (0.0005, 40.0), (0.0006, 40.0001))
PASS = [(0.0004, 40.0), (0.0003, 40.0001), (0.0002, 40.0), (0.0003, 40.0001), (0.0002, 40.0)]
CASES = {
    "single": ([(0.01, 40.0), (0.005, 40.0005), (0.0005, 40.0), (0.0004, 40.0), (0.0003, 40.0), (0.002, 40.0006)], [4200, 4250, 4300, 4295, 4290, 4200], HIGH, [0, 30, 60, 90, 120, 150], [("p1", 4, 0.555204, False)]),
    "two passes": ([*PASS, (0.01, 40.0), (0.02, 39.99), (0.03, 39.98), *PASS], [4280, 4290, 4300, 4295, 4298, 4200, 4100, 4000, 4280, 4290, 4300, 4295, 4298], HIGH, [0, 30, 60, 90, 120, 200, 400, 500, 600, 630, 660, 690, 720], [("p1", 2, 0.865739, False), ("p1", 10, 0.865739, False)]),
    "spike": ([(0.01, 40.0), (0.0005, 40.0), (0.01, 40.0), (0.02, 40.0)], [4200, 4300, 4200, 4100], HIGH, [0, 10, 20, 30], []),
    "high": (SUMMIT, [4200, 4250, 4295, 4300, 4298, 4250, 4200], HIGH, None, [("p1", 3, 0.911032, False)]),
    "below": (WIDE, [4050, 4080, 4100, 4102, 4099, 4080, 4050], HIGH, None, []),
    "edge": (ring((0.0007, 40.0001), (0.0006, 40.0), (0.0007, 40.0001)), [4150, 4200, 4220, 4225, 4218, 4200, 4150], HIGH, None, [("p1", 3, 0.440810, True)]),
    "climb": (NEAR, [3800, 3900, 4050, 4100, 4040, 3900, 3800], BARE, None, [("p3", 3, 0.751158, False)]),
    "flat": (NEAR, [3900, 3902, 3901, 3903, 3900, 3902, 3901], BARE, None, [("p3", 3, 0.555204, False)]),
    "no altitude": (WIDE, None, HIGH, None, [("p1", 3, 0.491725, True)]),
}


def frames(spark, name):
    xy, alt, sites, times, _ = CASES[name]
    rows = [(name, i, float(times[i] if times else 30 * i), lat, -105.0 - off, float(alt[i]) if alt else None) for i, (off, lat) in enumerate(xy)]
    return spark.createDataFrame(rows, POINT), spark.createDataFrame(sites, SITE)


@pytest.mark.parametrize("name", CASES)
def test_known_tracks(spark, name):
    found = sorted((r.site_id, r.idx, round(r.confidence, 6), r.needs_confirmation) for r in visits.detect_visits(*frames(spark, name)).collect())
    assert found == CASES[name][4]


def metres(a, b):
    lat1, lat2 = math.radians(a[0]), math.radians(b[0])
    c = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(c), math.sqrt(1 - c))


def machine(track, site):
    """(samples, first, last) of each visit, one point after the other; mode A."""
    out, now = [], None
    for idx, t, lat, lng in track:
        d = metres((lat, lng), site)
        box = abs(site[0] - lat) <= 100 / 110574 and abs(site[1] - lng) <= 100 / (111320 * math.cos(math.radians(site[0])))
        if now is None:
            if box and d <= 100:
                now = [1, idx, idx, t]
        elif d <= 100:
            now = [now[0] + 1, now[1], idx, t]
        elif d >= 150 and t - now[3] >= scores.RESET_SECONDS:
            out.append(tuple(now[:3]))
            now = None
    return out + ([tuple(now[:3])] if now else [])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 200), st.sampled_from([0.0, 0.0005, 0.0008, 0.00089, 0.0012, 0.0014, 0.003])), min_size=1, max_size=30), min_size=1, max_size=20))
def test_windows_equal_the_sequential_machine(spark, tracks):
    rows, want = [], []
    for k, steps in enumerate(tracks):
        t, track = 0.0, []
        for i, (gap, off) in enumerate(steps):
            t += gap
            track.append((i, t, 40.0 + off * (i % 2), -105.0 - off * 1.17 * ((i + 1) % 2)))
        rows += [(str(k), i, t, lat, lng, 4000.0) for i, t, lat, lng in track]
        want += [(str(k), *v) for v in machine(track, (40.0, -105.0))]
    found = visits.visit_rows(spark.createDataFrame(rows, POINT), spark.createDataFrame(HIGH[:1], SITE))
    got = found.groupBy("track_id", "visit").agg({"*": "count", "idx": "min"}).collect()
    ends = {(r.track_id, r.visit): r["max(idx)"] for r in found.groupBy("track_id", "visit").agg({"idx": "max"}).collect()}
    assert sorted((r.track_id, r["count(1)"], r["min(idx)"], ends[r.track_id, r.visit]) for r in got) == sorted(want)


def test_nothing_from_nothing(spark):
    points, sites = frames(spark, "high")
    assert visits.detect_visits(points.limit(0), sites).count() == 0
    assert visits.detect_visits(points, sites.limit(0)).count() == 0
