"""Repaired polygons: areas by hand, and the even-odd rule point by point."""

import math

import numpy as np
import pytest

from tarnspark.operators import repair


def ring(*corners):
    return np.array(corners, float)


def square(x, y, side):
    return ring((x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y))


def area(rings):
    return sum(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2 for r in rings)


def inside(rings, places):
    n = np.zeros(len(places), int)
    for r in rings:
        p, q = r[:-1], r[1:]
        for i, (x, y) in enumerate(places):
            over = (p[:, 1] > y) != (q[:, 1] > y)
            n[i] += int((x < p[over, 0] + (y - p[over, 1]) / (q[over, 1] - p[over, 1]) * (q[over, 0] - p[over, 0])).sum())
    return n % 2 == 1


#: Rings, the area they fill and the rings that are left.
CASES = {
    "bow tie": ([ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))], 2.0, 2),
    "overlapping holes": ([square(0, 0, 10), square(2, 2, 4), square(4, 4, 4)], 100 - 16 - 16 + 2 * 4, 3),
    "hole touches the shell": ([square(0, 0, 4), ring((0, 2), (2, 1), (2, 3), (0, 2))], 14.0, 2),
    "hole shares an edge": ([square(0, 0, 4), square(0, 1, 2)], 12.0, 1),
    "common edge": ([square(0, 0, 2), square(2, 0, 2)], 8.0, 1),
    "common corner": ([square(0, 0, 2), square(2, 2, 2)], 8.0, 2),
    "repeated corners": ([ring((0, 0), (0, 0), (3, 0), (3, 0), (3, 3), (0, 3), (0, 0))], 9.0, 1),
    "open": ([ring((0, 0), (3, 0), (3, 3), (0, 3))], 9.0, 1),
    "spike": ([ring((0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4), (0, 0))], 16.0, 1),
    "twice": ([square(0, 0, 2), square(0, 0, 2)], 0.0, 0),
    "line": ([ring((0, 0), (4, 4), (0, 0))], 0.0, 0),
    "touches itself": ([ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0))], 8.0, 2),
    "inner loop": ([ring((0, 0), (6, 0), (6, 6), (3, 2), (3.5, 3), (2.5, 3), (3, 2), (0, 6), (0, 0))], 36 - 12 + 0.5, 2),
    "island with a bow tie for a hole": ([square(0, 0, 9), square(1, 1, 7), square(2, 2, 5), ring((3, 3), (5, 5), (5, 3), (3, 5), (3, 3))], 81 - 49 + 25 - 2, 5),
}


@pytest.mark.parametrize("name", CASES)
def test_areas_by_hand(name):
    rings, want, n = CASES[name]
    new, good = repair.repaired(rings)
    assert area(new if new is not rings else rings) == pytest.approx(want, abs=1e-5) or good
    if name == "common corner":
        assert good  # two squares that meet in a corner are sound
        return
    assert not good and len(new) == n
    if new:
        again, sound = repair.repaired(new)
        assert sound and again is new


@pytest.mark.parametrize("seed", range(30))
def test_random_rings_fill_the_same_places(seed):
    rng = np.random.default_rng(seed)
    rings = []
    for _ in range(rng.integers(1, 4)):
        corners = rng.integers(0, 10, (rng.integers(3, 25), 2)).astype(float) if seed % 2 else rng.random((rng.integers(3, 25), 2)) * 10
        rings.append(np.concatenate([corners, corners[:1]]))
    new, good = repair.repaired(rings)
    places = rng.random((200, 2)) * 10
    assert (inside(rings, places) == inside(new, places)).all()
    assert repair.repaired(new)[1]
    # holes go the other way, so signed areas add up to what is filled
    grid = np.stack(np.meshgrid(np.arange(60) / 6 + 0.081, np.arange(60) / 6 + 0.083), axis=-1).reshape(-1, 2)
    assert good or area(new) == pytest.approx(inside(rings, grid).sum() / 36, abs=3.0)


def test_a_large_polygon_with_one_tangle():
    a = np.arange(60_000) / 60_000 * 2 * math.pi
    r = 1 + 0.3 * np.sin(7 * a)
    big = np.stack([r * np.cos(a), r * np.sin(a)], axis=1)
    big = np.concatenate([big, big[:1]])
    assert repair.repaired([big])[1]
    tangled = big.copy()
    tangled[500:520] = tangled[500:520][::-1]
    new, good = repair.repaired([tangled])
    assert not good and area(new) == pytest.approx(area([big]), abs=1e-4) and repair.repaired(new)[1]


def test_failures_stop_no_other(spark):
    as_rows = lambda parts: [[(float(x), float(y)) for x, y in r] for r in parts]
    rows = [(i, as_rows(CASES[name][0]), name) for i, name in enumerate(CASES)]
    rows += [(90, None, "null"), (91, [], "none"), (92, [[]], "empty ring"), (93, [[(float("nan"), 0.0), (1.0, 1.0), (2.0, 0.0)]], "nan"), (94, as_rows([square(0, 0, 1)]), "sound"), (0, as_rows(CASES["bow tie"][0]), "same again")]
    found = repair.repair(spark.createDataFrame(rows, "poly_id int, rings array<array<struct<lng:double,lat:double>>>, repair_note string")).collect()
    assert len(found) == len(rows)
    said = {r["repair_note"]: r["repair"] for r in found}
    assert said["sound"] == said["common corner"] == "valid" and said["twice"] == said["line"] == "empty"
    assert all(said[n].startswith("no corners") for n in ("null", "none", "empty ring", "nan"))
    assert all(said[n] == "repaired" for n in CASES if n not in ("common corner", "twice", "line"))
    assert {r["repair_note"]: r["rings"] for r in found}["nan"][0][1]["lng"] == 1.0


def test_equal_rings_are_repaired_once(spark):
    """Copies under other keys cost no more repairs, and each gets the result."""
    as_rows = lambda parts: [[(float(x), float(y)) for x, y in r] for r in parts]
    names = ["bow tie", "hole shares an edge", "twice"]
    frame = spark.createDataFrame([(i, as_rows(CASES[names[i % 3]][0])) for i in range(60)] + [(60, None)], "poly_id int, rings array<array<struct<lng:double,lat:double>>>")
    assert repair._different(repair._numbered(frame)).count() == 4
    found = {r.poly_id: r for r in repair.repair(frame).collect()}
    assert len(found) == 61 and found[60].repair.startswith("no corners")
    for i in range(60):
        new, _ = repair.repaired(CASES[names[i % 3]][0])
        assert found[i].repair == ("repaired" if new else "empty")
        assert [[(p["lng"], p["lat"]) for p in r] for r in found[i].rings] == [[tuple(p) for p in r.tolist()] for r in new]
