"""Repair of polygons: what the even-odd rule fills, as rings that are simple and don't cross.

Corners are rounded to a fine grid and edges are cut where they meet, until no two of them meet but at their ends (crossings are
rounded to the grid, so this may take some rounds). Edges that lie on each other cancel by pairs: crossing two at once leaves the
filling as it is. Those that are left part filled from empty, and the borders of the filled faces, parted where they touch
themselves, are the new rings: outer ones against the clock, holes with it. All coordinates are whole numbers on the way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import vertex_count

#: Degrees of a step of the grid (a centimetre), and steps across a polygon at most; a larger one has a coarser grid.
STEP, WIDEST = 1e-7, 1 << 30
#: Candidate pairs of edges that are looked at together; rounds of cutting at most.
PAIRS, ROUNDS = 1 << 20, 25


class Unsound(ValueError):
    """A polygon that can't be repaired."""


def _orient(a, b, c) -> np.ndarray:
    """On which side of ab c lies."""
    return np.sign((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))


def _candidates(a: np.ndarray, b: np.ndarray):
    """Pairs of edges whose boxes meet, a bounded number at a time."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    until = np.searchsorted(low[order, 0], high[order, 0], side="right")
    count = until - np.arange(len(order)) - 1
    begin = 0
    total = np.concatenate([[0], np.cumsum(count)])
    while begin < len(order):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, side="right")) - 1)
        n = count[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[i], order[j]
        meet = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield i[meet], j[meet]
        begin = end


def _cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, place) of every place strictly inside an edge at which another one meets it."""
    edges, places = [np.zeros(0, int)], [np.zeros((0, 2), np.int64)]

    def add(edge, place):
        inner = (place != a[edge]).any(axis=1) & (place != b[edge]).any(axis=1)
        edges.append(edge[inner])
        places.append(place[inner])

    for i, j in _candidates(a, b):
        p, q, r, s = a[i], b[i], a[j], b[j]
        d1, d2, d3, d4 = _orient(p, q, r), _orient(p, q, s), _orient(r, s, p), _orient(r, s, q)
        for side, edge, start, end, point in ((d1, i, p, q, r), (d2, i, p, q, s), (d3, j, r, s, p), (d4, j, r, s, q)):
            on = (side == 0) & (np.minimum(start, end) <= point).all(axis=1) & (point <= np.maximum(start, end)).all(axis=1)
            add(edge[on], point[on])
        cross = (d1 * d2 < 0) & (d3 * d4 < 0)
        p, q, r, s = (x[cross].astype(float) for x in (p, q, r, s))
        u, v = q - p, s - r
        t = ((r - p)[:, 0] * v[:, 1] - (r - p)[:, 1] * v[:, 0]) / (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        place = np.rint(p + t[:, None] * u).astype(np.int64)
        add(i[cross], place)
        add(j[cross], place)
    return np.concatenate(edges), np.concatenate(places)


def noded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Edges (from a to b) cut so that no two meet but at their ends; and whether any was cut."""
    cut = False
    for _ in range(ROUNDS):
        edge, place = _cuts(a, b)
        if not len(edge):
            return a, b, cut
        cut = True
        along = (np.abs(place - a[edge])).sum(axis=1)  # grows from a to b, as the places lie on the edge
        order = np.lexsort((along, edge))
        edge, place = edge[order], place[order]
        # the corners of each edge: its start, its cuts, its end
        who = np.concatenate([np.arange(len(a)), edge, np.arange(len(a))])
        rank = np.concatenate([np.full(len(a), -1), np.arange(len(edge)), np.full(len(a), len(edge))])
        points = np.concatenate([a, place, b])
        order = np.lexsort((rank, who))
        who, points = who[order], points[order]
        same = who[1:] == who[:-1]
        a, b = points[:-1][same], points[1:][same]
        long = (a != b).any(axis=1)
        a, b = a[long], b[long]
    raise Unsound(f"edges still cross after {ROUNDS} rounds")


def _simple(walk: list[int]) -> list[list[int]]:
    """A closed walk as the cycles between its repeated corners."""
    out, path, at = [], [], {}
    for v in walk:
        if v in at:
            out.append(path[at[v] :])
            for u in path[at[v] + 1 :]:
                del at[u]
            path = path[: at[v] + 1]
        else:
            at[v] = len(path)
            path.append(v)
    return [c for c in [*out, path] if len(c) > 2]


def rings_of(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The borders of what noded edges fill by the even-odd rule."""
    points, ends = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
    u, v = ends.ravel()[: len(a)], ends.ravel()[len(a) :]
    pairs, n = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0, return_counts=True)
    pairs = pairs[n % 2 == 1]
    if not len(pairs):
        return []
    m = len(pairs)
    start, end = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])  # edge k and its way back k + m
    delta = (points[end] - points[start]).astype(float)
    order = np.lexsort((np.arctan2(delta[:, 1], delta[:, 0]), start))
    first = np.searchsorted(start[order], np.arange(len(points)))
    last = np.searchsorted(start[order], np.arange(len(points)), side="right")
    place = np.empty(2 * m, int)
    place[order] = np.arange(2 * m)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    # a face lies on the left: at its end an edge is followed by the one before the way back, against the clock
    at = place[back]
    follow = order[np.where(at == first[end], last[end] - 1, at - 1)].tolist()
    face, walks = np.full(2 * m, -1), []
    for h in range(2 * m):
        if face[h] < 0:
            walk, k = [], h
            while face[k] < 0:
                face[k] = len(walks)
                walk.append(k)
                k = follow[k]
            walks.append(walk)
    # the face left of a component's first corner is filled as the others have it there; across an edge it is the other way
    filled: dict[int, bool] = {}
    p, q = points[pairs[:, 0]].astype(float), points[pairs[:, 1]].astype(float)
    back_face, own_face = face[back].tolist(), face.tolist()
    for corner in range(len(points)):  # points are in order of their first coordinate
        if first[corner] == last[corner] or own_face[order[first[corner]]] in filled:
            continue
        # the border's first corner: its outer face is on the left of the edge that comes last against the clock from below
        around = order[first[corner] : last[corner]]
        outer = own_face[int(around[-1])]
        x, y = points[corner]
        over = (p[:, 1] > y) != (q[:, 1] > y)
        with np.errstate(all="ignore"):
            meets = p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0])
        filled[outer] = bool((over & (meets < x)).sum() % 2)
        stack = [outer]
        while stack:
            f = stack.pop()
            for h in walks[f]:
                g = back_face[h]
                if g not in filled:
                    filled[g] = not filled[f]
                    stack.append(g)
    inside = (walk for f, walk in enumerate(walks) if filled[f])
    return [points[cycle] for walk in inside for cycle in _simple(start[walk].tolist())]


def repaired(rings: list[np.ndarray]) -> tuple[list[np.ndarray], bool]:
    """Closed rings that are simple and don't cross, of what ``rings`` fill by the even-odd rule; and whether they were so before."""
    sound = [r for r in rings if len(r)]
    if not sound or not all(np.isfinite(r).all() for r in sound):
        raise Unsound("no corners, or one that isn't finite")
    corners = np.concatenate(sound)
    low = corners.min(axis=0)
    step = max(STEP, float((corners.max(axis=0) - low).max()) / WIDEST)
    a, b, good = [], [], len(sound) == len(rings)
    for r in sound:
        good &= len(r) > 3 and bool((r[0] == r[-1]).all())
        g = np.rint((r - low) / step).astype(np.int64)
        g = g if (g[0] == g[-1]).all() else np.concatenate([g, g[:1]])
        keep = (g[1:] != g[:-1]).any(axis=1)
        good &= bool(keep.all())
        a.append(g[:-1][keep])
        b.append(g[1:][keep])
        good &= len(np.unique(a[-1], axis=0)) == len(a[-1])  # no corner twice in a ring
    a, b, cut = noded(np.concatenate(a), np.concatenate(b))
    ends = np.sort(np.stack([a[:, 0] << 32 | a[:, 1], b[:, 0] << 32 | b[:, 1]], axis=1), axis=1)
    good &= not cut and len(np.unique(ends, axis=0)) == len(ends)
    if good:
        return rings, True
    return [np.concatenate([r, r[:1]]) * step + low for r in rings_of(a, b)], False


def _numbered(polygons: DataFrame) -> DataFrame:
    """polygons with ``_row``, a hash of their rings: a repair depends on nothing else, so equal rings are repaired once."""
    return polygons.withColumn("_row", F.xxhash64(F.to_json("rings")))


def _different(rows: DataFrame) -> DataFrame:
    """_row, _lngs, _lats of the rings that differ, dealt out and smallest first in each task."""
    size = F.coalesce(vertex_count("rings"), F.lit(0))
    coordinate = lambda name: F.transform("rings", lambda r: F.transform(r, lambda p: p[name])).alias(f"_{name}s")
    return rows.select("_row", "rings").dropDuplicates(["_row"]).select("_row", coordinate("lng"), coordinate("lat"), size.alias("_n")).repartition("_row").sortWithinPartitions("_n").drop("_n")


def repair(polygons: DataFrame) -> DataFrame:
    """polygons with ``rings`` repaired, and ``repair``: valid, repaired, empty (nothing is left) or the reason why it failed.

    Polygons are dealt out by their rings, equal ones together, and taken smallest first in each task; one that can't be repaired, as it has no corners or
    some that aren't finite, keeps its rings and stops no other. Rings that are valid stay as they are, to the last digit.
    """
    corners = "array<array<struct<lng:double,lat:double>>>"

    def run(batches):
        for batch in batches:
            out, said = [], []
            for lngs, lats in zip(batch["_lngs"], batch["_lats"], strict=True):
                try:
                    rings = [np.array([x, y], float).T for x, y in zip(lngs, lats, strict=True)] if lngs is not None else []
                    new, good = repaired(rings)
                    said.append("valid" if good else "repaired" if new else "empty")
                    out.append(None if good else [[{"lng": x, "lat": y} for x, y in r.tolist()] for r in new])
                except (Unsound, TypeError, ValueError) as e:
                    said.append(str(e)[:200])
                    out.append(None)
            yield pd.DataFrame({"_row": batch["_row"], "_new": out, "repair": said})

    rows = _numbered(polygons)
    found = _different(rows).mapInPandas(run, f"_row long, _new {corners}, repair string")
    return rows.join(found, "_row").withColumn("rings", F.coalesce("_new", "rings")).select(*polygons.columns, "repair")
