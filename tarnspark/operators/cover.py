"""Points in polygons of any size, by a cover of each polygon with the cells of a quadtree.

The cells of level l are squares of 360 / 2**l degrees. A polygon is clipped to the cells that hold it, level by level,
LEVELS at a time: a cell that no edge crosses is wholly inside, and done, or wholly outside, and dropped; one with at most CORNERS
corners keeps its clipped rings; any other is split, the fullest first, while all cells together have no more than SPREAD times the
polygon's corners (edges much longer than a cell are in many). So the cells of a cover are disjoint, and the work for a polygon
and what its cover holds follow its corners. A point looks for its own cell on each level that occurs: an
equi-join, in which it meets a polygon once at most, and only in cells that an edge crosses a ray is cast, over their few corners.

A cell has its west and south edge and not the other two, as even-odd ray casting has it, so cells agree with the whole polygon.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from ..functions.geo import in_rings
from ..session import cut

#: Corners that a cell may keep; levels that a split goes down; the finest level (cells of 5 m or so).
CORNERS, LEVELS, FINEST = 96, 2, 23
#: Corners of all cells as a multiple of the polygon's, and the least that it comes to.
SPREAD, LEAST = 8, 10_000
#: Points x corners of a cell from which rays are cast in blocks; points and cells of a block; points met by edges at a time.
CROWD, BLOCK, PAIRS = 100_000, (10_000, 200), 2_000_000


def width(level: int) -> float:
    return 360.0 / 2**level


def _clip(ring: np.ndarray, axis: int, at: float, below: bool) -> np.ndarray:
    """A ring (corners, without the first one again) cut off at a line; what is left is closed along the line."""
    if not len(ring):
        return ring
    side = ring[:, axis] <= at if below else ring[:, axis] >= at
    if side.all():
        return ring
    if not side.any():
        return ring[:0]
    after, follows = np.roll(ring, -1, axis=0), np.roll(side, -1)
    cross = side != follows
    with np.errstate(all="ignore"):
        t = (at - ring[:, axis]) / (after[:, axis] - ring[:, axis])
        met = ring + t[:, None] * (after - ring)
    met[:, axis] = at
    both = np.stack([ring, met], axis=1).reshape(-1, 2)
    return both[np.stack([side, cross], axis=1).ravel()]


def _inside(rings: list[np.ndarray], x: float, y: float) -> bool:
    n = 0
    for ring in rings:
        a, b = ring, np.roll(ring, -1, axis=0)
        over = (a[:, 1] > y) != (b[:, 1] > y)
        a, b = a[over], b[over]
        n += int((x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).sum())
    return n % 2 == 1


def _crossed(rings: list[np.ndarray], west: float, south: float, east: float, north: float) -> bool:
    """Whether an edge leaves the cell's border."""
    for ring in rings:
        after = np.roll(ring, -1, axis=0)
        on = np.zeros(len(ring), bool)
        for axis, at in ((0, west), (0, east), (1, south), (1, north)):
            on |= (ring[:, axis] == at) & (after[:, axis] == at)
        if not on.all():
            return True
    return False


def _split(rings: list[np.ndarray], level: int, within: tuple[int, int] | None) -> Iterator[tuple[int, int, bool, list[np.ndarray]]]:
    """(x, y, whole, rings) of the cells of a level that the rings reach, within a cell LEVELS above it."""
    side = width(level)
    corners = np.concatenate(rings)
    first, last = (np.floor((f(corners, axis=0) + 180.0) / side).astype(int) for f in (np.min, np.max))
    if within:  # corners on its far border belong to its own last cells
        last = np.minimum(last, [(i + 1) * 2**LEVELS - 1 for i in within])
    for x in range(first[0], last[0] + 1):
        west, east = x * side - 180.0, (x + 1) * side - 180.0
        column = [_clip(_clip(r, 0, west, False), 0, east, True) for r in rings]
        for y in range(first[1], last[1] + 1):
            south, north = y * side - 180.0, (y + 1) * side - 180.0
            own = [r for c in column if len(r := _clip(_clip(c, 1, south, False), 1, north, True)) > 2]
            if not own:
                continue
            if _crossed(own, west, south, east, north):
                yield x, y, False, own
            elif _inside(own, (west + east) / 2, (south + north) / 2):
                yield x, y, True, []


def cells_of(rings: list[np.ndarray]) -> Iterator[tuple[int, int, int, bool, list[np.ndarray]]]:
    """(level, x, y, whole, rings) of each cell of a polygon's cover."""
    corners = np.concatenate([np.zeros((0, 2)), *rings])
    if not len(corners) or not np.isfinite(corners).all():
        return
    span = float((corners.max(axis=0) - corners.min(axis=0)).max())
    # the finest level at which the polygon is no wider than a cell, so four cells hold it at most
    start = max(0, min(FINEST, int(np.floor(np.log2(360.0 / span))) if span > 0 else FINEST)) // LEVELS * LEVELS
    rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
    room, held, order = max(LEAST, SPREAD * len(corners)), len(corners), count()
    work = [(0, next(order), start, None, rings)]
    while work:
        _, _, level, within, rings = heappop(work)
        held -= sum(map(len, rings))
        for x, y, whole, own in _split(rings, level, within):
            n = sum(map(len, own))
            held += n
            if whole:
                yield level, x, y, True, []
            elif n <= CORNERS or level + LEVELS > FINEST or held > room:
                yield level, x, y, False, [np.concatenate([r, r[:1]]) for r in own]
            else:
                heappush(work, (-n, next(order), level + LEVELS, (x, y), own))


@udtf(returnType="level int, x long, y long, whole boolean, lngs array<array<double>>, lats array<array<double>>", useArrow=True)
class Cover:
    """The cover of a polygon, from its rings' longitudes and latitudes."""

    def eval(self, lngs: list, lats: list):
        if lngs is None or lats is None:
            return
        rings = [np.array([a, b], float).T for a, b in zip(lngs, lats, strict=True) if a is not None and len(a) > 2]
        for level, x, y, whole, parts in cells_of(rings):
            yield level, x, y, whole, [r[:, 0].tolist() for r in parts], [r[:, 1].tolist() for r in parts]


def cover(polygons: DataFrame) -> DataFrame:
    """polygons (rings) by the cells of their covers: level, x, y, whole, and ``rings`` clipped to the cell; none for a whole one.

    A polygon without rings or with a corner that isn't finite has no cells. Other columns are kept, once for each cell.
    """
    coordinate = lambda name: F.transform("rings", lambda r: F.transform(r, lambda p: p[name])).outer()
    cells = polygons.lateralJoin(Cover(coordinate("lng"), coordinate("lat"))).drop(polygons["rings"])
    corners = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x.alias("lng"), y.alias("lat")))
    return cells.withColumn("rings", F.zip_with("lngs", "lats", corners)).drop("lngs", "lats")


def cell_on(level: int, lng: Column, lat: Column) -> Column:
    at = lambda c: F.floor((c + 180.0) / width(level)).cast("long")
    return F.struct(F.lit(level).alias("level"), at(lng).alias("x"), at(lat).alias("y"))


def _edges(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first corner and last corner (lng, lat) of each edge of rows of closed rings."""
    parts = rings.flatten()
    n_rings, n_corners = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (rings, parts))
    corners = parts.flatten()
    at = np.stack([corners.field(c).to_numpy(zero_copy_only=False) for c in ("lng", "lat")], axis=1)
    ring = np.repeat(np.arange(len(n_corners)), n_corners)
    joined = np.flatnonzero(ring[:-1] == ring[1:])
    return np.repeat(np.arange(len(n_rings)), n_rings)[ring[joined]], at[joined], at[joined + 1]


def _rays(lng: np.ndarray, lat: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and polygons (0 to n - 1) of the pairs in which an odd number of the polygon's edges lies east of the point.

    Points in the order of latitude: those that an edge's latitudes hold are neighbours, and no other is compared with it.
    """
    order = np.argsort(lat, kind="stable")
    x, y = lng[order], lat[order]
    first, last = (np.searchsorted(y, f(a[:, 1], b[:, 1])) for f in (np.minimum, np.maximum))
    met, crossed = last - first, np.zeros(n * len(y), np.int32)
    # so many edges at a time that they meet PAIRS points or so
    bounds = np.searchsorted(np.cumsum(met), np.arange(PAIRS, int(met.sum()) + PAIRS, PAIRS), side="left") + 1
    start = 0
    for end in bounds.tolist():
        e = np.repeat(np.arange(start, min(end, len(met))), met[start:end])
        k = np.arange(len(e)) - np.repeat(np.cumsum(met[start:end]) - met[start:end], met[start:end]) + first[e]
        east = x[k] < (b[e, 0] - a[e, 0]) * (y[k] - a[e, 1]) / (b[e, 1] - a[e, 1]) + a[e, 0]
        crossed += np.bincount(owner[e[east]] * len(y) + k[east], minlength=len(crossed)).astype(np.int32)
        start = end
    polygon, point = np.divmod(np.flatnonzero(crossed % 2), max(1, len(y)))
    return order[point], polygon


def _dealt(points: DataFrame, cells: DataFrame, crowds: DataFrame) -> DataFrame:
    """points inside cut cells (_cell, _rings) of crowds (_cell, _n, _m): blocks of BLOCK points meet blocks of cells, each pair in one task."""
    shares = crowds.select("_cell", F.ceil(F.col("_n") / BLOCK[0]).cast("int").alias("_k"), F.ceil(F.col("_m") / BLOCK[1]).cast("int").alias("_l"))
    plain = [c for c in points.columns if c != "_cell" and points.schema[c].dataType.typeName() not in ("map", "variant")]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = points.join(F.broadcast(shares), "_cell").withColumn("_i", F.pmod(F.xxhash64(*plain), F.col("_k")).cast("int")).withColumn("_j", every("_l")).drop("_k", "_l")
    c = cells.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(shares), "_cell")
    c = c.withColumn("_j", F.pmod("_id", F.col("_l")).cast("int")).withColumn("_i", every("_k")).drop("_id", "_k", "_l")
    here = [x for x in points.columns if x != "_cell"]
    there = [x for x in cells.columns if x not in ("_cell", "_rings")]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        owner, a, b = _edges(pa.concat_arrays(right["_rings"].chunks))
        point, polygon = _rays(*(left[x].to_numpy().astype(float) for x in ("lng", "lat")), owner, a, b, len(right))
        return pa.table([*(left[x].take(pa.array(point)) for x in here), *(right[x].take(pa.array(polygon)) for x in there)], names=[*here, *there])

    schema = StructType([*(points.schema[x] for x in here), *(cells.schema[x] for x in there)])
    keys = ["_cell", "_i", "_j"]
    return p.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet, schema)


def in_cover(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (lat, lng) with the columns of the polygons whose cover's cells they lie in, once for each polygon.

    ``cells`` is read a few times and should be written or cached; its levels, a dozen at most, come to the driver. Whole cells need
    an equi-join only. Where many points meet many corners rays are cast block by block, elsewhere pair by pair. A column that both
    have comes twice, the points' first, as in a join.
    """
    own = [x for x in cells.columns if x not in ("level", "x", "y", "whole", "rings")]
    names = [*points.columns, *own]
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())
    if not levels:
        levels = [0]
    looks = F.array(*[cell_on(level, F.col("lng"), F.col("lat")) for level in levels])
    sound = F.col("lng").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lng") & ~F.isnan("lat")
    p = points.where(sound).withColumn("_cell", F.explode(looks))
    c = cells.select(F.struct("level", "x", "y").alias("_cell"), F.col("whole").alias("_whole"), F.col("rings").alias("_rings"), *[F.col(x).alias(f"_own{i}") for i, x in enumerate(own)])
    sizes = c.where(~F.col("_whole")).groupBy("_cell").agg(F.count("*").alias("_m"), F.sum(F.size(F.flatten("_rings"))).alias("_corners"))
    counts = p.groupBy("_cell").agg(F.count("*").alias("_n"))
    crowds = cut(sizes.join(counts, "_cell").where(F.col("_n") * F.col("_corners") >= CROWD).select("_cell", "_n", "_m"))
    if crowds.isEmpty():
        return p.join(c, "_cell").where(F.col("_whole") | in_rings("lng", "lat", "_rings")).drop("_cell", "_whole", "_rings").toDF(*names)
    rest = c.join(F.broadcast(crowds.select("_cell", F.lit(True).alias("_crowd"))), "_cell", "left").where(F.col("_whole") | F.col("_crowd").isNull()).drop("_crowd")
    apart = p.join(rest, "_cell").where(F.col("_whole") | in_rings("lng", "lat", "_rings")).drop("_cell", "_whole", "_rings")
    return apart.unionByName(_dealt(p, c.where(~F.col("_whole")).drop("_whole"), crowds)).toDF(*names)


def in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """points (lat, lng) inside polygons (rings, by the even-odd rule), with the polygons' columns but ``rings``."""
    return in_cover(points, cut(cover(polygons)))
