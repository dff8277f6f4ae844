"""Collision-free assignment: seeds claim the first of their candidates that no other seed has claimed nearby."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M
from ..session import cut
from .cells import cell, cells_around


def _metres(a, b) -> float:
    lat1, lat2 = math.radians(a[0]), math.radians(b[0])
    chord = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(chord), math.sqrt(1 - chord))


#: A tile's side as a multiple of the radius; seeds of a tile that one task settles at once, beyond which a tile is quartered; tilings,
#: each moved against the others, so that what lies at a border of one lies inside a tile of another.
SIDE, TILE, TILINGS = 64, 5000, 3


def _settle(batch: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Claims of one group, seed after seed."""
    batch = batch.sort_values(["elevation", "seed_id", "rank"], ascending=[False, True, True], na_position="last")
    taken, out = [], []
    for seed, own in batch.groupby("seed_id", sort=False):
        places = list(zip(own["rank"], own["lat"], own["lng"], strict=True))
        free = next((p for p in places if all(_metres(p[1:], t) > radius for t in taken)), None)
        chosen = free or places[0]
        taken.append(chosen[1:])
        out.append((seed, int(chosen[0]), free is None))
    return pd.DataFrame(out, columns=["seed_id", "rank", "collided"])


class _Ground:
    """Places by squares, so that what is within the radius of a place is looked for among its neighbours only."""

    def __init__(self, radius: float):
        self.radius, self.places = radius, defaultdict(dict)

    def _square(self, place) -> tuple[int, int, int]:
        """The cube of the sphere's space that a place lies in, a little wider than the radius."""
        lat, lng = math.radians(place[0]), math.radians(place[1])
        side = self.radius * 1.0001 + 1e-3
        return tuple(math.floor(EARTH_RADIUS_M * x / side) for x in (math.cos(lat) * math.cos(lng), math.cos(lat) * math.sin(lng), math.sin(lat)))

    def add(self, place) -> None:
        if all(map(math.isfinite, place)):
            self.places[self._square(place)][place] = None  # a place that is taken twice is one

    def met(self, place) -> bool:
        """A place without coordinates meets nothing."""
        if not all(map(math.isfinite, place)):
            return False
        x, y, z = self._square(place)
        near = (self.places.get((x + i, y + j, z + k), ()) for i in (0, -1, 1) for j in (0, -1, 1) for k in (0, -1, 1))
        return any(_metres(place, other) <= self.radius for own in near for other in own)


def _pass(batch: pd.DataFrame, radius: float) -> pd.DataFrame:
    """One pass over a tile in the order of turns: what its own seeds claim, as far as no seed before them that isn't settled can reach them.

    Seeds of other tiles are there for their claims; without one they are unsettled. Rows: seed_id, ranks, lats, lngs, home, claim.
    """
    taken, unsettled, out = _Ground(radius), _Ground(radius), []
    batch = batch.sort_values(["low", "height", "seed_id"])
    for seed, ranks, lats, lngs, home, claim in zip(*(batch[c] for c in ("seed_id", "ranks", "lats", "lngs", "home", "claim")), strict=True):
        places = [(float("nan") if a is None else float(a), float("nan") if b is None else float(b)) for a, b in zip(lats, lngs, strict=True)]
        if claim >= 0:
            taken.add(places[int(claim)])
        elif not home or any(map(unsettled.met, places)):
            for p in places:
                unsettled.add(p)
        else:
            free = next((i for i, p in enumerate(places) if not taken.met(p)), None)
            taken.add(places[free or 0])
            out.append((seed, free or 0, free is None))
    return pd.DataFrame(out, columns=["seed_id", "claim", "collided"])


def _tiles(seeds: DataFrame, radius: float, most: int, shift: float) -> DataFrame:
    """seed_id -> tile: seeds by the square in which their first candidate lies; a square of more than ``most`` seeds is cut into quarters, down to a few radii. ``shift``: by what part of a square the squares are moved."""
    side, tiles, crowded = SIDE * radius, None, seeds
    while True:
        own = crowded.select("seed_id", "lat", "lng", F.struct(F.lit(side).alias("side"), cell(F.col("lat") + shift * side / 110000.0, F.col("lng") + shift * side / 110000.0, side).alias("at")).alias("tile"))
        full = own.groupBy("tile").count().where(F.col("count") > most).select("tile") if side > 8 * radius else own.select("tile").limit(0)
        fits = own.join(full, "tile", "left_anti").select("seed_id", "tile")
        tiles = fits if tiles is None else tiles.unionByName(fits)
        if full.isEmpty():
            return tiles
        crowded, side = cut(own.join(full, "tile", "left_semi").select("seed_id", "lat", "lng")), side / 2


def in_rounds(rows: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """seed_id, rank, collided of all seeds (rows: seed_id, elevation, rank, lat, lng), by rounds over tiles.

    In a round each tile settles, in one pass over its seeds, all those that wait for no unsettled seed of another tile. Seeds that
    can reach a tile's are known there with what they have claimed. So a round is needed for each border that a chain of waiting
    seeds crosses, not for each link of it. No edges are made, so seeds that crowd at one place cost no more than their number.
    """
    kind = rows.schema["seed_id"].dataType.simpleString()
    place = F.array_sort(F.collect_list(F.struct("rank", "lat", "lng")))
    low, height = F.col("elevation").isNull(), -F.coalesce("elevation", F.lit(0.0))
    seeds = rows.groupBy("seed_id").agg(F.first(low).alias("low"), F.first(height).alias("height"), place.alias("_p"))
    seeds = cut(seeds.select("seed_id", "low", "height", *[F.col("_p")[c].alias(f"{c}s") for c in ("rank", "lat", "lng")]))
    at = seeds.select("seed_id", F.inline(F.arrays_zip("lats", "lngs"))).toDF("seed_id", "lat", "lng")

    def tiling(shift: float) -> DataFrame:
        """Each tile's seeds, and those that can reach them."""
        tiles = cut(_tiles(seeds.select("seed_id", F.col("lats")[0].alias("lat"), F.col("lngs")[0].alias("lng")), radius, most or TILE, shift))
        reach = at.join(tiles, "seed_id").select("tile", F.explode(cells_around(F.col("lat"), F.col("lng"), radius)).alias("_cell")).distinct()
        near = at.select("seed_id", cell(F.col("lat"), F.col("lng"), radius).alias("_cell")).distinct().join(reach, "_cell").select("seed_id", "tile")
        known = near.withColumn("home", F.lit(False)).unionByName(tiles.withColumn("home", F.lit(True))).groupBy("seed_id", "tile").agg(F.max("home").alias("home"))
        return cut(known)

    parts, state = [], seeds.select("seed_id", F.lit(-1).alias("claim"), F.lit(None).cast("boolean").alias("collided"))
    turn = 0
    while not state.where("claim < 0").isEmpty():
        if turn < TILINGS:
            parts.append(tiling(turn / TILINGS))
        part = parts[turn % TILINGS]
        # only tiles with unsettled seeds go on
        open_ = part.where("home").join(state.where("claim < 0"), "seed_id", "left_semi").select("tile").distinct()
        now = part.join(open_, "tile", "left_semi").join(state.select("seed_id", "claim"), "seed_id").join(seeds, "seed_id")
        got = now.groupBy("tile").applyInPandas(lambda batch: _pass(batch, radius), f"seed_id {kind}, claim int, collided boolean")
        # a union, for a join's estimated size is a product: with the state on both sides the estimate's digits would double each round
        state = cut(state.unionByName(got).groupBy("seed_id").agg(F.max("claim").alias("claim"), F.max("collided").alias("collided")))
        turn += 1
    chosen = state.join(seeds.select("seed_id", "ranks"), "seed_id")
    return chosen.select("seed_id", F.get("ranks", F.col("claim")).cast("int").alias("rank"), "collided")


def assign_unclaimed(seeds: DataFrame, candidates: DataFrame, radius: float = 50.0, most: int = TILE) -> DataFrame:
    """seed_id, rank, collided of every seed with a candidate: the first by rank with no claim within ``radius``.

    seeds: seed_id, elevation. candidates: seed_id, rank, lat, lng. Seeds claim from the highest on, those without an
    elevation last, then by id. If all of a seed's candidates collide it keeps the first and says so. ``most``: seeds
    of a tile, about.
    """
    rows = candidates.join(seeds.select("seed_id", F.col("elevation").cast("double").alias("elevation")), "seed_id")
    return in_rounds(rows.withColumn("rank", F.col("rank").cast("int")), radius, most)
