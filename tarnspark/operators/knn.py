"""The k nearest sites of every point, however far, by a quadtree that follows the sites' density.

Sites at one place are equally far from any point, so a place stands for its k smallest ids. The tree's nodes are cells of degrees on
every other level with their numbers of sites; a node with at most LEAF places is not split. All points go down the tree together, a level a round: a point keeps the nodes that can hold one of its k nearest. Of a node it knows
the least and the greatest distance it can have; the nodes nearest by the greatest that have k sites between them bound the
search, and any node whose least distance is beyond that bound goes. So a round joins points to the children of the few nodes each
has kept, and the last step compares a point with the places of its leaves only, near or far, dense or sparse, crowded or not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine
from ..session import cut
from .cells import first_of_places, places

#: Places of a leaf at most; levels of a step; the finest level (cells of 40 m or so, which may hold more places).
LEAF, STEP, FINEST = 32, 2, 20
#: Rows of one key that a join's task may get, about.
HOT = 500_000


def _node(level: Column, lng: Column, lat: Column) -> Column:
    """The cell of a level: 360 / 2**level degrees wide and half as high."""
    n = F.pow(F.lit(2.0), level)
    at = lambda share: F.least(F.floor(share * n), n - 1).cast("long")
    return F.struct(level.cast("int").alias("level"), at((lng + 180) / 360).alias("x"), at((lat + 90) / 180).alias("y"))


def _bounds(node: Column) -> tuple[Column, Column]:
    """Least and greatest distance in metres from a point (lat, lng) to a place in a node; the first may be too small, the second too great."""
    n = F.pow(F.lit(2.0), node["level"])
    west, south = node["x"] * 360.0 / n - 180, node["y"] * 180.0 / n - 90
    east, north = west + 360.0 / n, south + 180.0 / n
    lat, lng = F.col("lat"), F.col("lng")
    up = F.greatest(F.lit(0.0), south - lat, lat - north)
    # degrees of longitude to the nearer side and to the farther one, the short way round
    turn = lambda a: F.least(F.pmod(a, F.lit(360.0)), 360 - F.pmod(a, F.lit(360.0)))
    to_west, to_east = turn(lng - west), turn(lng - east)
    beside = F.when((lng >= west) & (lng <= east), 0.0).otherwise(F.least(to_west, to_east))
    # a quarter turn or more away the meridian's nearest place is a pole
    aside = F.when(beside < 90, F.asin(F.least(F.lit(1.0), F.sin(F.radians(beside)) * F.cos(F.radians(lat))))).otherwise(math.pi / 2 - F.radians(F.abs(lat)))
    least = EARTH_RADIUS_M * F.greatest(F.radians(up), aside)
    across = F.least(F.lit(180.0), F.greatest(to_west, to_east, F.when(n <= 2, 180.0).otherwise(0.0)))
    high = F.greatest(F.abs(lat - south), F.abs(lat - north))
    # along the point's own parallel, then along a meridian
    most = EARTH_RADIUS_M * (F.radians(high) + F.radians(across) * F.cos(F.radians(lat)))
    return F.greatest(F.lit(0.0), least - 0.01), most + 0.01


def tree(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, n, inner) of the tree over places (lat, lng, ids) with their numbers of ids, and the places with the leaf they are in."""
    levels = list(range(0, FINEST + 1, STEP))
    each = at.select("lat", "lng", F.size("ids").alias("_size"), F.explode(F.array(*[_node(F.lit(v), F.col("lng"), F.col("lat")) for v in levels])).alias("node"))
    nodes = cut(each.groupBy("node").agg(F.sum("_size").alias("n"), F.count("*").alias("_places")).withColumn("inner", (F.col("_places") > LEAF) & (F.col("node.level") < FINEST)))
    # a place's leaf lies under as many inner nodes as there are; coarse nodes have many places, which are dealt out by salt
    largest = {r[0]: r[1] for r in nodes.groupBy("node.level").agg(F.max("_places")).collect()}
    salts = F.create_map(*[F.lit(x) for v in levels for x in (v, max(1, -(-largest.get(v, 0) // HOT)))])
    most = F.element_at(salts, F.col("node.level"))
    inner = nodes.where("inner").select("node", F.explode(F.sequence(F.lit(0), most - 1)).alias("_salt"))
    salted = each.withColumn("_salt", F.pmod(F.xxhash64("lat", "lng"), most).cast("int"))
    depth = salted.join(inner, ["node", "_salt"]).groupBy("lat", "lng").agg((F.count_distinct("node") * STEP).alias("_level"))
    placed = at.join(depth, ["lat", "lng"], "left")
    return nodes.drop("_places"), placed.select("lat", "lng", "ids", _node(F.coalesce("_level", F.lit(0)), F.col("lng"), F.col("lat")).alias("leaf"))


def nearest(points: DataFrame, sites: DataFrame, k: int, others: bool = False) -> DataFrame:
    """point_id, site_id, distance_m, rank: the k nearest sites (site_id, lat, lng) of each point (point_id, lat, lng), ties to the smaller id.

    With ``others`` a site of the point's own id doesn't count. Points and sites without coordinates take no part; if there are fewer
    sites, all are given.
    """
    need = k + 1 if others else k
    sound = sites.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng"))
    nodes, placed = tree(cut(places(sound, need).withColumnsRenamed({"r_lat": "lat", "r_lng": "lng"})))
    # children of a node, to go down by; a point starts at the root
    up = F.struct((F.col("node.level") - STEP).cast("int").alias("level"), F.shiftright("node.x", STEP).alias("x"), F.shiftright("node.y", STEP).alias("y"))
    below = nodes.where(F.col("node.level") > 0).select(up.alias("node"), F.struct("node", "n", "inner").alias("_child"))
    lists = cut(below.groupBy("node").agg(F.collect_list("_child").alias("_children")))  # 16 at most
    ask = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng")).select("point_id", "lat", "lng")
    root = F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    at = cut(ask.select("*", root.alias("node")).join(F.broadcast(nodes.where(F.col("node.level") == 0)), "node"))
    for _ in range(0, FINEST, STEP):
        if at.where("inner").isEmpty():
            break
        split = at.where("inner").select("point_id", "lat", "lng", "node")
        # all points of a crowd ask for the same few nodes: in early rounds these are few, and the lists a small table
        wanted = split.select("node").distinct().join(lists, "node")
        few = wanted.count() <= 20_000
        down = split.join(F.broadcast(wanted) if few else wanted, "node").select("point_id", "lat", "lng", F.explode("_children").alias("_c")).select("point_id", "lat", "lng", "_c.*")
        met = at.where(~F.col("inner")).select("point_id", "lat", "lng", "node", "n", "inner").unionByName(down)
        least, most = _bounds(F.col("node"))
        met = met.withColumn("_least", least).withColumn("_most", most)
        so_far = F.sum("n").over(Window.partitionBy("point_id").orderBy("_most", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        met = met.withColumn("_reach", F.when(so_far >= need, F.col("_most")))
        bound = F.min("_reach").over(Window.partitionBy("point_id"))
        at = cut(met.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound"))).select("point_id", "lat", "lng", "node", "n", "inner"))
    s = placed.select(F.col("leaf").alias("node"), "ids", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    met = at.join(s, "node").select("point_id", "ids", haversine("lat", "lng", "r_lat", "r_lng").alias("distance_m"))
    found = first_of_places(met, "point_id", "distance_m", need, "rank").select("point_id", "site_id", "distance_m", "rank")
    if not others:
        return found
    ranked = Window.partitionBy("point_id").orderBy("distance_m", "site_id")
    return found.where(F.col("point_id") != F.col("site_id")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
