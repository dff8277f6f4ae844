"""Queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, scores, text, times
from ..operators import catalog, cells, claims, cover, grids, knn, ledger, long_visits, matching, ml, progress, queue, raster, visits
from ..sources.readers import table
from ..streaming import events as streams
from . import lens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _hav(a: str, b: str, c: str, d: str) -> str:
    chord = f"(pow(sin(radians({c}-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2),2))"
    return f"(2*6371000e0*atan2(sqrt({chord}),sqrt(1-{chord})))"


def _r(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


# --- visits -------------------------------------------------------------------------------------

_VISITS = (
    "WITH "
    + lens.POINTS
    + f""", pairs AS (SELECT p.*, s.site_id, s.lat AS s_lat, s.lng AS s_lng, s.elevation,
  max(CASE WHEN p.alt IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY track_id) AS has_alt, {_hav("p.lat", "p.lng", "s.lat", "s.lng")} AS dist FROM points p CROSS JOIN sites s),
modes AS (SELECT *, CASE WHEN has_alt=1 AND elevation IS NOT NULL THEN 'A' WHEN has_alt=1 THEN 'B' WHEN elevation IS NOT NULL THEN 'C' ELSE 'D' END AS mode FROM pairs),
reach AS (SELECT *, CASE mode WHEN 'A' THEN 100e0 WHEN 'B' THEN 80e0 WHEN 'C' THEN 60e0 ELSE 50e0 END AS enter,
  CASE mode WHEN 'A' THEN 150e0 WHEN 'B' THEN 120e0 WHEN 'C' THEN 100e0 ELSE 80e0 END AS leave FROM modes),
gates AS (SELECT *, dist<=enter AS inn, abs(s_lat-lat)<=enter/110574e0 AND abs(s_lng-lng)<=enter/(111320e0*cos(radians(s_lat))) AS box FROM reach),
last_in AS (SELECT *, last_value(CASE WHEN inn THEN t END IGNORE NULLS) OVER (PARTITION BY track_id, site_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gates),
numbered AS (SELECT *, sum(CASE WHEN NOT inn AND dist>=leave AND t-before>=180 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, site_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS visit FROM last_in),
inside AS (SELECT *, min(CASE WHEN box THEN idx END) OVER (PARTITION BY track_id, site_id, visit) AS opened FROM numbered WHERE inn),
grouped AS (SELECT track_id, site_id, visit, first(mode) AS mode, first(elevation) AS elevation, count(*) AS samples, min(idx) AS start_idx, max(t)-min(t) AS seconds,
  min(dist) AS dist, arg_min(idx, struct_pack(d := dist, i := idx)) AS idx, list(alt ORDER BY idx) FILTER (WHERE alt IS NOT NULL) AS alts FROM inside WHERE idx>=opened GROUP BY 1,2,3),
shape AS (SELECT *, len(alts) AS n, idx-start_idx AS nearest, least(greatest(1, idx-start_idx), len(alts)-1) AS mid FROM grouped),
halves AS (SELECT *, list_avg(list_slice(alts, 1, mid)) AS b, list_avg(list_slice(alts, mid+1, n)) AS a FROM shape),
rises AS (SELECT *, (CASE WHEN nearest>=0 AND nearest<n THEN alts[nearest+1] ELSE (b+a)/2 END) - least(b,a) AS rise FROM halves),
parts AS (SELECT *, exp(-dist/60e0)*(0.7e0+0.3e0*greatest(least(1e0, samples/5e0), least(1e0, seconds/45e0))) AS base,
  CASE WHEN n IS NULL OR n<3 THEN 0.85e0 WHEN rise>=5 THEN least(1.15e0, 1+rise/100e0) WHEN rise>=0 THEN 0.85e0 ELSE 0.6e0 END AS approach,
  CASE WHEN n IS NULL OR n=0 OR abs(list_avg(alts)-elevation)<=75 THEN 1e0 ELSE greatest(0.2e0, 1-(abs(list_avg(alts)-elevation)-75)/150e0*0.6e0) END AS height FROM rises),
scored AS (SELECT *, least(1e0, CASE mode WHEN 'A' THEN base*height*approach WHEN 'B' THEN base*approach ELSE base END) AS confidence FROM parts),
classed AS (SELECT *, CASE WHEN confidence<0.40 THEN 'reject' WHEN confidence<(CASE mode WHEN 'A' THEN 0.55 WHEN 'B' THEN 0.50 WHEN 'C' THEN 0.60 ELSE 0.65 END) THEN 'confirm' ELSE 'accept' END AS class FROM scored)
"""
)


_DETECTED = _VISITS + "SELECT track_id, site_id, CAST(visit AS BIGINT) AS visit, mode, CAST(idx AS BIGINT) AS idx, samples, round(seconds,6) AS seconds, round(dist,4) AS min_dist, round(confidence,6) AS confidence, class='confirm' AS needs_confirmation FROM classed WHERE class<>'reject'"


@query(_DETECTED)
def visit_detection(spark, d):
    found = visits.detect_visits(lens.points(spark, d), lens.sites(spark, d))
    return found.select("track_id", "site_id", F.col("visit").cast("long"), "mode", F.col("idx").cast("long").alias("idx"), "samples", _r("seconds"), _r("min_dist", 4), _r("confidence"), "needs_confirmation")


@query(_DETECTED)
def visit_detection_chunked(spark, d):
    """The same by chunks of 100 points: no window holds a whole track."""
    found = long_visits.detect_visits(lens.points(spark, d), lens.sites(spark, d), 100)
    return found.select("track_id", "site_id", F.col("visit").cast("long"), "mode", F.col("idx").cast("long").alias("idx"), "samples", _r("seconds"), _r("min_dist", 4), _r("confidence"), "needs_confirmation")


@query(_VISITS + "SELECT mode, class, count(*) AS n, round(avg(confidence),6) AS mean_confidence FROM classed GROUP BY 1,2")
def visit_confidence_classes(spark, d):
    found = visits.score_visits(lens.points(spark, d), lens.sites(spark, d))
    return found.groupBy("mode", "class").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(
    "WITH "
    + lens.POINTS
    + """, box AS (SELECT track_id, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM points GROUP BY 1),
wide AS (SELECT track_id, south-500/110574e0 AS south, north+500/110574e0 AS north, west-abs(500/(40075000e0*cos(greatest(abs(south),abs(north))/57.2958e0))*360) AS west,
  east+abs(500/(40075000e0*cos(greatest(abs(south),abs(north))/57.2958e0))*360) AS east FROM box)
SELECT track_id, site_id FROM wide JOIN suppliers s ON s.lng>west AND s.lng<east AND s.lat>south AND s.lat<north"""
)
def visit_candidates_bbox(spark, d):
    boxes = visits.track_boxes(lens.points(spark, d))
    return cells.in_boxes(lens.suppliers(spark, d).select("site_id", "lat", "lng"), boxes, 0.5).select("track_id", "site_id")


@query(
    "WITH "
    + lens.POINTS
    + f""", near AS (SELECT track_id, site_id, idx, {_hav("p.lat", "p.lng", "s.lat", "s.lng")} AS dist FROM points p CROSS JOIN sites s),
inn AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY track_id, site_id ORDER BY idx) > 5 THEN 1 ELSE 0 END AS new FROM near WHERE dist<=100),
v AS (SELECT *, sum(new) OVER (PARTITION BY track_id, site_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS visit FROM inn)
SELECT track_id, site_id, CAST(visit AS BIGINT) AS visit, count(*) AS samples, CAST(arg_min(idx, struct_pack(d := dist, i := idx)) AS BIGINT) AS idx, round(min(dist),4) AS min_dist FROM v GROUP BY 1,2,3"""
)
def visit_legacy_index_gap(spark, d):
    found = visits.legacy_visits(lens.points(spark, d), lens.sites(spark, d), 100.0, 5)
    return found.select("track_id", "site_id", F.col("visit").cast("long").alias("visit"), "samples", F.col("idx").cast("long").alias("idx"), _r("min_dist", 4))


@query("WITH " + lens.POINTS + """, s AS (SELECT track_id, lat, lng, coalesce(lead(lat) OVER w, lat) AS lat2, coalesce(lead(lng) OVER w, lng) AS lng2 FROM points WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
p AS (SELECT *, lng2-lng AS dx, lat2-lat AS dy FROM s),
q AS (SELECT track_id, CASE WHEN dx=0 THEN (CASE WHEN lng BETWEEN -107.5e0 AND -105.5e0 THEN 0e0 ELSE 2e0 END) ELSE least((-107.5e0-lng)/dx, (-105.5e0-lng)/dx) END AS ex, CASE WHEN dx=0 THEN (CASE WHEN lng BETWEEN -107.5e0 AND -105.5e0 THEN 1e0 ELSE -1e0 END) ELSE greatest((-107.5e0-lng)/dx, (-105.5e0-lng)/dx) END AS lx,
  CASE WHEN dy=0 THEN (CASE WHEN lat BETWEEN 38.2e0 AND 38.9e0 THEN 0e0 ELSE 2e0 END) ELSE least((38.2e0-lat)/dy, (38.9e0-lat)/dy) END AS ey, CASE WHEN dy=0 THEN (CASE WHEN lat BETWEEN 38.2e0 AND 38.9e0 THEN 1e0 ELSE -1e0 END) ELSE greatest((38.2e0-lat)/dy, (38.9e0-lat)/dy) END AS ly FROM p)
SELECT track_id, bool_or(greatest(0e0, ex, ey) <= least(1e0, lx, ly)) AS meets FROM q GROUP BY 1""")
def track_meets_box(spark, d):
    tracks = lens.points(spark, d).groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lng", "lat"))), lambda x: F.struct(x["lng"].alias("lng"), x["lat"].alias("lat"))).alias("coords"))
    return tracks.select("track_id", geo.track_meets_box("coords", -107.5, 38.2, -105.5, 38.9).alias("meets"))


# --- ranges and polygons ------------------------------------------------------------------------


@query(f"WITH {lens.SUPPLIERS}, near AS (SELECT a.site_id, b.site_id AS near_id, {_hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS distance_m FROM suppliers a JOIN suppliers b ON a.key<>b.key), ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY distance_m, near_id) AS rank FROM near WHERE distance_m<=60000) SELECT site_id, near_id, round(distance_m,3) AS distance_m, rank FROM ranked WHERE rank<=3")
def site_topk_nearest(spark, d):
    s = lens.suppliers(spark, d)
    near = cells.nearest_others(s.select("site_id", "lat", "lng"), 60000.0, 3)
    return near.select("site_id", "near_id", _r("distance_m", 3), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {lens.SUPPLIERS}, {lens.SPOTS}, near AS (SELECT spot_id, site_id, {_hav('p.lat', 'p.lng', 's.lat', 's.lng')} AS distance_m FROM spots p CROSS JOIN suppliers s), ranked AS (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY distance_m, site_id) AS rank FROM near) SELECT spot_id, site_id, round(distance_m,3) AS distance_m, rank FROM ranked WHERE rank<=3")
def site_nearest_any_distance(spark, d):
    """The three nearest sites of each place, however far."""
    spots = lens.spots(spark, d).withColumnRenamed("spot_id", "point_id")
    near = knn.nearest(spots, lens.suppliers(spark, d).select("site_id", "lat", "lng"), 3)
    return near.select(F.col("point_id").alias("spot_id"), "site_id", _r("distance_m", 3), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {lens.SUPPLIERS} SELECT a.site_id FROM suppliers a WHERE EXISTS (SELECT 1 FROM suppliers b WHERE b.key%10=1 AND {_hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}<=40000)")
def site_within_exists(spark, d):
    s = lens.suppliers(spark, d)
    some = s.where(F.col("key") % 10 == 1).select(F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    return cells.within_distance(s, some, 40000.0, how="left_semi").select("site_id")


@query(f"WITH {lens.PLACES}, {lens.POLYGONS} SELECT site_id, poly_id, code FROM places p JOIN polygons g ON p.lng>g.west AND p.lng<g.east AND p.lat>g.south AND p.lat<g.north")
def point_in_polygon(spark, d):
    return cover.in_polygons(lens.places(spark, d), lens.polygons(spark, d)).select("site_id", "poly_id", "code")


@query(f"""WITH {lens.COASTS}, {lens.SPOTS}, ends AS (SELECT *, coalesce(lead(lng) OVER w, first(lng) OVER w) AS lng2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS lat2 FROM corners WINDOW w AS (PARTITION BY coast_id, ring ORDER BY i)),
hits AS (SELECT spot_id, coast_id, count(*) AS n FROM spots p JOIN ends e ON (e.lat>p.lat)<>(e.lat2>p.lat) AND p.lng<(e.lng2-e.lng)*(p.lat-e.lat)/(e.lat2-e.lat)+e.lng GROUP BY 1,2)
SELECT spot_id, coast_id FROM hits WHERE n%2=1""")
def point_in_large_polygon(spark, d):
    """Places in polygons of a thousand corners or so, with holes."""
    return cover.in_polygons(lens.spots(spark, d), lens.coasts(spark, d)).select("spot_id", "coast_id")


@query(f"""WITH {lens.COASTS} SELECT coast_id, round(abs(sum(CASE WHEN ring=1 THEN a ELSE -a END)),6) AS area FROM (SELECT coast_id, ring, abs(sum(lng*lat2-lng2*lat))/2 AS a FROM
  (SELECT *, coalesce(lead(lng) OVER w, first(lng) OVER w) AS lng2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS lat2 FROM corners WINDOW w AS (PARTITION BY coast_id, ring ORDER BY i)) GROUP BY 1,2) GROUP BY 1""")
def polygon_cover_area(spark, d):
    """A cover's whole cells and the clipped rings of the others have the polygon's area."""
    cells_of = cover.cover(lens.coasts(spark, d))
    clipped = F.aggregate("rings", F.lit(0.0), lambda s, r: s + geo.signed_area(r))
    own = cells_of.withColumn("_a", F.when(F.col("whole"), F.pow(360.0 / F.pow(F.lit(2.0), F.col("level")), 2)).otherwise(clipped))
    return own.groupBy("coast_id").agg(F.round(F.sum("_a"), 6).alias("area"))


@query(f"WITH {lens.PLACES}, {lens.POLYGONS} SELECT p.site_id, coalesce(p.country, min(g.code)) AS country FROM places p LEFT JOIN polygons g ON p.lng>g.west AND p.lng<g.east AND p.lat>g.south AND p.lat<g.north GROUP BY p.site_id, p.country")
def geocode_coalesce_update(spark, d):
    return catalog.geocode(lens.places(spark, d), lens.polygons(spark, d), "country").select("site_id", "country")


@query(f"WITH {lens.PLACES}, {lens.POLYGONS}, tagged AS (SELECT site_id FROM places WHERE key%4=0) SELECT poly_id, count(DISTINCT site_id) AS n FROM places p JOIN polygons g ON p.lng>g.west AND p.lng<g.east AND p.lat>g.south AND p.lat<g.north WHERE NOT EXISTS (SELECT 1 FROM tagged t WHERE t.site_id=p.site_id) GROUP BY 1 HAVING count(DISTINCT site_id)>1")
def public_lands_incremental(spark, d):
    p = lens.places(spark, d)
    tags = catalog.tag_lands(p, lens.polygons(spark, d), p.where(F.col("key") % 4 == 0))
    return tags.groupBy("poly_id").agg(F.countDistinct("site_id").alias("n")).where("n > 1")


@query(f"WITH {lens.POLYGONS} SELECT poly_id, round((east-west)*(north-south),6) AS area_deg, round((east-west)*(north-south)*111320e0*111320e0*cos(radians(south))/1e6,3) AS area_sq_km, CAST(5 AS BIGINT) AS vertices FROM polygons")
def area_shoelace(spark, d):
    g = lens.polygons(spark, d).withColumn("ring", F.get("rings", F.lit(0))).withColumn("south", F.col("ring")[0]["lat"])
    return g.select("poly_id", F.round(geo.ring_area("ring"), 6).alias("area_deg"), F.round(geo.area_sq_m("ring", "south") / 1e6, 3).alias("area_sq_km"), geo.vertex_count("rings").cast("long").alias("vertices"))


# --- matching -----------------------------------------------------------------------------------

_NAMES = "SELECT {k} AS id, list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({n}), '\\b(mount|mt\\.?|mountain|mtn\\.?)\\b', 'mt', 'g'), '\\b(peak|pk\\.?)\\b', 'pk', 'g'), '\\b(point|pt\\.?)\\b', 'pt', 'g'), '[''`‘’]', '', 'g'), '[^a-zA-Z0-9_\\s]', ' ', 'g')), '\\s+'), lambda x: len(x)>1))) AS w FROM {t}"
_SIMILAR = "CASE WHEN len(a.w)=0 OR len(b.w)=0 THEN 0e0 WHEN a.w=b.w THEN 1e0 WHEN contains(array_to_string(a.w,' '),array_to_string(b.w,' ')) OR contains(array_to_string(b.w,' '),array_to_string(a.w,' ')) THEN greatest(len(list_intersect(a.w,b.w))*1e0/len(list_distinct(list_concat(a.w,b.w))), 0.8e0) ELSE len(list_intersect(a.w,b.w))*1e0/len(list_distinct(list_concat(a.w,b.w))) END"


@query("WITH a AS (SELECT DISTINCT w FROM (" + _NAMES.format(k="p_partkey", n="p_name || CASE WHEN p_partkey%3=0 THEN ' Mtn.' ELSE ' Peak' END", t="part") + ")), b AS (SELECT DISTINCT w FROM (" + _NAMES.format(k="p_partkey", n="CASE WHEN p_partkey%2=0 THEN 'Mount ' ELSE 'Pk. ' END || p_name", t="part") + f")) SELECT array_to_string(a.w,' ') AS left_words, array_to_string(b.w,' ') AS right_words, round({_SIMILAR},6) AS similarity FROM a JOIN b ON list_has_any(a.w, b.w)")
def name_similarity_pairs(spark, d):
    """All names of two lists that share a word; equal word lists are one."""
    p, k = table(spark, d, "part", ["p_partkey", "p_name"]), F.col("p_partkey")
    a = p.select(text.name_words(F.concat("p_name", F.when(k % 3 == 0, " Mtn.").otherwise(" Peak"))).alias("_a")).distinct()
    b = p.select(text.name_words(F.concat(F.when(k % 2 == 0, "Mount ").otherwise("Pk. "), "p_name")).alias("_b")).distinct()
    met = a.withColumn("w", F.explode("_a")).join(b.withColumn("w", F.explode("_b")), "w").select("_a", "_b").distinct()
    return met.select(F.array_join("_a", " ").alias("left_words"), F.array_join("_b", " ").alias("right_words"), F.round(text.word_similarity(F.col("_a"), F.col("_b")), 6).alias("similarity"))


def _external(spark, d):
    """Customers as an external list near the suppliers' places."""
    c = F.col("c_custkey")
    return table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select(c.alias("ext_id"), F.concat(F.lit("Supplier "), F.lpad((c % 100).cast("string"), 9, "0")).alias("name"), (37.0 + (c * 37) % 400 / 100.0 + (c % 7) / 2000.0).alias("lat"), (-109.0 + (c * 53) % 700 / 100.0 + (c % 5) / 2000.0).alias("lng"), (1500.0 + F.col("c_acctbal") / 10.0).alias("elevation"))


_EDGES = (
    "WITH "
    + lens.SUPPLIERS
    + """, ext AS (SELECT c_custkey AS ext_id, 'Supplier ' || lpad(CAST(c_custkey%100 AS VARCHAR),9,'0') AS name, 37e0+((c_custkey*37)%400)/100e0+(c_custkey%7)/2000e0 AS lat, -109e0+((c_custkey*53)%700)/100e0+(c_custkey%5)/2000e0 AS lng, 1500e0+c_acctbal/10e0 AS elevation FROM customer),
a AS ("""
    + _NAMES.format(k="ext_id", n="name", t="ext")
    + "), b AS ("
    + _NAMES.format(k="site_id", n="name", t="suppliers")
    + f"), near AS (SELECT e.ext_id, s.site_id, e.elevation AS ee, s.elevation AS se, {_hav('e.lat', 'e.lng', 's.lat', 's.lng')} AS distance_m FROM ext e CROSS JOIN suppliers s),"
    + " ranked AS (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY distance_m, site_id) AS cand_rank FROM near WHERE distance_m<={radius}),"
    + " edges AS (SELECT r.ext_id, r.site_id, r.distance_m, r.cand_rank, "
    + _SIMILAR
    + " AS sim, CASE WHEN coalesce(ee,0)=0 OR coalesce(se,0)=0 THEN 0.5e0 WHEN abs(ee-se)<50 THEN 1e0 WHEN abs(ee-se)>200 THEN 0e0 ELSE 1-(abs(ee-se)-50)/150e0 END AS ele FROM ranked r JOIN a ON a.id=r.ext_id JOIN b ON b.id=r.site_id WHERE cand_rank<={most}),"
    + " scored AS (SELECT *, sim*0.5e0+(1-distance_m/{radius})*0.3e0+ele*0.2e0 AS score FROM edges)"
)


@query(_EDGES.format(radius="500e0", most=10) + ", best AS (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY score DESC, distance_m, site_id) AS n FROM scored WHERE score>0) SELECT e.ext_id, b.site_id, round(b.distance_m,3) AS distance_m, round(b.sim,6) AS name_similarity, round(b.score,6) AS score, CASE WHEN b.site_id IS NULL THEN 'none' WHEN b.distance_m<100 AND b.sim>0.7 THEN 'high' WHEN b.distance_m<300 AND b.sim>0.4 THEN 'medium' WHEN b.distance_m<100 THEN 'medium' ELSE 'low' END AS confidence FROM ext e LEFT JOIN best b ON b.ext_id=e.ext_id AND b.n=1")
def match_best_candidate(spark, d):
    out = matching.best_match(_external(spark, d), lens.suppliers(spark, d))
    return out.select("ext_id", "site_id", _r("distance_m", 3), _r("name_similarity"), _r("score"), "confidence")


def _one_to_one(radius: str = "2000e0", most: int = 25, least: str = "0.35e0", accept: str = "0.75e0", metres: str = "150", name: str = "0.7e0", margin: str = "0.12e0", own: str = "true", mine: str = "true") -> str:
    """Edges one by one, the best first, with the ends taken so far; ``own`` and ``mine`` restrict the external sites."""
    return (
        _EDGES.format(radius=radius, most=most).replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", free AS (SELECT * FROM scored WHERE ext_id%17<>0 AND {own}),
tops AS (SELECT ext_id, max(CASE WHEN n=1 THEN score END) AS best_score, max(CASE WHEN n=2 THEN score END) AS second_score FROM (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY score DESC, cand_rank) AS n FROM free) GROUP BY 1),
line AS (SELECT *, row_number() OVER (ORDER BY score DESC, ext_id, cand_rank) AS i FROM free WHERE score>={least}),
step AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS exts, CAST([] AS VARCHAR[]) AS sites, false AS took UNION ALL
  SELECT i, CASE WHEN ok THEN list_append(exts, ext_id) ELSE exts END, CASE WHEN ok THEN list_append(sites, site_id) ELSE sites END, ok FROM (SELECT l.i, l.ext_id, l.site_id, exts, sites, NOT list_contains(exts, l.ext_id) AND NOT list_contains(sites, l.site_id) AS ok FROM step s JOIN line l ON l.i=s.i+1)),
pairs AS (SELECT line.* FROM line JOIN step USING (i) WHERE took)
SELECT e.ext_id, CASE WHEN e.ext_id%17=0 THEN 'skipped' WHEN p.site_id IS NULL THEN 'unmatched' WHEN score>={accept} AND distance_m<={metres} AND sim>={name} AND (second_score IS NULL OR best_score-second_score>={margin}) THEN 'high' ELSE 'review' END AS outcome,
  site_id, round(distance_m,3) AS distance_m, round(score,6) AS score, round(second_score,6) AS second_score FROM ext e LEFT JOIN pairs p USING (ext_id) LEFT JOIN tops USING (ext_id) WHERE {mine}"""
    )


@query(_one_to_one())
def match_one_to_one(spark, d):
    """One-to-one assignment; the SQL goes through the edges one by one."""
    ext = _external(spark, d)
    out = matching.match_one_to_one(ext, lens.suppliers(spark, d), ext.where(F.col("ext_id") % 17 == 0).select("ext_id"))
    return out.select("ext_id", "outcome", "site_id", _r("distance_m", 3), _r("score"), _r("second_score"))


_NEAR_SETTINGS = {"near.radius_m": "1000", "near.candidates": "5", "near.least_score": "0.3", "near.accept_score": "0.6", "near.accept_distance_m": "300", "near.accept_name": "0.5", "near.accept_margin": ""}


@query(f"""SELECT *, 'far' AS source FROM ({_one_to_one(own='ext_id%2=0', mine='e.ext_id%2=0')})
UNION ALL SELECT *, 'near' FROM ({_one_to_one("1000e0", 5, "0.3e0", "0.6e0", "300", "0.5e0", own='ext_id%2=1', mine='e.ext_id%2=1')})""")
def match_by_source(spark, d):
    """Two sources, each with its own thresholds."""
    ext = _external(spark, d).withColumn("source", F.when(F.col("ext_id") % 2 == 0, "far").otherwise("near"))
    presets = {name: matching.options_of(_NEAR_SETTINGS, f"{name}.") for name in ("far", "near")}
    out = matching.imported(ext, lens.suppliers(spark, d), presets, ext.where(F.col("ext_id") % 17 == 0).select("ext_id"))
    return out.select("ext_id", "outcome", "site_id", _r("distance_m", 3), _r("score"), _r("second_score"), "source")


# --- progress -----------------------------------------------------------------------------------


def _seen(spark, d):
    return progress.history(lens.ledger(spark, d), lens.manual(spark, d))


@query(f"WITH {lens.LEDGER} SELECT user_id, count(*) AS n, count(activity_id) AS with_activity, count(DISTINCT site_id) AS sites FROM seen GROUP BY 1")
def ledger_union_history(spark, d):
    return progress.visit_counts(_seen(spark, d), lens.line_tasks(spark, d))


_BEFORE = f"WITH {lens.LEDGER}, before AS (SELECT DISTINCT s.user_id, a.activity_id AS current_id, s.site_id FROM seen s JOIN activities a ON a.user_id=s.user_id WHERE s.activity_id IS NULL OR s.activity_id<>a.activity_id)"


@query(_BEFORE + " SELECT user_id, current_id, max(elevation) AS max_elevation FROM before JOIN peaks USING (site_id) WHERE elevation IS NOT NULL GROUP BY 1,2")
def prior_max_elevation(spark, d):
    return progress.prior_highest(_seen(spark, d), lens.activities(spark, d), lens.peaks(spark, d))


@query(_BEFORE + " SELECT DISTINCT user_id, current_id, state, country FROM before JOIN peaks USING (site_id)")
def prior_places(spark, d):
    return progress.prior_places(_seen(spark, d), lens.activities(spark, d), lens.peaks(spark, d))


_STATS = f"WITH {lens.LEDGER}, visited AS (SELECT DISTINCT s.user_id, s.activity_id AS current_id, s.site_id FROM seen s JOIN activities a ON a.user_id=s.user_id AND a.activity_id=s.activity_id), stats AS (SELECT v.user_id, v.current_id, v.site_id, count(*) AS lifetime, count(*) FILTER (WHERE s.activity_id IS NULL OR s.activity_id<>v.current_id) AS prior FROM visited v JOIN seen s ON s.user_id=v.user_id AND s.site_id=v.site_id GROUP BY 1,2,3)"


@query(_STATS + " SELECT * FROM stats")
def peak_stats_filter_counts(spark, d):
    return progress.site_stats(_seen(spark, d), lens.activities(spark, d)).select("user_id", "current_id", "site_id", "lifetime", "prior")


@query(_STATS + " SELECT user_id, current_id, string_agg(name || ' (' || format('{:,}', CAST(floor(elevation*3.28084e0+0.5) AS BIGINT)) || ' ft): ' || CASE WHEN prior=0 THEN 'first visit' ELSE CAST(lifetime AS VARCHAR) || CASE WHEN lifetime=1 THEN ' visit' ELSE ' visits' END END, chr(10) ORDER BY site_id) AS summary FROM stats JOIN peaks USING (site_id) GROUP BY 1,2")
def summary_text(spark, d):
    return progress.summary(progress.site_stats(_seen(spark, d), lens.activities(spark, d)), lens.peaks(spark, d))


@query(f"WITH {lens.LEDGER}, up AS (SELECT DISTINCT user_id, site_id FROM seen), t AS (SELECT state, count(site_id) AS total FROM peaks GROUP BY 1), c AS (SELECT user_id, state, count(*) AS completed FROM up JOIN peaks USING (site_id) GROUP BY 1,2) SELECT user_id, c.state AS collection_id, total, completed FROM c JOIN t USING (state) WHERE total>0")
def challenge_progress(spark, d):
    members = lens.peaks(spark, d).select(F.col("state").alias("collection_id"), "site_id")
    return progress.collection_progress(_seen(spark, d), members)


@query(f"WITH {lens.LEDGER}, c AS (SELECT max(ts) AS now FROM seen), m AS (SELECT DISTINCT user_id, date_trunc('month', ts) AS month FROM seen), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC)-1 AS n, max(month) OVER (PARTITION BY user_id) AS last FROM m), s AS (SELECT user_id, last, count(*) FILTER (WHERE (year(last)*12+month(last))-(year(month)*12+month(month))=n) AS run FROM r GROUP BY 1,2) SELECT user_id, CAST(CASE WHEN last>=date_trunc('month', now) - INTERVAL 1 MONTH THEN run ELSE 0 END AS BIGINT) AS streak, last=date_trunc('month', now) AS is_active, strftime(last, '%Y-%m') AS last_month FROM s CROSS JOIN c".replace("year(month)*12+month(month)", "year(r.month)*12+month(r.month)"))
def monthly_streak(spark, d):
    seen = _seen(spark, d)
    now = seen.agg(F.max("ts")).first()[0]
    return progress.monthly_streak(seen, F.lit(now)).withColumn("last_month", F.date_format("last_month", "yyyy-MM"))


@query(f"WITH {lens.LEDGER}, r AS (SELECT user_id, state, activity_id, site_id, row_number() OVER (PARTITION BY user_id, state ORDER BY ts, activity_id, site_id) AS n FROM seen JOIN peaks USING (site_id) WHERE activity_id IS NOT NULL AND state IS NOT NULL) SELECT user_id, state, activity_id, site_id FROM r WHERE n=1")
def first_place_unlocks(spark, d):
    return progress.first_places(_seen(spark, d), lens.peaks(spark, d), "state").select("user_id", "state", "activity_id", "site_id")


# --- ledger changes -----------------------------------------------------------------------------


@query(f"WITH {lens.VISITS} SELECT a.visit_id AS id1, b.visit_id AS id2, a.activity_id, a.site_id FROM visits a JOIN visits b ON a.activity_id=b.activity_id AND a.site_id=b.site_id AND a.visit_id<b.visit_id AND abs(epoch_us(a.ts)-epoch_us(b.ts))<=300000000")
def dedupe_pairs(spark, d):
    return ledger.duplicate_pairs(lens.visits(spark, d))


@query(
    f"""WITH RECURSIVE {lens.VISITS}, o AS (SELECT *, row_number() OVER (PARTITION BY activity_id, site_id ORDER BY ts, CAST(visit_id AS VARCHAR)) AS n FROM visits),
w AS (SELECT activity_id, site_id, n, visit_id, epoch_us(ts) AS start, 1 AS win FROM o WHERE n=1 UNION ALL
  SELECT o.activity_id, o.site_id, o.n, o.visit_id, CASE WHEN epoch_us(o.ts)-w.start>300000000 THEN epoch_us(o.ts) ELSE w.start END, CASE WHEN epoch_us(o.ts)-w.start>300000000 THEN w.win+1 ELSE w.win END
  FROM w JOIN o ON o.activity_id=w.activity_id AND o.site_id=w.site_id AND o.n=w.n+1),
r AS (SELECT v.visit_id, w.win, row_number() OVER (PARTITION BY v.activity_id, v.site_id, w.win ORDER BY CASE WHEN photos THEN 0 ELSE 1 END, CASE WHEN status='user_confirmed' THEN 0 ELSE 1 END, CASE WHEN notes IS NOT NULL THEN 0 ELSE 1 END, ts, v.visit_id) AS k FROM visits v JOIN w ON w.visit_id=v.visit_id)
SELECT visit_id, CAST(win AS BIGINT) AS win, k=1 AS keep FROM r"""
)
def dedupe_keep_best(spark, d):
    better = [F.asc(F.when(F.col("photos"), 0).otherwise(1)), F.asc(F.when(F.col("status") == "user_confirmed", 0).otherwise(1)), F.asc(F.when(F.col("notes").isNotNull(), 0).otherwise(1))]
    return ledger.keep_best(lens.visits(spark, d), ["activity_id", "site_id"], better).select("visit_id", F.col("window").cast("long").alias("win"), "keep")


@query(f"WITH {lens.VISITS}, new AS (SELECT * FROM visits WHERE visit_id%2=1), known AS (SELECT * FROM visits WHERE visit_id%2=0) SELECT visit_id, activity_id, site_id FROM new n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.activity_id=n.activity_id AND k.site_id=n.site_id AND abs(epoch_us(k.ts)-epoch_us(n.ts))<=300000000)")
def additive_reprocess(spark, d):
    v = lens.visits(spark, d)
    return ledger.not_seen(v.where("visit_id % 2 = 1"), v.where("visit_id % 2 = 0"), ["activity_id", "site_id"]).select("visit_id", "activity_id", "site_id")


@query(f"WITH {lens.VISITS}, new AS (SELECT *, activity_id%10 AS user_id FROM visits WHERE visit_id%2=1), known AS (SELECT *, activity_id%10 AS user_id FROM visits WHERE visit_id%2=0) SELECT CAST(activity_id AS VARCHAR) || '-' || CAST(site_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts)//1000%1000 AS VARCHAR),3,'0') || 'Z' AS id, user_id FROM new n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.user_id=n.user_id AND k.site_id=n.site_id AND k.activity_id<>n.activity_id AND abs(epoch_us(k.ts)-epoch_us(n.ts))<=2000000)")
def save_visits_antijoin(spark, d):
    v = lens.visits(spark, d).withColumn("user_id", F.col("activity_id") % 10)
    new, known = v.where("visit_id % 2 = 1"), v.where("visit_id % 2 = 0")
    left = ledger.not_elsewhere(new, known, 2)
    return left.select(ledger.visit_id(F.col("activity_id").cast("string"), F.col("site_id").cast("string"), F.col("ts")).alias("id"), "user_id")


def _orders(spark, d):
    return table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


_CHANGES = "ch AS (SELECT CASE WHEN o_orderkey%9=0 THEN o_orderkey+10000000 ELSE o_orderkey END AS o_orderkey, 'X' AS o_orderstatus, CASE WHEN o_orderkey%2=0 THEN NULL ELSE o_totalprice+1 END AS o_totalprice, '0-NEW' AS o_orderpriority FROM orders WHERE o_orderkey%3=0)"


def _changes(spark, d):
    k = F.col("o_orderkey")
    return _orders(spark, d).where(k % 3 == 0).select(F.when(k % 9 == 0, k + 10000000).otherwise(k).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.when(k % 2 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("0-NEW").alias("o_orderpriority"))


@query(f"WITH {_CHANGES} SELECT coalesce(o.o_orderkey, ch.o_orderkey) AS o_orderkey, coalesce(ch.o_orderstatus, o.o_orderstatus) AS o_orderstatus, CASE WHEN ch.o_orderkey IS NOT NULL THEN ch.o_totalprice ELSE o.o_totalprice END AS o_totalprice, coalesce(ch.o_orderpriority, o.o_orderpriority) AS o_orderpriority FROM orders o FULL JOIN ch ON o.o_orderkey=ch.o_orderkey")
def upsert_full(spark, d):
    return ledger.upsert(_orders(spark, d), _changes(spark, d), ["o_orderkey"])


@query(f"WITH {_CHANGES} SELECT coalesce(o.o_orderkey, ch.o_orderkey) AS o_orderkey, coalesce(ch.o_orderstatus, o.o_orderstatus) AS o_orderstatus, CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_totalprice ELSE ch.o_totalprice END AS o_totalprice, CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_orderpriority ELSE ch.o_orderpriority END AS o_orderpriority FROM orders o FULL JOIN ch ON o.o_orderkey=ch.o_orderkey")
def upsert_partial(spark, d):
    return ledger.upsert(_orders(spark, d), _changes(spark, d), ["o_orderkey"], ["o_orderstatus"])


@query(f"WITH {_CHANGES} SELECT coalesce(o.o_orderkey, ch.o_orderkey) AS o_orderkey, coalesce(ch.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o FULL JOIN ch ON o.o_orderkey=ch.o_orderkey")
def coalesce_preserving_update(spark, d):
    return ledger.upsert(_orders(spark, d), _changes(spark, d), ["o_orderkey"], preserve=True).select("o_orderkey", "o_totalprice")


@query(f"WITH {_CHANGES} SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM ch WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey=ch.o_orderkey)")
def insert_ignore(spark, d):
    return ledger.insert_ignore(_orders(spark, d), _changes(spark, d), [["o_orderkey"]]).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus<>'F' AND o_totalprice>100000 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_if(spark, d):
    out = ledger.update_where(_orders(spark, d), (F.col("o_orderstatus") != "F") & (F.col("o_totalprice") > 100000), o_orderpriority=F.lit("1-URGENT"))
    return out.select("o_orderkey", "o_orderpriority")


@query("WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderkey%4=0) SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)")
def delete_cascade(spark, d):
    o, item = _orders(spark, d), table(spark, d, "lineitem", ["l_orderkey"])
    left = ledger.delete_cascade({"orders": (o, ["o_orderkey"]), "lineitem": (item, ["l_orderkey"])}, o.where("o_orderkey % 4 = 0").select("o_orderkey"))
    return left["orders"].agg(F.lit("orders").alias("tbl"), F.count("*").alias("n")).unionByName(left["lineitem"].agg(F.lit("lineitem").alias("tbl"), F.count("*").alias("n")))


# --- queue --------------------------------------------------------------------------------------

_OPEN = f"WITH {lens.QUEUE}, open AS (SELECT queue.* FROM queue, clock WHERE completed IS NULL AND (started IS NULL OR started < now - INTERVAL 15 MINUTE) AND attempts<5)"


@query(_OPEN + " SELECT priority, count(*) AS n, min(id) AS first_id FROM open GROUP BY 1")
def queue_counts(spark, d):
    found = queue.open_messages(lens.queue(spark, d), F.lit(lens.latest(spark, d)))
    return found.groupBy("priority").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(_OPEN + " SELECT id, user_id, priority, attempts+1 AS attempts FROM open ORDER BY priority, created, id LIMIT (SELECT least(50, count(*), count(*) FILTER (WHERE priority=1)+20) FROM open)")
def queue_lease(spark, d):
    return queue.lease(lens.queue(spark, d), F.lit(lens.latest(spark, d)), 20).select("id", "user_id", "priority", "attempts")


@query("WITH r AS (SELECT event_id AS id, 600 AS sl, CAST(event_id%620 AS INTEGER) AS su, 6000 AS dl, CAST((event_id*7)%6050 AS INTEGER) AS du, ts FROM events), b AS (SELECT id, sl-su AS s, dl-du AS d, greatest(0.5e0, 24-hour(ts)-minute(ts)/60e0) AS h FROM r) SELECT id, CASE WHEN s<=0 OR d<=0 THEN 0 ELSE greatest(CASE WHEN d>=2 THEN 1 ELSE 0 END, least(CAST(floor(d*0.98e0/h/12/2) AS BIGINT), CAST(floor((s-2)/2) AS BIGINT))) END AS allowance FROM b")
def queue_budget(spark, d):
    e = F.col("event_id")
    left = times.hours_to_midnight("ts")
    return table(spark, d, "events", ["event_id", "ts"]).select(e.alias("id"), scores.budget(F.lit(600), e % 620, F.lit(6000), (e * 7) % 6050, left).alias("allowance"))


@query(f"WITH {lens.QUEUE} SELECT id, CASE WHEN id%5=0 THEN (SELECT now FROM clock) ELSE completed END AS completed, CASE WHEN id%5=1 THEN NULL ELSE started END AS started, CASE WHEN id%5=1 THEN 'failed' END AS error FROM queue")
def queue_complete(spark, d):
    q = lens.queue(spark, d)
    done = q.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 1, "failed").alias("error"))
    return queue.complete(q, done, F.lit(lens.latest(spark, d))).select("id", "completed", "started", "error")


@query("WITH m AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'update' WHEN 'error' THEN 'delete' ELSE event_type END AS a, event_id%6 AS object_id, event_id%7 AS owner_id FROM events) SELECT id, CASE WHEN object_id=0 OR owner_id=0 THEN 'missing id' WHEN a NOT IN ('create','update','delete') THEN 'unknown action' END AS reason, CASE WHEN object_id<>0 AND owner_id<>0 AND a IN ('create','update','delete') THEN a END AS route FROM m")
def event_router(spark, d):
    e = F.col("event_id")
    action = F.when(F.col("event_type") == "view", "create").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "delete").otherwise(F.col("event_type"))
    body = F.to_json(F.struct(action.alias("aspect_type"), (e % 6).alias("object_id"), (e % 7).alias("owner_id")))
    return queue.route(table(spark, d, "events").select(e.alias("id"), body.alias("json_data"))).select("id", "reason", "route")


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) AS used FROM events GROUP BY 1")
def stream_rate_windows(spark, d):
    out = streams.rate_windows(table(spark, d, "events", ["ts"]), "ts")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "used")


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, event_id//3 AS g FROM events) GROUP BY 1,2")
def stream_dedupe(spark, d):
    rows = table(spark, d, "events").withColumn("g", F.floor(F.col("event_id") / 3))
    return streams.once(rows, ["event_type", "user_id", "g"], "ts").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


# --- joins, sets, pages -------------------------------------------------------------------------


@query(f"WITH {lens.VISITS}, w AS (SELECT site_id, CAST(d AS DATE) AS day, list_transform(range(20), lambda h: (h*7+site_id)%13) AS hourly FROM (SELECT DISTINCT site_id, date_trunc('day', ts) AS d FROM visits) WHERE site_id<4) SELECT visit_id, CAST(hourly[least(hour(ts), len(hourly)-1)+1] AS BIGINT) AS value FROM visits v LEFT JOIN w ON w.site_id=v.site_id AND w.day=CAST(v.ts AS DATE)")
def weather_hour_asof(spark, d):
    v = lens.visits(spark, d)
    hours = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda h: (h * 7 + F.col("site_id")) % 13)
    weather = v.where("site_id < 4").select("site_id", F.to_date("ts").alias("day")).distinct().withColumn("hourly", hours)
    return catalog.hourly_weather(v, weather).select("visit_id", F.col("value").cast("long").alias("value"))


@query("WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey%3=0 THEN NULL ELSE s_acctbal END AS v FROM supplier), q AS (SELECT s_suppkey AS k, s_acctbal*2 AS v FROM supplier WHERE s_suppkey%2=0) SELECT p.k, coalesce(p.v, q.v) AS v, CASE WHEN p.v IS NOT NULL THEN 'primary' WHEN q.v IS NOT NULL THEN 'secondary' ELSE 'failed' END AS origin FROM p LEFT JOIN q USING (k)")
def fallback_source(spark, d):
    k, v = F.col("s_suppkey"), F.col("s_acctbal")
    s = table(spark, d, "supplier", ["s_suppkey", "s_acctbal"])
    return catalog.fallback(s.select(k.alias("k"), F.when(k % 3 != 0, v).alias("v")), s.where(k % 2 == 0).select(k.alias("k"), (v * 2).alias("v")), "k", "v")


@query("SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_quantity>45) AS ranked FROM part")
def set_membership_partition(spark, d):
    ranked = table(spark, d, "lineitem", ["l_partkey", "l_quantity"]).where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("_hit", F.lit(True))
    return table(spark, d, "part", ["p_partkey"]).join(ranked, "p_partkey", "left").select("p_partkey", F.col("_hit").isNotNull().alias("ranked"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='A')")
def semi_anti_exists(spark, d):
    item = table(spark, d, "lineitem", ["l_orderkey", "l_returnflag"]).withColumnRenamed("l_orderkey", "o_orderkey")
    o = table(spark, d, "orders", ["o_orderkey"])
    return o.join(item.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(item.where("l_returnflag = 'A'"), "o_orderkey", "left_anti")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def left_join_counts(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    return table(spark, d, "customer", ["c_custkey"]).join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM part WHERE p_size>25) AS large_parts, (SELECT max(p_partkey)+1 FROM part) AS next_id")
def scalar_counts(spark, d):
    s = table(spark, d, "supplier", ["s_suppkey"]).agg(F.count("*").alias("suppliers"))
    p = table(spark, d, "part", ["p_partkey", "p_size"]).agg(F.count_if(F.col("p_size") > 25).alias("large_parts"), (F.coalesce(F.max("p_partkey"), F.lit(0)) + 1).alias("next_id"))
    return s.crossJoin(p)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '250' ORDER BY id LIMIT 100")
def keyset_page(spark, d):
    return table(spark, d, "orders", ["o_orderkey"]).select(F.col("o_orderkey").cast("string").alias("id")).where(F.col("id") > "250").orderBy("id").limit(100)


@query(f"WITH {lens.PLACES}, r AS (SELECT * FROM places WHERE key%2=0) SELECT site_id, elevation, (SELECT count(*) FROM r) AS total FROM r ORDER BY elevation DESC NULLS LAST, site_id LIMIT 10 OFFSET 10")
def offset_page(spark, d):
    rows = lens.places(spark, d).withColumn("needs_review", F.col("key") % 2 == 0)
    return catalog.review_page(rows, 1, 10).select("site_id", "elevation", "total")


@query(f"WITH {lens.PLACES} SELECT site_id, round(lat*10-elevation,6) AS change, CASE WHEN key%70<20 THEN 'near' WHEN key%70<50 THEN 'moved' ELSE 'far' END AS band FROM places")
def review_metrics(spark, d):
    change, band = catalog.review_metrics(F.col("elevation"), F.col("lat") * 10, F.col("key") % 70)
    return lens.places(spark, d).select("site_id", F.round(change, 6).alias("change"), band.alias("band"))


@query("SELECT c_custkey, coalesce(f.flag, false) AS describe, coalesce(f.flag, true) AS notify FROM customer LEFT JOIN (SELECT c_custkey AS k, c_custkey%2=0 AS flag FROM customer WHERE c_custkey%3<>0) f ON f.k=c_custkey")
def feature_flag_gate(spark, d):
    c = table(spark, d, "customer", ["c_custkey"])
    flags = c.where("c_custkey % 3 <> 0").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("flag"))
    return c.join(flags, "c_custkey", "left").select("c_custkey", F.coalesce("flag", F.lit(False)).alias("describe"), F.coalesce("flag", F.lit(True)).alias("notify"))


@query("SELECT id, CASE WHEN regexp_matches(id,'^[0-9]+$') THEN 'osm' WHEN regexp_matches(id,'^pq[0-9]+$') THEN 'manual' ELSE 'unknown' END AS origin FROM (SELECT CASE p_partkey%3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'pq'||CAST(p_partkey AS VARCHAR) ELSE 'pq'||p_brand END AS id FROM part)")
def provenance_case(spark, d):
    k = F.col("p_partkey")
    ids = table(spark, d, "part", ["p_partkey", "p_brand"]).select(F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("pq"), k.cast("string"))).otherwise(F.concat(F.lit("pq"), "p_brand")).alias("id"))
    return ids.select("id", catalog.provenance(F.col("id"), F.lit(None).cast("string")).alias("origin"))


@query(f"WITH {lens.SUPPLIERS}, c AS (SELECT count(*) AS k FROM suppliers GROUP BY printf('%.5f,%.5f', floor(lat), floor(lng))) SELECT CAST(sum(k) AS BIGINT) AS n, max(k) AS most, sum(k)>=10 AND max(k)>=0.3*sum(k) AS suspicious FROM c")
def duplicate_coord_detector(spark, d):
    rows = lens.suppliers(spark, d).select(F.floor("lat").cast("double").alias("lat"), F.floor("lng").cast("double").alias("lng"))
    return catalog.repeated_coordinates(rows)


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size>25) AS large, round(avg(p_retailprice),6) AS mean_price, round(var_pop(p_retailprice),4) AS var_price, max(p_size) AS max_size FROM part GROUP BY 1 HAVING count(*)>1")
def weighted_scores_stats(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"), F.round(F.var_pop("p_retailprice"), 4).alias("var_price"), F.max("p_size").alias("max_size")).where("n > 1")


@query("SELECT o_custkey, list_sort(list(DISTINCT strftime(o_orderdate,'%Y-%m')),'DESC')[1] AS newest, string_agg(DISTINCT strftime(o_orderdate,'%Y-%m'), ',' ORDER BY strftime(o_orderdate,'%Y-%m') DESC) AS months FROM orders GROUP BY 1")
def ordered_array_agg(spark, d):
    months = F.sort_array(F.collect_set(F.date_format("o_orderdate", "yyyy-MM")), asc=False)
    return table(spark, d, "orders", ["o_custkey", "o_orderdate"]).groupBy("o_custkey").agg(months.alias("_m")).select("o_custkey", F.get("_m", F.lit(0)).alias("newest"), F.array_join("_m", ",").alias("months"))


# --- text, JSON, times --------------------------------------------------------------------------


@query("SELECT doc_id, nullif(trim(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'), ' '), '') AS clean FROM documents")
def sanitize_text(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", text.clean("text").alias("clean"))


@query("WITH x AS (SELECT event_id, CASE event_id%4 WHEN 0 THEN CAST(value AS VARCHAR)||' m' WHEN 1 THEN '  '||CAST(event_id AS VARCHAR) WHEN 2 THEN 'n/a' ELSE '-'||CAST(event_id%100 AS VARCHAR)||'.5ft' END AS s FROM events) SELECT event_id, TRY_CAST(nullif(regexp_extract(s, '^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)', 1),'') AS DOUBLE) AS number FROM x")
def parse_numbers(spark, d):
    e = F.col("event_id")
    s = F.when(e % 4 == 0, F.concat(F.col("value").cast("string"), F.lit(" m"))).when(e % 4 == 1, F.concat(F.lit("  "), e.cast("string"))).when(e % 4 == 2, "n/a").otherwise(F.concat(F.lit("-"), (e % 100).cast("string"), F.lit(".5ft")))
    return table(spark, d, "events", ["event_id", "value"]).select("event_id", text.leading_number(s).alias("number"))


_URL = "CASE s_suppkey%4 WHEN 0 THEN 'https://maps.example.com/?q=' || a || ',' || b WHEN 1 THEN 'https://map.example.org/?mlat=' || a || '&mlon=' || b WHEN 2 THEN 'https://topo.example.com/map?z=3&LL=' || a || ',' || b ELSE 'https://x.example.com/?lat=' || a || '&lng=' || b END"


@query(f"WITH n AS (SELECT s_suppkey, CAST(37+(s_suppkey*37)%40 AS VARCHAR)||'.25' AS a, '-'||CAST(100+(s_suppkey*53)%70 AS VARCHAR)||'.75' AS b FROM supplier), u AS (SELECT s_suppkey, a, b, {_URL} AS url FROM n) SELECT s_suppkey, url, CAST(a AS DOUBLE) AS lat, CAST(b AS DOUBLE) AS lng FROM u")
def coords_from_url(spark, d):
    s = F.col("s_suppkey")
    a, b = F.concat((37 + s * 37 % 40).cast("string"), F.lit(".25")), F.concat(F.lit("-"), (100 + s * 53 % 70).cast("string"), F.lit(".75"))
    url = F.when(s % 4 == 0, F.concat(F.lit("https://maps.example.com/?q="), a, F.lit(","), b)).when(s % 4 == 1, F.concat(F.lit("https://map.example.org/?mlat="), a, F.lit("&mlon="), b)).when(s % 4 == 2, F.concat(F.lit("https://topo.example.com/map?z=3&LL="), a, F.lit(","), b)).otherwise(F.concat(F.lit("https://x.example.com/?lat="), a, F.lit("&lng="), b))
    rows = table(spark, d, "supplier", ["s_suppkey"]).select("s_suppkey", url.alias("url"))
    lat, lng = text.coords_from_url("url")
    return rows.select("s_suppkey", "url", lat.alias("lat"), lng.alias("lng"))


@query("SELECT s_suppkey, round((CASE WHEN s_suppkey%2=0 THEN 1 ELSE -1 END)*(s_suppkey%90 + (s_suppkey%60)/60e0 + ((s_suppkey*7)%60+0.5e0)/3600e0),9) AS lat, round((CASE WHEN s_suppkey%3=0 THEN 1 ELSE -1 END)*((s_suppkey*3)%180 + ((s_suppkey*11)%60)/60e0 + ((s_suppkey*13)%60)/3600e0),9) AS lng FROM supplier")
def dms_parse(spark, d):
    s = F.col("s_suppkey")
    written = F.format_string("at %d° %d' %d.5\" %s, %d°%d′%d″%s", s % 90, s % 60, s * 7 % 60, F.when(s % 2 == 0, "N").otherwise("S"), s * 3 % 180, s * 11 % 60, s * 13 % 60, F.when(s % 3 == 0, "E").otherwise("W"))
    rows = table(spark, d, "supplier", ["s_suppkey"]).select("s_suppkey", written.alias("w"))
    lat, lng = text.coords_from_dms("w")
    return rows.select("s_suppkey", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"))


_DECODED = "replace(replace(replace(replace(replace(replace(replace(replace(replace(html,'&#39;',chr(39)),'&#039;',chr(39)),'&apos;',chr(39)),'&quot;','\"'),'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&deg;','°'),'&amp;','&')"


@query(f"SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) <> '' OR regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS has_heading, md5({_DECODED}) AS decoded, len(regexp_extract_all(html, '<a\\b[^>]*\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']')) AS links, regexp_extract(url, '^([a-zA-Z][a-z0-9+.-]*://[^/?#]+)', 1) || '/next' AS next_url, contains(lower(html), 'cloudflare') AND contains(lower(html), 'attention required') AS blocked FROM pages")
def html_extract(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", text.heading("html").isNotNull().alias("has_heading"), F.md5(text.unescape("html").cast("binary")).alias("decoded"), F.size(text.links("html")).cast("long").alias("links"), text.absolute_url("url", F.lit("/next")).alias("next_url"), text.blocked_page("html").alias("blocked"))


@query("SELECT event_id, TRY_CAST(props::JSON->>'k' AS BIGINT) AS k, (props::JSON->>'missing') IS NOT NULL AS has_missing FROM events")
def json_fields(spark, d):
    parsed = F.from_json("props", "k long, missing string")
    return table(spark, d, "events", ["event_id", "props"]).select("event_id", parsed["k"].alias("k"), parsed["missing"].isNotNull().alias("has_missing"))


@query("SELECT event_id, event_type AS action, CASE WHEN event_id%5=0 THEN 'no data' WHEN event_id%5=1 THEN 'no payload' END AS reason FROM (SELECT event_id, CASE WHEN event_id%5=0 THEN NULL ELSE event_type END AS event_type FROM events)")
def base64_json(spark, d):
    e = F.col("event_id")
    body = F.to_json(F.struct(F.col("event_type").alias("action"), F.when(e % 5 != 1, F.col("props")).alias("json_data")))
    rows = table(spark, d, "events").select("event_id", F.when(e % 5 != 0, F.base64(F.concat(F.lit("  "), body, F.lit("\n")).cast("binary"))).alias("data"))
    out = queue.decode_push(rows)
    return out.select("event_id", F.col("message.action").alias("action"), "reason")


@query("WITH x AS (SELECT event_id, (event_id%53-26)*1800 AS s, ts FROM events) SELECT event_id, (CASE WHEN s<0 THEN '-' ELSE '+' END)||lpad(CAST(abs(s)//3600 AS VARCHAR),2,'0')||':'||lpad(CAST(abs(s)//60%60 AS VARCHAR),2,'0') AS offset_text, ts + to_microseconds(CAST((event_id%100)*1500000 AS BIGINT)) AS at FROM x")
def tz_offset_event_time(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events", ["event_id", "ts"]).select("event_id", times.utc_offset((e % 53 - 26) * 1800).alias("offset_text"), times.event_time("ts", e % 100 * 1.5).alias("at"))


@query("SELECT o_custkey, CAST(i-1 AS BIGINT) AS idx, price, coalesce(day, i-1) AS t FROM (SELECT o_custkey, unnest(p) AS price, generate_subscripts(p,1) AS i, CASE WHEN generate_subscripts(p,1)<=3 THEN (d[generate_subscripts(p,1)])*1e0 END AS day FROM (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS p, list(day(o_orderdate) ORDER BY o_orderkey) AS d FROM orders GROUP BY 1))")
def array_zip_points(spark, d):
    rows = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"]).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice", F.dayofmonth("o_orderdate").cast("double").alias("day")))).alias("a"))
    rows = rows.select("o_custkey", F.transform("a", lambda x: x["o_totalprice"]).alias("p"), F.slice(F.transform("a", lambda x: x["day"]), F.lit(1), F.lit(3)).alias("d"))
    zipped = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.struct(i.cast("long").alias("idx"), F.get("p", i).alias("price"), F.coalesce(F.get("d", i), i.cast("double")).alias("t")))
    return rows.select("o_custkey", F.inline(zipped))


# --- rasters ------------------------------------------------------------------------------------


@query(f"WITH {lens.TILES} SELECT a.tile_id, a.row, a.col FROM tiles a JOIN tiles b ON a.tile_id=b.tile_id AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1 GROUP BY 1,2,3 HAVING max(b.elev)=max(a.elev)")
def raster_local_max(spark, d):
    return raster.focal_max(lens.tiles(spark, d), 3).where("is_max").select("tile_id", "row", "col")


@query(f"WITH {lens.TILES} SELECT a.tile_id, a.row, a.col, round(coalesce(avg(CASE WHEN b.elev<a.elev THEN 1e0 ELSE 0e0 END) FILTER (WHERE b.tile_id IS NOT NULL),0.5e0),6) AS radial FROM tiles a LEFT JOIN tiles b ON a.tile_id=b.tile_id AND abs(a.row-b.row) IN (0,2) AND abs(a.col-b.col) IN (0,2) AND (a.row<>b.row OR a.col<>b.col) GROUP BY 1,2,3")
def radial_dominance(spark, d):
    return raster.radial_dominance(lens.tiles(spark, d), 2).select("tile_id", "row", "col", F.round("radial", 6).alias("radial"))


@query(f"WITH {lens.TILES} SELECT a.tile_id, a.row, a.col, round(count(*) FILTER (WHERE b.elev<a.elev)*1e0/(count(*)-1),6) AS neighbourhood FROM tiles a JOIN tiles b ON a.tile_id=b.tile_id AND abs(a.row-b.row)<=2 AND abs(a.col-b.col)<=2 GROUP BY 1,2,3")
def neighbourhood_dominance(spark, d):
    return raster.neighbourhood_dominance(lens.tiles(spark, d), 2).select("tile_id", "row", "col", F.round("neighbourhood", 6).alias("neighbourhood"))


@query(f"WITH {lens.TILES}, w AS (SELECT tile_id//4 AS tile_id, row+8*(tile_id%4//2) AS row, col+8*(tile_id%2) AS col, elev FROM tiles) SELECT a.tile_id, CAST(a.row AS INTEGER) AS row, CAST(a.col AS INTEGER) AS col, round(count(*) FILTER (WHERE b.elev<a.elev)*1e0/(count(*)-1),6) AS neighbourhood FROM w a JOIN w b ON a.tile_id=b.tile_id AND abs(a.row-b.row)<=3 AND abs(a.col-b.col)<=3 GROUP BY 1,2,3")
def neighbourhood_across_blocks(spark, d):
    """Rasters of 16 x 16 cells in blocks of 8: windows reach into the blocks around."""
    t = F.col("tile_id")
    wide = lens.tiles(spark, d).select(F.floor(t / 4).alias("tile_id"), (F.col("row") + 8 * F.floor(t % 4 / 2)).cast("int").alias("row"), (F.col("col") + 8 * (t % 2)).cast("int").alias("col"), "elev")
    return grids.dominance(wide, 2, 3, side=8).select("tile_id", "row", "col", F.round("neighbourhood", 6).alias("neighbourhood"))


@query(f"WITH {lens.TILES} SELECT a.tile_id, a.row, a.col, round(4*max(a.elev)-sum(b.elev),6) AS curvature FROM tiles a JOIN tiles b ON a.tile_id=b.tile_id AND abs(a.row-b.row)+abs(a.col-b.col)=1 GROUP BY 1,2,3 HAVING count(*)=4")
def laplacian(spark, d):
    return raster.laplacian(lens.tiles(spark, d)).select("tile_id", "row", "col", F.round("curvature", 6).alias("curvature"))


@query(f"WITH {lens.TILES} SELECT a.tile_id, a.row, a.col, round(min((a.elev-b.elev)/(2*sqrt((a.row<>b.row)::INT+(a.col<>b.col)::INT))),8) AS gradient_min, round(avg((a.elev-b.elev)/(2*sqrt((a.row<>b.row)::INT+(a.col<>b.col)::INT))),8) AS gradient_mean FROM tiles a JOIN tiles b ON a.tile_id=b.tile_id AND abs(a.row-b.row) IN (0,2) AND abs(a.col-b.col) IN (0,2) AND (a.row<>b.row OR a.col<>b.col) GROUP BY 1,2,3")
def directional_gradients(spark, d):
    g = raster.gradients(lens.tiles(spark, d), 2)
    return g.groupBy("tile_id", "row", "col").agg(F.round(F.min("gradient"), 8).alias("gradient_min"), F.round(F.avg("gradient"), 8).alias("gradient_mean"))


@query(f"WITH {lens.TILES}, r AS (SELECT *, max(elev) OVER (PARTITION BY tile_id)-min(elev) OVER (PARTITION BY tile_id) AS relief, cume_dist() OVER (PARTITION BY tile_id ORDER BY elev) AS percentile, (rank() OVER (PARTITION BY tile_id ORDER BY elev)-1)*1e0/count(*) OVER (PARTITION BY tile_id) AS lower_share FROM tiles) SELECT tile_id, row, col, round(relief,6) AS relief, round(percentile,6) AS percentile, round(lower_share,6) AS lower_share FROM r WHERE row=3 AND col=4")
def terrain_features(spark, d):
    seeds = table(spark, d, "embeddings", ["vec_id"]).select(F.col("vec_id").alias("tile_id"), F.lit(3).alias("row"), F.lit(4).alias("col"))
    return raster.terrain_features(lens.tiles(spark, d), seeds).select("tile_id", "row", "col", _r("relief"), _r("percentile"), _r("lower_share"))


@query(f"WITH RECURSIVE {lens.TILES}, top AS (SELECT tile_id, arg_max(row*8+col, struct_pack(e := elev, r := -row, c := -col)) AS p, max(elev) AS e FROM tiles GROUP BY 1), high AS (SELECT t.tile_id, t.row, t.col FROM tiles t JOIN top USING (tile_id) WHERE t.elev>=top.e-10), zone AS (SELECT tile_id, CAST(p//8 AS INTEGER) AS row, CAST(p%8 AS INTEGER) AS col FROM top UNION SELECT h.tile_id, h.row, h.col FROM zone z JOIN high h ON h.tile_id=z.tile_id AND abs(h.row-z.row)+abs(h.col-z.col)=1) SELECT tile_id, count(*) AS cells, CAST(sum(row) AS BIGINT) AS rows_sum, CAST(sum(col) AS BIGINT) AS cols_sum FROM zone GROUP BY 1")
def summit_zone_cells(spark, d):
    z = raster.zone(lens.tiles(spark, d), 10.0)
    return z.groupBy("tile_id").agg(F.count("*").alias("cells"), F.sum("row").alias("rows_sum"), F.sum("col").alias("cols_sum"))


_FAR = "(({a}.row-{b}.row)*({a}.row-{b}.row)+({a}.col-{b}.col)*({a}.col-{b}.col))>=4"
_NEAR = "tiles a JOIN tiles b ON a.tile_id=b.tile_id AND "


@query(f"""WITH {lens.TILES}, peaks AS (SELECT a.tile_id, a.row, a.col, a.elev FROM {_NEAR} abs(a.row-b.row)<=2 AND abs(a.col-b.col)<=2 GROUP BY 1,2,3,4 HAVING max(b.elev)=a.elev),
radial AS (SELECT a.tile_id, a.row, a.col, avg(CASE WHEN b.elev<a.elev THEN 1e0 ELSE 0e0 END) AS radial FROM {_NEAR} abs(a.row-b.row) IN (0,2) AND abs(a.col-b.col) IN (0,2) AND (a.row<>b.row OR a.col<>b.col) GROUP BY 1,2,3),
near AS (SELECT a.tile_id, a.row, a.col, count(*) FILTER (WHERE b.elev<a.elev)*1e0/(count(*)-1) AS near FROM {_NEAR} abs(a.row-b.row)<=3 AND abs(a.col-b.col)<=3 GROUP BY 1,2,3),
c AS (SELECT *, round_even(0.6e0*radial+0.4e0*near, 3) AS confidence, sqrt((row-3)*(row-3)+(col-4)*(col-4)) AS distance FROM peaks JOIN radial USING (tile_id, row, col) JOIN near USING (tile_id, row, col)),
o AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY -floor(confidence*10), -floor(elev/2), distance, row, col) AS n FROM c),
one AS (SELECT * FROM o WHERE n=1),
two AS (SELECT o.* FROM o JOIN one USING (tile_id) WHERE {_FAR.format(a="o", b="one")} QUALIFY row_number() OVER (PARTITION BY o.tile_id ORDER BY o.n)=1),
three AS (SELECT o.* FROM o JOIN one USING (tile_id) JOIN two USING (tile_id) WHERE {_FAR.format(a="o", b="one")} AND {_FAR.format(a="o", b="two")} AND o.n>two.n QUALIFY row_number() OVER (PARTITION BY o.tile_id ORDER BY o.n)=1)
SELECT tile_id, row, col, elev, confidence, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, 1 AS rank FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three)""")
def raster_topk_separated(spark, d):
    """Greedy choice with a least distance."""
    seeds = table(spark, d, "embeddings", ["vec_id"]).select(F.col("vec_id").alias("tile_id"), F.lit(3).alias("seed_row"), F.lit(4).alias("seed_col"))
    return raster.snap(lens.tiles(spark, d), seeds)


def _claims_sql(seeds: str) -> str:
    """Seeds (k, seed_id, elevation, lat, lng) one after the other, with the places taken so far."""
    place = _hav("(lat+(r*7+k%3)/20000e0)", "lng", "p.lat", "p.lng")
    return f"""WITH RECURSIVE {seeds}, s AS (SELECT *, row_number() OVER (ORDER BY elevation DESC NULLS LAST, seed_id) AS i FROM c),
step AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS seed_id, 0 AS rank, false AS collided, CAST([] AS STRUCT(lat DOUBLE, lng DOUBLE)[]) AS taken
UNION ALL SELECT i, seed_id, coalesce(f, 1), f IS NULL, list_append(taken, {{'lat': lat+(coalesce(f, 1)*7+k%3)/20000e0, 'lng': lng}}) FROM (SELECT s.*, taken,
  list_filter([1, 2, 3], lambda r: len(list_filter(taken, lambda p: {place}<=50))=0)[1] AS f FROM step JOIN s ON s.i=step.i+1))
SELECT seed_id, rank, collided FROM step WHERE i>0"""


@query(_claims_sql("""c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS seed_id, CASE WHEN c_custkey%9<>0 THEN c_acctbal END AS elevation,
  CASE WHEN c_custkey%10=0 THEN 20e0+c_custkey/16000e0 ELSE 30e0+(c_custkey//7)%4000/100e0+c_custkey%7/5000e0 END AS lat, -100e0-(c_custkey//28000)/10e0 AS lng FROM customer)"""))
def claim_assignment_spread(spark, d):
    """Customers in many small groups and one long chain of a tenth of them, which is settled in rounds."""
    k = F.col("c_custkey")
    lat = F.when(k % 10 == 0, 20.0 + k / 16000.0).otherwise(30.0 + F.floor(k / 7) % 4000 / 100.0 + k % 7 / 5000.0)
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select(k.cast("string").alias("seed_id"), k.alias("k"), F.when(k % 9 != 0, F.col("c_acctbal")).alias("elevation"), lat.alias("lat"), (-100.0 - F.floor(k / 28000) / 10.0).alias("lng"))
    moves = F.array(*[F.struct(F.lit(r).alias("rank"), (F.col("lat") + (r * 7 + F.col("k") % 3) / 20000.0).alias("lat"), F.col("lng").alias("lng")) for r in (1, 2, 3)])
    return claims.assign_unclaimed(c.select("seed_id", "elevation"), c.select("seed_id", F.inline(moves)), most=50)


@query(_claims_sql(f"{lens.SUPPLIERS}, c AS (SELECT key AS k, site_id AS seed_id, elevation, 37e0+key%40/5000e0 AS lat, -109e0+(key//40)/5000e0 AS lng FROM suppliers)"))
def claim_assignment(spark, d):
    """Claims in the order of elevation, all in one crowd."""
    s = lens.suppliers(spark, d)
    moves = F.array(*[F.struct(F.lit(r).alias("rank"), (F.col("lat") + (r * 7 + F.col("key") % 3) / 20000.0).alias("lat"), F.col("lng").alias("lng")) for r in (1, 2, 3)])
    crowded = s.withColumn("lat", 37.0 + F.col("key") % 40 / 5000.0).withColumn("lng", -109.0 + F.floor(F.col("key") / 40) / 5000.0)
    return claims.assign_unclaimed(s.select("site_id", "elevation").withColumnRenamed("site_id", "seed_id"), crowded.select(F.col("site_id").alias("seed_id"), F.inline(moves)))


@query()
def train_eval_forest(spark, d):
    """Cross-validated forest on terrain features of tiles."""
    seeds = table(spark, d, "embeddings", ["vec_id"]).select(F.col("vec_id").alias("tile_id"), F.lit(3).alias("row"), F.lit(4).alias("col"))
    rows = raster.terrain_features(lens.tiles(spark, d), seeds).withColumn("label", (F.col("percentile") > 0.7).cast("int"))
    return ml.cross_validate(rows, ["gradient_min", "gradient_mean", "gradient_var", "curvature", "relief", "lower_share"], "tile_id", k=3, trees=20)


@query()
def forest_importances(spark, d):
    """What a forest learns a tile's high cells from, without any feature that tells their rank; tests hold it against a feature of noise."""
    seeds = lens.tiles(spark, d).where((F.col("row") >= 2) & (F.col("row") <= 5) & (F.col("col") >= 2) & (F.col("col") <= 5)).select("tile_id", "row", "col")
    rows = raster.terrain_features(lens.tiles(spark, d), seeds).withColumn("label", (F.col("percentile") > 0.7).cast("int"))
    columns = ["gradient_min", "gradient_mean", "gradient_var", "curvature", "relief"]
    return ml.importances(ml.fit_forest(rows, columns, trees=10), columns)
