"""More queries over the driver's tables: updates, imports, pages, texts, collections, terrain."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, scores, text, times
from ..operators import batches, catalog, lands, ledger, ml, pages, predicates, progress, queue, raster, repair, updates, visits
from ..session import cut, shared_folder
from ..sources import commits, readers, sinks
from ..sources.readers import table
from ..streaming import events as streams
from . import lens
from .queries import _hav, _r, query

# --- geometry -----------------------------------------------------------------------------------


def _broken(spark, d) -> DataFrame:
    """A polygon for each part: a square, a bow tie, a square with two holes that overlap, squares with a common edge, or one with repeated corners."""
    k = F.col("p_partkey")
    size, west, south = (1 + k % 3).cast("double"), (k % 300 - 150).cast("double"), (k % 160 - 80).cast("double")

    def ring(*corners):
        return F.array(*[F.struct((west + size * x).alias("lng"), (south + size * y).alias("lat")) for x, y in corners])

    square = lambda x, y, side: ring((x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y))
    shapes = [F.array(square(0, 0, 1)), F.array(ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))), F.array(square(0, 0, 1), square(0.25, 0.25, 0.5), square(0.5, 0.5, 0.25)), F.array(square(0, 0, 0.5), square(0.5, 0, 0.5)), F.array(ring((0, 0), (0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 0)))]
    rings = shapes[-1]
    for i, shape in enumerate(shapes[:-1]):
        rings = F.when(k % 5 == i, shape).otherwise(rings)
    return table(spark, d, "part", ["p_partkey"]).select(k.alias("poly_id"), rings.alias("rings"))


@query("SELECT p_partkey AS poly_id, CASE WHEN p_partkey%5=0 THEN 'valid' ELSE 'repaired' END AS repair, CAST(CASE p_partkey%5 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS rings, round((1+p_partkey%3)*(1+p_partkey%3)*(CASE p_partkey%5 WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.8125e0 WHEN 3 THEN 0.5e0 ELSE 1e0 END),5) AS area FROM part")
def repair_geometries(spark, d):
    """Areas of what the even-odd rule fills; holes of the results go the other way and count against it."""
    found = repair.repair(_broken(spark, d))
    area = F.aggregate("rings", F.lit(0.0), lambda s, r: s + geo.signed_area(r))
    return found.select("poly_id", "repair", F.size("rings").alias("rings"), F.round(area, 5).alias("area"))


# --- places in text -----------------------------------------------------------------------------

_LAT, _LNG = "(37+(s_suppkey*37)%40)", "(100+(s_suppkey*53)%70)"


@query(f"SELECT s_suppkey, round(CASE s_suppkey%5 WHEN 4 THEN {_LAT}+0.5e0 ELSE {_LAT}+0.25125e0 END, 9) AS lat, round(-(CASE s_suppkey%5 WHEN 4 THEN {_LNG}+0.75e0 ELSE {_LNG}+0.75125e0 END), 9) AS lng FROM supplier")
def coords_from_text(spark, d):
    """Decimals with directions behind and before them, signed decimals, after noise, and degrees with minutes only."""
    s = F.col("s_suppkey")
    lat, lng = (37 + s * 37 % 40).cast("string"), (100 + s * 53 % 70).cast("string")
    a, b = F.concat(lat, F.lit(".25125")), F.concat(lng, F.lit(".75125"))
    one = F.concat(F.lit("Peak 12.345, at "), a, F.lit("°N, "), b, F.lit("°W"))
    two = F.concat(F.lit("<p>N "), a, F.lit(", W "), b, F.lit("</p>"))
    three = F.concat(F.lit("0.5000, 0.2500 then "), a, F.lit(", -"), b)
    four = F.concat(a, F.lit(" N "), b, F.lit(" W, once 40.1234, 105.1234"))
    five = F.concat(lat, F.lit("° 30&#039; N, "), lng, F.lit("°45' W"))
    written = F.when(s % 5 == 0, one).when(s % 5 == 1, two).when(s % 5 == 2, three).when(s % 5 == 3, four).otherwise(five)
    rows = table(spark, d, "supplier", ["s_suppkey"]).withColumn("w", written)
    lat, lng = text.coords_from_text("w")
    return rows.select("s_suppkey", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"))


@query("SELECT s_suppkey, round(CASE s_suppkey%3 WHEN 0 THEN s_suppkey%90+(s_suppkey%60)/60e0+((s_suppkey*7)%60)/3600e0 WHEN 1 THEN s_suppkey%90+(s_suppkey%60)/60e0 ELSE -(s_suppkey%90+0e0) END,9) AS lat, round(CASE s_suppkey%3 WHEN 0 THEN -((s_suppkey*3)%180+((s_suppkey*11)%60)/60e0+((s_suppkey*13)%60+0.5e0)/3600e0) WHEN 1 THEN (s_suppkey*3)%180+((s_suppkey*11)%60)/60e0 ELSE (s_suppkey*3)%180+0e0 END,9) AS lng FROM supplier")
def dms_forms(spark, d):
    """Directions in front, seconds left out, minutes left out."""
    s = F.col("s_suppkey")
    full = F.format_string("near N %d° %d' %d\", W %d° %d' %d.5\" ok", s % 90, s % 60, s * 7 % 60, s * 3 % 180, s * 11 % 60, s * 13 % 60)
    minutes = F.format_string("(%d° %d' N %d°%d′E)", s % 90, s % 60, s * 3 % 180, s * 11 % 60)
    bare = F.format_string("s %d°, e %d°", s % 90, s * 3 % 180)
    rows = table(spark, d, "supplier", ["s_suppkey"]).withColumn("w", F.when(s % 3 == 0, full).when(s % 3 == 1, minutes).otherwise(bare))
    lat, lng = text.coords_from_dms("w")
    return rows.select("s_suppkey", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"))


# --- pages --------------------------------------------------------------------------------------


def _lists(spark, d) -> DataFrame:
    """Pages with links of a crawl beside their own."""
    k = F.col("page_id")
    more = F.concat(F.lit('<a href="/peaks/'), (k % 40).cast("string"), F.lit('-mount-x">a</a><a href="https://www.list.example.org/peaks/login/'), (k % 7).cast("string"), F.lit('">b</a><A class="x" HREF=\'//list.example.org/peaks/'), (k % 9).cast("string"), F.lit("-y#top'>c</A>"), F.when(k % 11 == 0, "<p>Cloudflare: Checking your browser</p>").otherwise(""))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("https://list.example.org/list/"), k.cast("string")).alias("url"), F.concat("html", more).alias("html"))


@query("WITH p AS (SELECT page_id FROM pages WHERE page_id%11<>0 AND NOT (contains(lower(html),'cloudflare') AND (contains(lower(html),'attention required') OR contains(lower(html),'checking your browser') OR contains(lower(html),'cf-chl') OR contains(lower(html),'cf-browser-verification')))), l AS (SELECT page_id, 'https://list.example.org/peaks/'||(page_id%40)||'-mount-x' AS url FROM p UNION ALL SELECT page_id, 'https://list.example.org/peaks/'||(page_id%9)||'-y' FROM p) SELECT url, min(page_id) AS from_page FROM l GROUP BY 1")
def page_links(spark, d):
    return pages.listed(_lists(spark, d), "list.example.org", r"^/peaks/", ("/login", "/wiki/"))


@query("""WITH x AS (SELECT page_id, html, 38+(page_id%5)+0.1234e0 AS lat, -105-(page_id%3)-0.5678e0 AS lng FROM pages)
SELECT page_id, CASE WHEN page_id%13=0 THEN NULL ELSE 'Mount '||page_id||' & Co' END AS name, CASE WHEN page_id%4=3 THEN NULL ELSE lat END AS lat, CASE WHEN page_id%4=3 THEN NULL ELSE lng END AS lng, round((13000+page_id%1000)*0.3048e0,6) AS elevation, 'Lake '||(page_id%6) AS county, page_id%13=0 AS blocked FROM x""")
def page_details(spark, d):
    """Detail pages with a map link, with text only, and with neither."""
    k = F.col("page_id")
    lat, lng = F.concat((38 + k % 5).cast("string"), F.lit(".1234")), F.concat(F.lit("-"), (105 + k % 3).cast("string"), F.lit(".5678"))
    place = F.when(k % 4 == 0, F.concat(F.lit('<a href="https://maps.example.com/?z=1&q='), lat, F.lit(","), lng, F.lit('">map</a>'))).when(k % 4 == 1, F.concat(F.lit('<a href="https://osm.example.org/?mlat='), lat, F.lit("&mlon="), lng, F.lit('">map</a>'))).when(k % 4 == 2, F.concat(F.lit("<p>At "), lat, F.lit(", "), lng, F.lit("</p>"))).otherwise("")
    head = F.concat(F.lit("<html><h1 class='t'> Mount <b>"), k.cast("string"), F.lit("</b> &amp; Co</h1>"), place, F.lit("<table><tr><td>Elevation</td><td>"), F.format_number((13000 + k % 1000).cast("double"), 0), F.lit(" feet</td></tr><tr><td>County</td><td> Lake\n "), (k % 6).cast("string"), F.lit("</td></tr></table>"), F.when(k % 13 == 0, "<!-- cloudflare cf-chl -->").otherwise(""), F.lit("</html>"))
    out = pages.details(table(spark, d, "pages", ["page_id"]).withColumn("html", head))
    return out.select("page_id", "name", "lat", "lng", _r("elevation"), "county", "blocked")


@query("SELECT p_brand, p_partkey, p_name AS name, CAST(p_partkey+1 AS INTEGER) AS overall_rank, p_size AS rank, round((10000+p_partkey%4000)*0.3048e0,6) AS elevation FROM part WHERE p_partkey%3<>0")
def rank_table(spark, d):
    """Tables of ranks, one page for each brand; rows without a rank go."""
    k = F.col("p_partkey")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    row = F.concat(F.lit('<tr class="r">'), cell(F.concat(F.lit('<a href="/x/1">'), "p_name", F.lit("</a>"))), cell(k.cast("string")), cell(F.format_number(k + 1, 0)), cell(F.when(k % 3 != 0, F.col("p_size").cast("string")).otherwise("n/a")), cell(F.concat(F.format_number(10000 + k % 4000, 0), F.lit("'"))), cell(F.lit("range &amp; sons")), F.lit("</tr>"))
    html = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("h")))), lambda x: x["h"]), "\n").alias("html"))
    found = pages.rank_rows(html.select(F.col("p_brand").alias("page_id"), F.concat(F.lit("<table><tr><th>n</th></tr>"), "html", F.lit("</table>")).alias("html")))
    number = F.col("overall_rank").cast("long") - 1
    return found.select(F.col("page_id").alias("p_brand"), number.alias("p_partkey"), "name", "overall_rank", "rank", _r("elevation"))


def _text_sql(html: str) -> str:
    """Text of a piece of HTML as ``strip_tags`` has it: without scripts, styles and tags, entities read, blanks as one."""
    out = f"regexp_replace(regexp_replace({html}, '<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g')"
    for written, char in (("&#0?39;|&apos;", "''"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&deg;", "°"), ("&amp;", "&")):
        out = f"regexp_replace({out}, '{written}', '{char}', 'g')"
    return f"nullif(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '')"


def _heading_sql(tag: str) -> str:
    return _text_sql(f"regexp_extract(html, '<{tag}\\b[^>]*>(.*?)</{tag}>', 1, 'is')")


@query(f"SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items, coalesce({_heading_sql('h1')}, {_heading_sql('title')}) AS name FROM pages")
def page_headings(spark, d):
    """Headings of the pages as they are."""
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("items"), text.heading("html").alias("name"))


# --- messages -----------------------------------------------------------------------------------

_MESSAGES = """m AS (SELECT event_id AS id, ts AS created, event_id%300+1 AS activity_id, CASE WHEN event_id%2=0 THEN 'T'||event_id END AS title, CASE WHEN event_id%3=0 THEN 'Run' END AS sport, CASE event_id%5 WHEN 0 THEN true WHEN 1 THEN false END AS is_public FROM events WHERE event_type='click'),
asked AS (SELECT activity_id, arg_max(title, (created, id)) FILTER (WHERE title IS NOT NULL) AS title, arg_max(sport, (created, id)) FILTER (WHERE sport IS NOT NULL) AS sport, arg_max(is_public, (created, id)) FILTER (WHERE is_public IS NOT NULL) AS is_public FROM m GROUP BY 1)"""


def _asked(spark, d) -> DataFrame:
    e = F.col("event_id")
    parts = [F.when(e % 2 == 0, F.concat(F.lit('"title":"T'), e.cast("string"), F.lit('"'))).otherwise('"title":5'), F.when(e % 3 == 0, '"type":"Run"'), F.when(e % 5 == 0, '"private":"false"').when(e % 5 == 1, '"private":true')]
    body = F.concat(F.lit('{"aspect_type":"update","object_id":'), (e % 300 + 1).cast("string"), F.lit(',"updates":{'), F.concat_ws(",", *parts), F.lit("}}"))
    return updates.patches(table(spark, d, "events", ["event_id", "ts", "event_type"]).where("event_type = 'click'").select(e.alias("id"), F.col("ts").alias("created"), body.alias("json_data")))


def _activities(spark, d) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"]).select(o.alias("activity_id"), F.concat(F.lit("A"), o.cast("string")).alias("title"), F.col("o_orderpriority").alias("sport"), (F.col("o_orderstatus") == "F").alias("is_public"), (o % 10 == 0).alias("manual_title"))


@query(f"WITH {_MESSAGES} SELECT o_orderkey AS activity_id, CASE WHEN o_orderkey%10=0 THEN 'A'||o_orderkey ELSE coalesce(a.title, 'A'||o_orderkey) END AS title, coalesce(a.sport, o_orderpriority) AS sport, coalesce(a.is_public, o_orderstatus='F') AS is_public FROM orders LEFT JOIN asked a ON a.activity_id=o_orderkey")
def process_updates(spark, d):
    return updates.apply_updates(_activities(spark, d), _asked(spark, d), "manual_title").drop("manual_title")


@query(f"WITH {_MESSAGES} SELECT 'activities' AS tbl, coalesce(a.is_public, o_orderstatus='F') AS is_public, count(*) AS n FROM orders LEFT JOIN asked a ON a.activity_id=o_orderkey GROUP BY 1,2 UNION ALL SELECT 'visits', coalesce(a.is_public, l_returnflag='A'), count(*) FROM lineitem LEFT JOIN asked a ON a.activity_id=l_orderkey GROUP BY 1,2")
def visibility_spread(spark, d):
    item = table(spark, d, "lineitem", ["l_orderkey", "l_returnflag"]).select(F.col("l_orderkey").alias("activity_id"), (F.col("l_returnflag") == "A").alias("is_public"))
    found = updates.spread_visibility({"activities": _activities(spark, d), "visits": item}, _asked(spark, d))
    return reduce(DataFrame.unionByName, [df.groupBy("is_public").agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "is_public", "n") for n, df in found.items()])


@query("SELECT 'activities' AS tbl, count(*) AS n, count(*) AS own FROM orders WHERE o_orderkey%7<>0 UNION ALL SELECT 'visits', count(*), count(*) FROM lineitem WHERE l_returnflag<>'R' AND l_orderkey%7<>0 UNION ALL SELECT 'manual', count(*), count(*) FILTER (WHERE l_orderkey%7<>0) FROM lineitem WHERE l_returnflag='R'")
def process_deletes(spark, d):
    item = table(spark, d, "lineitem", ["l_orderkey", "l_returnflag"]).withColumnRenamed("l_orderkey", "activity_id")
    o = _activities(spark, d)
    left = updates.apply_deletes({"activities": o, "visits": item.where("l_returnflag <> 'R'"), "manual": item.where("l_returnflag = 'R'")}, o.where("activity_id % 7 = 0"), "manual")
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("tbl"), F.count("*").alias("n"), F.count("activity_id").alias("own")) for n, df in left.items()])


@query("SELECT o_orderkey FROM orders WHERE (CASE o_orderkey%5 WHEN 0 THEN 'Golf' WHEN 1 THEN 'Hike' WHEN 2 THEN 'Snowboard' WHEN 3 THEN 'Run' END) IS NULL OR o_orderkey%5 IN (1,3)")
def sport_blocklist(spark, d):
    o = F.col("o_orderkey")
    sport = F.when(o % 5 == 0, "Golf").when(o % 5 == 1, "Hike").when(o % 5 == 2, "Snowboard").when(o % 5 == 3, "Run")
    return table(spark, d, "orders", ["o_orderkey"]).where(updates.counted_sport(sport))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30' AND o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('P') AND o_orderpriority ILIKE '%hIGh%' AND o_orderpriority LIKE '2%' AND o_totalprice >= 1000")
def option_filters(spark, d):
    """Filters put together from options; one isn't set."""
    from datetime import datetime

    o = table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"])
    found = predicates.chosen(o, {"o_orderdate__between": (datetime(1995, 1, 1), datetime(1996, 6, 30)), "o_orderstatus__not_in": ["P"], "o_orderpriority__ilike": "%hIGh%", "o_orderpriority__like": "2%", "o_totalprice__least": 1000.0, "o_custkey": None})
    return found.select("o_orderkey")


@query("SELECT a.n_nationkey AS k, b.n_nationkey AS same FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey WHERE (b.n_nationkey+0e0) BETWEEN a.n_nationkey-5e0 AND a.n_nationkey+5e0 AND (b.n_nationkey*2e0) BETWEEN a.n_nationkey*2-4e0 AND a.n_nationkey*2+4e0")
def box_compare(spark, d):
    n = table(spark, d, "nation", ["n_nationkey", "n_regionkey"])
    both = n.join(n.select(F.col("n_nationkey").alias("same"), "n_regionkey"), "n_regionkey")
    x, y = F.col("same").cast("double"), F.col("same") * 2.0
    return both.where(geo.same_place(x, y, F.col("n_nationkey"), F.col("n_nationkey") * 2, F.lit(5.0), F.lit(4.0))).select(F.col("n_nationkey").alias("k"), "same")


# --- visits and candidates ----------------------------------------------------------------------


@query("WITH " + lens.POINTS + f""", box AS (SELECT track_id, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM points GROUP BY 1),
wide AS (SELECT track_id, south-500/110574e0 AS south, north+500/110574e0 AS north, west-abs(500/(40075000e0*cos(greatest(abs(south),abs(north))/57.2958e0))*360) AS west, east+abs(500/(40075000e0*cos(greatest(abs(south),abs(north))/57.2958e0))*360) AS east FROM box),
met AS (SELECT p.track_id, s.site_id, min({_hav("p.lat", "p.lng", "s.lat", "s.lng")}) AS nearest_m FROM points p JOIN suppliers s ON abs(p.lat-s.lat)<=200/110574e0 AND abs(p.lng-s.lng)<=200/(40075000e0*cos(s.lat/57.2958e0))*360 JOIN wide w ON w.track_id=p.track_id AND s.lng>west AND s.lng<east AND s.lat>south AND s.lat<north GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY nearest_m, site_id) AS n FROM met) SELECT track_id, site_id, round(nearest_m,4) AS nearest_m FROM r WHERE n<=3""")
def candidate_cap(spark, d):
    """Sites a track came near, the three nearest."""
    return visits.candidate_sites(lens.points(spark, d), lens.suppliers(spark, d), most=3).select("track_id", "site_id", _r("nearest_m", 4))


@query()
def trial_run(spark, d):
    """Visits of the 50 latest tracks without altitudes; a test holds it against the full run."""
    p = lens.points(spark, d)
    tracks = p.groupBy("track_id").agg(F.max("t").alias("ts"))
    return visits.trial_run(tracks, p, lens.sites(spark, d)).select("track_id", "site_id", F.col("visit").cast("long"), "mode", _r("confidence"))


_SAVED = f"WITH {lens.VISITS}, v AS (SELECT *, activity_id%10 AS user_id FROM visits), known AS (SELECT * FROM v WHERE visit_id%4=0), manual AS (SELECT * FROM v WHERE visit_id%4=2), new AS (SELECT * FROM v WHERE visit_id%2=1), ids AS (SELECT *, CAST(activity_id AS VARCHAR) || '-' || CAST(site_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts)//1000%1000 AS VARCHAR),3,'0') || 'Z' AS id FROM new)"


def _saved(spark, d):
    v = lens.visits(spark, d).withColumn("user_id", F.col("activity_id") % 10)
    row = v.select("user_id", "activity_id", "site_id", "ts", (F.col("visit_id") / 7.0).alias("confidence"), F.lit(False).alias("needs_confirmation"), F.col("visit_id").alias("n"))
    known = row.where("n % 4 = 0").withColumn("visit_id", ledger.visit_id(F.col("activity_id").cast("string"), F.col("site_id").cast("string"), F.col("ts")))
    return known.drop("n"), row.where("n % 2 = 1").drop("n"), row.where("n % 4 = 2").withColumn("activity_id", F.lit(None).cast("long")).drop("n")


@query(_SAVED + " SELECT id AS visit_id, user_id FROM ids n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.user_id=n.user_id AND k.site_id=n.site_id AND k.activity_id<>n.activity_id AND abs(epoch_us(k.ts)-epoch_us(n.ts))<=1000000) AND NOT EXISTS (SELECT 1 FROM manual k WHERE k.user_id=n.user_id AND k.site_id=n.site_id AND abs(epoch_us(k.ts)-epoch_us(n.ts))<=1000000)")
def save_visits(spark, d):
    """The rows that the ledger gains."""
    known, new, manual = _saved(spark, d)
    after = ledger.save_visits(known.dropDuplicates(["visit_id"]), new, manual, 1)
    return after.join(known.select("visit_id"), "visit_id", "left_anti").select("visit_id", "user_id")


@query(_SAVED + " SELECT id AS visit_id FROM ids n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.activity_id=n.activity_id AND k.site_id=n.site_id AND abs(epoch_us(k.ts)-epoch_us(n.ts))<=60000000)")
def reprocess_ledger(spark, d):
    known, new, _ = _saved(spark, d)
    after = ledger.reprocess(known.dropDuplicates(["visit_id"]), new, 60)
    return after.join(known.select("visit_id"), "visit_id", "left_anti").select("visit_id")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='P') GROUP BY 1")
def delete_returning(spark, d):
    item = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    gone = table(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ledger.returning(item, gone, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY min(event_id), event_type) AS place FROM events GROUP BY 1")
def first_seen_counts(spark, d):
    return progress.first_seen_counts(table(spark, d, "events", ["event_id", "event_type"]), "event_type", "event_id")


@query("SELECT count(*) AS n, true AS small FROM events")
def outbox_batches(spark, d):
    """All messages stand in batches of ten at most."""
    out = sinks.outbox(table(spark, d, "events", ["event_id"]), "event_id").groupBy("batch").agg(F.count("*").alias("k"))
    return out.agg(F.sum("k").alias("n"), (F.max("k") <= 10).alias("small"))


@query("SELECT count(*) AS n, true AS small FROM supplier")
def lookup_batches(spark, d):
    out = readers.lookup_batches(lens.suppliers(spark, d), "site_id")
    return out.agg(F.sum(F.size("ids")).alias("n"), F.bool_and((F.size("ids") <= 100) & (F.size(F.split("locations", "\\|")) == F.size("ids"))).alias("small"))


@query("SELECT CAST(sum(o_orderkey%50) AS BIGINT) AS processed, CAST(sum(o_orderkey%7) AS BIGINT) AS found, CAST(sum(o_orderkey%3) AS BIGINT) AS errors, round(sum(o_orderkey%50)/1e6*100,6) AS percent, round(sum(o_orderkey%50)/(epoch_us(max(o_orderdate))/1e6-epoch_us(min(o_orderdate))/1e6),12) AS rate FROM orders")
def batch_totals(spark, d):
    o = F.col("o_orderkey")
    done = table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select((o % 50).alias("processed"), (o % 7).alias("found"), (o % 3).alias("errors"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("ended_at"))
    return batches.totals(done, 1000000).select("processed", "found", "errors", _r("percent"), F.round("rate", 12).alias("rate"))


# --- catalogue ----------------------------------------------------------------------------------

_STATES = "states AS (SELECT *, CASE key%3 WHEN 0 THEN 'US-'||substr(code,1,2) WHEN 1 THEN NULL ELSE 'ZZ' END AS iso, CASE WHEN key%2=0 THEN 'P'||key END AS postal FROM polygons)"


@query(f"WITH {lens.PLACES}, {lens.POLYGONS}, {_STATES}, c AS (SELECT p.site_id, p.lat, p.lng, coalesce(CASE WHEN p.key%3=0 THEN 'US' END, CASE WHEN g.region%2=0 THEN 'US' WHEN g.code IS NOT NULL THEN 'CA' END) AS country FROM places p LEFT JOIN polygons g ON p.lng>g.west AND p.lng<g.east AND p.lat>g.south AND p.lat<g.north) SELECT c.site_id, country, CASE WHEN s.iso LIKE '%-%' THEN split_part(s.iso,'-',2) ELSE coalesce(s.postal, s.iso, s.code) END AS state, CASE WHEN country='US' THEN (CASE WHEN s.key%4=0 THEN s.code ELSE s.code||' County' END) END AS county FROM c LEFT JOIN states s ON c.lng>s.west AND c.lng<s.east AND c.lat>s.south AND c.lat<s.north")
def geocode_levels(spark, d):
    g = lens.polygons(spark, d)
    k = F.col("key")
    p = lens.places(spark, d).select("site_id", "lat", "lng", F.when(k % 3 == 0, "US").alias("country"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("county"))
    countries = g.withColumn("code", F.when(F.col("region") % 2 == 0, "US").otherwise("CA"))
    states = g.select("rings", F.when(k % 3 == 0, F.concat(F.lit("US-"), F.substring("code", 1, 2))).when(k % 3 == 2, "ZZ").alias("iso"), F.when(k % 2 == 0, F.concat(F.lit("P"), k.cast("string"))).alias("postal"), F.col("code").alias("name"))
    counties = g.select("rings", F.when(k % 4 != 0, F.concat("code", F.lit(" County"))).alias("longer"), F.col("code").alias("name"))
    return catalog.geocode_levels(p, countries, states, counties).select("site_id", "country", "state", "county")


@query(f"WITH {lens.PLACES}, {lens.POLYGONS}, o AS (SELECT * FROM places WHERE country IS NULL ORDER BY site_id LIMIT 20) SELECT p.site_id, coalesce(p.country, min(g.code)) AS country FROM places p LEFT JOIN polygons g ON p.site_id IN (SELECT site_id FROM o) AND p.lng>g.west AND p.lng<g.east AND p.lat>g.south AND p.lat<g.north GROUP BY p.site_id, p.country")
def geocode_batch(spark, d):
    return catalog.geocode(lens.places(spark, d), lens.polygons(spark, d), "country", batch=20).select("site_id", "country")


@query("SELECT s_suppkey, CASE s_suppkey%4 WHEN 0 THEN 'CO' WHEN 1 THEN 'WY' WHEN 2 THEN NULL END AS by_name, CASE s_suppkey%3 WHEN 0 THEN 'CA' WHEN 1 THEN 'NM' END AS short FROM supplier")
def state_codes(spark, d):
    s = F.col("s_suppkey")
    name = F.when(s % 4 == 0, "Colorado").when(s % 4 == 1, "Wyoming").when(s % 4 == 2, "Nowhere")
    code = F.when(s % 3 == 0, "US-CA").when(s % 3 == 1, "us-nm").otherwise("US")
    return table(spark, d, "supplier", ["s_suppkey"]).select("s_suppkey", text.state_of(name).alias("by_name"), text.short_code(code).alias("short"))


_SNAP = "snap AS (SELECT site_id, key, lat, lng, elevation, key%2=0 AS needs_review, lat+0.001e0 AS snapped_lat, lng-0.001e0 AS snapped_lng, CASE WHEN key%6<>0 THEN elevation+5 END AS snapped_elevation FROM places)"


@query(f"WITH {lens.PLACES}, {_SNAP}, c AS (SELECT *, CASE key%6 WHEN 0 THEN 'accept' WHEN 2 THEN 'custom' WHEN 4 THEN 'reject' END AS action FROM snap) SELECT site_id, round(CASE action WHEN 'accept' THEN snapped_lat WHEN 'custom' THEN 40e0 ELSE lat END,9) AS lat, round(CASE action WHEN 'accept' THEN snapped_lng WHEN 'custom' THEN -105e0 ELSE lng END,9) AS lng, round(CASE WHEN action IN ('accept','custom') THEN coalesce(snapped_elevation, elevation) ELSE elevation END,6) AS elevation, CASE WHEN action IS NULL THEN needs_review ELSE false END AS needs_review, action IN ('accept','custom') IS TRUE AS moved FROM c")
def review_accept(spark, d):
    k = F.col("key")
    s = lens.places(spark, d).select("site_id", "key", "lat", "lng", "elevation", (k % 2 == 0).alias("needs_review"), (F.col("lat") + 0.001).alias("snapped_lat"), (F.col("lng") - 0.001).alias("snapped_lng"), F.when(k % 6 != 0, F.col("elevation") + 5).alias("snapped_elevation"), F.lit(None).cast("double").alias("snapped_distance_m"))
    decisions = s.where("key % 6 in (0, 2, 4)").select("site_id", F.when(k % 6 == 0, "accept").when(k % 6 == 2, "custom").otherwise("reject").alias("action"), F.lit(40.0).alias("lat"), F.lit(-105.0).alias("lng"))
    out = catalog.accept(s, decisions)
    return out.select("site_id", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), _r("elevation"), "needs_review", F.col("snapped_distance_m").isNotNull().alias("moved"))


@query(f"WITH {lens.PLACES}, {lens.POLYGONS} SELECT site_id, poly_id FROM places p JOIN polygons g ON p.lng>g.west AND p.lng<g.east AND p.lat>g.south AND p.lat<g.north WHERE p.key%3<>0")
def tags_reset(spark, d):
    """Tags that are left when sites have moved."""
    p = lens.places(spark, d)
    tags = catalog.tag_lands(p, lens.polygons(spark, d), p.limit(0))
    return catalog.without_tags(tags, p.where("key % 3 = 0"))


@query(f"WITH {lens.PLACES} SELECT site_id, CASE WHEN key%4=1 THEN coalesce(elevation, 700e0+key) ELSE elevation END AS elevation, CASE WHEN key%4=1 THEN false WHEN key%4=2 THEN true END AS elevation_failed FROM places")
def lookup_marks(spark, d):
    """Elevations looked up in vain are marked; a service's no data value counts as that."""
    p = lens.places(spark, d).select("site_id", "key", "elevation")
    found = p.where("key % 4 in (1, 2)").select("site_id", F.when(F.col("key") % 4 == 1, 700.0 + F.col("key")).otherwise(-1000000.0).alias("value"))
    return catalog.attempted(p, readers.elevations(found), "elevation", F.lit("2024-01-01").cast("timestamp_ntz")).select("site_id", "elevation", "elevation_failed")


@query("SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN NULL ELSE s_acctbal END AS one, CASE WHEN s_suppkey%3=0 OR s_acctbal*2<-1000 THEN NULL ELSE s_acctbal*2 END AS many FROM supplier")
def elevation_services(spark, d):
    s = table(spark, d, "supplier", ["s_suppkey", "s_acctbal"])
    missing = F.col("s_suppkey") % 3 == 0
    one = readers.elevations(s.select("s_suppkey", F.when(missing, -1000000.0).otherwise(F.col("s_acctbal")).alias("one")), "one")
    many = readers.global_elevations(s.select("s_suppkey", F.when(missing, -9999.0).otherwise(F.col("s_acctbal") * 2).alias("many")), "many")
    return one.join(many, "s_suppkey")


@query(f"WITH {lens.PLACES}, x AS (SELECT key AS ext_id, lat+1 AS lat, lng-1 AS lng, CASE WHEN key%2=0 THEN 4000e0+key ELSE 0e0 END AS height FROM places WHERE key%3=1) SELECT p.site_id, round(coalesce(x.lat, p.lat),9) AS lat, round(coalesce(x.lng, p.lng),9) AS lng, CASE WHEN x.height>0 THEN x.height ELSE p.elevation END AS elevation, CASE WHEN x.height>0 THEN 'list' END AS elevation_source, x.ext_id IS NULL AS lands_checked FROM places p LEFT JOIN x ON x.ext_id=p.key")
def link_policies(spark, d):
    p = lens.places(spark, d)
    k = F.col("key")
    ext = p.where("key % 3 = 1").select(k.alias("ext_id"), (F.col("lat") + 1).alias("lat"), (F.col("lng") - 1).alias("lng"), F.when(k % 2 == 0, 4000.0 + k).otherwise(0.0).alias("elevation"))
    links = p.where("key % 3 = 1").select("site_id", F.lit("x").alias("source"), k.alias("ext_id"))
    own = p.select("site_id", "lat", "lng", "elevation", F.lit(None).cast("string").alias("elevation_source"), F.lit(True).alias("lands_checked"))
    out = catalog.linked_values(own, links, ext, coordinates=True, elevation=True, label="list")
    return out.select("site_id", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), "elevation", "elevation_source", "lands_checked")


def _ingested(spark, d):
    """A reviewed import: approved rows are linked, rejected ones become sites, pending ones wait, those without an id are left out."""
    c = F.col("c_custkey")
    sites = lens.suppliers(spark, d).select("site_id", "name", "lat", "lng", "elevation")
    ext = table(spark, d, "customer", ["c_custkey", "c_name"]).select(F.when(c % 5 != 0, c.cast("string")).alias("ext_id"), F.lit("list").alias("source"), F.col("c_name").alias("name"), F.lit(39.0).alias("lat"), F.lit(-105.0).alias("lng"), F.lit(1.0).alias("elevation"))
    n = sites.count()
    decisions = table(spark, d, "customer", ["c_custkey"]).where((c % 4 != 2) & ((c % 4 != 0) | (c < n))).select(c.cast("string").alias("ext_id"), c.cast("string").alias("site_id"), F.when(c % 4 == 0, True).when(c % 4 == 1, False).alias("approved"))
    links = spark.createDataFrame([], "site_id string, source string, ext_id string")
    return catalog.ingest(sites, links, ext, decisions)


@query("WITH e AS (SELECT c_custkey, c_custkey%4 AS m FROM customer WHERE c_custkey%5<>0) SELECT 'sites' AS tbl, (SELECT count(*) FROM supplier)+(SELECT count(*) FROM e WHERE m=1) AS n UNION ALL SELECT 'links', (SELECT count(*) FROM e WHERE m=1)+(SELECT count(*) FROM e WHERE m=0 AND c_custkey<(SELECT count(*) FROM supplier))")
def ingest_external(spark, d):
    """How many rows the tables of a reviewed import have."""
    after, linked = _ingested(spark, d)
    return after.agg(F.lit("sites").alias("tbl"), F.count("*").alias("n")).unionByName(linked.agg(F.lit("links").alias("tbl"), F.count("*").alias("n")))


@query("""WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS ext_id, c_custkey AS k, c_name FROM customer WHERE c_custkey%5<>0), f AS (SELECT *, 'x'||substr(sha256('list:'||ext_id),1,24) AS id FROM e WHERE k%4=1)
SELECT 'sites' AS tbl, CAST(s_suppkey AS VARCHAR) AS site_id, s_name AS name, CAST(NULL AS VARCHAR) AS ext_id FROM supplier UNION ALL SELECT 'sites', id, c_name, NULL FROM f
UNION ALL SELECT 'links', id, NULL, ext_id FROM f UNION ALL SELECT 'links', ext_id, NULL, ext_id FROM e WHERE k%4=0 AND k<(SELECT count(*) FROM supplier)""")
def ingest_external_rows(spark, d):
    """The same import, row by row."""
    after, linked = _ingested(spark, d)
    return after.select(F.lit("sites").alias("tbl"), "site_id", "name", F.lit(None).cast("string").alias("ext_id")).unionByName(linked.select(F.lit("links").alias("tbl"), "site_id", F.lit(None).cast("string").alias("name"), "ext_id"))


_REVIEWED = "m AS (SELECT p_partkey, p_name||' '||p_partkey AS name, CASE WHEN p_partkey%6=0 THEN 0e0 ELSE 39e0+p_partkey/1e4 END AS lat, -105e0 AS lng, CAST(p_partkey AS VARCHAR) AS site_id, CASE p_partkey%5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS confidence, p_partkey%10=1 AS create_new FROM part), u AS (SELECT *, CASE WHEN NOT create_new AND confidence IN ('high','medium') THEN 'matched' WHEN (confidence='none' OR create_new) AND lat<>0 THEN 'created' ELSE 'left_out' END AS use FROM m)"


def _reviewed(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    level = F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").when(k % 5 == 2, "low").otherwise("none")
    return table(spark, d, "part", ["p_partkey", "p_name"]).select(F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), F.when(k % 6 == 0, 0.0).otherwise(39.0 + k / 10000).alias("lat"), F.lit(-105.0).alias("lng"), F.lit(1000.0).alias("elevation"), k.cast("string").alias("site_id"), level.alias("confidence"), (k % 10 == 1).alias("create_new"))


@query(f"WITH {_REVIEWED} SELECT confidence, use, count(*) AS n FROM u GROUP BY 1,2")
def collection_inclusion(spark, d):
    return catalog.collection_matches(_reviewed(spark, d)).groupBy("confidence", "use").agg(F.count("*").alias("n"))


@query(f"WITH {_REVIEWED} SELECT 'catalogue' AS tbl, (SELECT count(*) FROM part)+(SELECT count(*) FROM u WHERE use='created') AS n, (SELECT count(*) FROM u WHERE use='created') AS in_state, round((SELECT sum(CASE WHEN use='matched' THEN CASE WHEN lat=0 THEN 1e0 ELSE lat END ELSE 1e0 END) FROM u)+(SELECT coalesce(sum(lat),0) FROM u WHERE use='created'),6) AS lats UNION ALL SELECT 'members', (SELECT count(*) FROM u WHERE use<>'left_out')+1, NULL, NULL")
def collection_load(spark, d):
    catalogue = table(spark, d, "part", ["p_partkey"]).select(F.col("p_partkey").cast("string").alias("site_id"), F.lit("n").alias("name"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lng"), F.lit(1.0).alias("elevation"), F.lit(None).cast("string").alias("state"))
    members = spark.createDataFrame([(7, "old"), (8, "other")], "collection_id long, site_id string")
    after, own = catalog.load_collection(catalogue, members, 7, _reviewed(spark, d), "Colorado", move=True)
    one = after.agg(F.lit("catalogue").alias("tbl"), F.count("*").alias("n"), F.count_if(F.col("state") == "CO").alias("in_state"), F.round(F.sum("lat"), 6).alias("lats"))
    return one.unionByName(own.agg(F.lit("members").alias("tbl"), F.count("*").alias("n"), F.lit(None).cast("long").alias("in_state"), F.lit(None).cast("double").alias("lats")))


@query(f"""WITH {_REVIEWED}, n AS (SELECT *, CASE WHEN use='matched' THEN site_id ELSE 'x'||substr(sha256('Colorado:'||name),1,24) END AS id FROM u WHERE use<>'left_out')
SELECT 'sites' AS tbl, p.site_id, 'n' AS name, coalesce(nullif(n.lat,0e0),1e0) AS lat, CASE WHEN n.id IS NULL THEN 1e0 ELSE 1000e0 END AS elevation, CAST(NULL AS VARCHAR) AS state FROM (SELECT CAST(p_partkey AS VARCHAR) AS site_id FROM part) p LEFT JOIN n ON n.id=p.site_id
UNION ALL SELECT 'sites', id, name, lat, 1000e0, 'CO' FROM n WHERE use='created' UNION ALL SELECT 'members', id, NULL, NULL, NULL, NULL FROM n UNION ALL SELECT 'members', 'other', NULL, NULL, NULL, NULL""")
def collection_load_committed(spark, d):
    """The same load, as one commit of both tables, read back row by row."""
    catalogue = table(spark, d, "part", ["p_partkey"]).select(F.col("p_partkey").cast("string").alias("site_id"), F.lit("n").alias("name"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lng"), F.lit(1.0).alias("elevation"), F.lit(None).cast("string").alias("state"))
    members = spark.createDataFrame([(7, "old"), (8, "other")], "collection_id long, site_id string")
    store = commits.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.commit(lambda view: {"sites": commits.Change(catalogue), "members": commits.Change(members)})

    def load(view):
        sites, own = catalog.load_collection(view.read("sites"), view.read("members"), 7, _reviewed(spark, d), "Colorado", move=True)
        return {"sites": commits.Change(sites), "members": commits.Change(own)}

    store.commit(load)
    sites = store.read("sites").select(F.lit("sites").alias("tbl"), "site_id", "name", "lat", "elevation", "state")
    return sites.unionByName(store.read("members").select(F.lit("members").alias("tbl"), "site_id"), allowMissingColumns=True)


@query(f"WITH {_REVIEWED} SELECT count(*) AS total, count(*) FILTER (WHERE confidence='high') AS high, count(*) FILTER (WHERE confidence='medium') AS medium, count(*) FILTER (WHERE confidence='low') AS low, count(*) FILTER (WHERE confidence='none') AS none, round(100e0*count(*) FILTER (WHERE confidence<>'none')/count(*),1) AS matched_percent FROM m")
def review_counts(spark, d):
    return catalog.review_counts(_reviewed(spark, d))


_FEATURES = "f AS (SELECT p_partkey AS k, trim(p_name) AS name, CASE p_partkey%4 WHEN 0 THEN 'NP' WHEN 1 THEN 'WILD' WHEN 2 THEN 'OTHER' END AS des, CASE p_partkey%5 WHEN 0 THEN p_partkey*1e0 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE p_partkey*2e0 END AS acres0, CASE WHEN p_partkey%5=1 THEN p_partkey*10000e0 END AS area, p_partkey%9<>0 AS sound FROM part), a AS (SELECT *, coalesce(nullif(acres0,0), nullif(area,0)/4046.86e0) AS acres FROM f), l AS (SELECT * FROM a WHERE sound AND (coalesce(des IN ('NP','WILD'),false) OR coalesce(acres>=1000,false)))"


def _features(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    des = F.when(k % 4 == 0, "NP").when(k % 4 == 1, "WILD").when(k % 4 == 2, "OTHER")
    acres = F.when(k % 5 == 0, k * 1.0).when(k % 5 >= 3, k * 2.0)
    area = F.when(k % 5 == 1, k * 10000.0)
    some = F.filter(F.array(F.struct(F.lit("UNIT_NM").alias("k"), F.concat(F.lit(" \t"), "p_name", F.lit("\u0001 ")).alias("v")), F.struct(F.lit("des_tp").alias("k"), des.alias("v")), F.struct(F.lit("GIS_Acres").alias("k"), acres.cast("string").alias("v")), F.struct(F.lit("Shape_Area").alias("k"), area.cast("string").alias("v"))), lambda e: e["v"].isNotNull())
    ring = geo.envelope(F.lit(-105.0), F.lit(39.0), F.lit(-104.0), F.lit(40.0))
    rings = F.array(F.when(k % 9 != 0, ring).otherwise(F.slice(ring, F.lit(1), F.lit(3))))
    return table(spark, d, "part", ["p_partkey", "p_name"]).select("p_partkey", F.map_from_entries(some).alias("properties"), rings.alias("rings"))


@query(f"WITH {_FEATURES} SELECT name, des AS designation, round(acres,6) AS acres FROM l")
def lands_import(spark, d):
    return lands.public_lands(_features(spark, d)).select("name", "designation", _r("acres"))


@query(f"WITH {_FEATURES} SELECT des AS designation, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, designation NULLS LAST LIMIT 15")
def lands_top_designations(spark, d):
    return lands.by_designation(lands.public_lands(_features(spark, d)))


@query(f"WITH {_FEATURES} SELECT name, round(coalesce(nullif(acres0,0),0),6) AS acres FROM f WHERE sound")
def boundaries_import(spark, d):
    out = lands.boundaries(_features(spark, d), {"name": ("unit_nm",), "acres": ("gis_acres",)})
    return out.select("name", F.round(F.coalesce(F.nullif(F.col("acres").cast("double"), F.lit(0.0)), F.lit(0.0)), 6).alias("acres"))


@query(f"WITH {_FEATURES} SELECT k AS p_partkey, CASE WHEN sound THEN CAST(5 AS BIGINT) ELSE 3 END AS vertices, CAST(5 AS BIGINT) AS most FROM f ORDER BY vertices DESC, k LIMIT 20")
def heaviest_geometries(spark, d):
    return lands.heaviest(_features(spark, d), "p_partkey").select("p_partkey", F.col("vertices").cast("long").alias("vertices"), F.col("most").cast("long").alias("most"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*)>1 ORDER BY n DESC, l_partkey LIMIT 10")
def busiest_sites(spark, d):
    return lands.busiest(table(spark, d, "lineitem", ["l_partkey"]), "l_partkey")


@query("SELECT o_custkey, count(*) AS n FROM orders o LEFT JOIN customer c ON c.c_custkey=o.o_custkey WHERE c.c_mktsegment='BUILDING' GROUP BY 1")
def neutral_left_join(spark, d):
    """A left join whose condition on the right side makes it an inner one; the optimiser says so itself."""
    c = table(spark, d, "customer", ["c_custkey", "c_mktsegment"])
    o = table(spark, d, "orders", ["o_custkey"])
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").where("c_mktsegment = 'BUILDING'").groupBy("o_custkey").agg(F.count("*").alias("n"))


# --- texts, times, geometry ---------------------------------------------------------------------


@query("WITH g AS (SELECT o_custkey, list('Peak '||o_orderkey ORDER BY o_orderkey) AS n FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN len(n)=1 THEN 'One visit' ELSE len(n)||' visits' END AS title, CASE WHEN len(n)=1 THEN n[1] WHEN len(n)>3 THEN array_to_string(n[1:3],', ')||' and '||(len(n)-3)||' more' ELSE array_to_string(n,', ') END AS body FROM g")
def notices(spark, d):
    o = table(spark, d, "orders", ["o_custkey", "o_orderkey"]).groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("Peak "), k.cast("string"))).alias("names"))
    title, body = text.notice(F.col("names"), "One visit", "visits")
    return o.select("o_custkey", title.alias("title"), body.alias("body"))


@query("SELECT event_id, CASE WHEN event_id%2=0 THEN 'Ride '||event_id ELSE 'plain '||event_id END AS kept FROM events")
def description_strip(spark, d):
    e = F.col("event_id").cast("string")
    x = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Ride "), e, F.lit("  --app\nold text --app again"))).otherwise(F.concat(F.lit("plain "), e))
    return table(spark, d, "events", ["event_id"]).select("event_id", text.before_marker(x, "--app").alias("kept"))


@query("WITH x AS (SELECT event_id AS i, (event_id*37)%100000 AS s FROM events) SELECT i AS event_id, CASE WHEN s<60 THEN printf('%.1fs', s*1e0) WHEN s<3600 THEN (s//60)||'m '||(s%60)||'s' ELSE (s//3600)||'h '||(s%3600//60)||'m' END AS took, CASE WHEN s<1 THEN printf('%.2f sq m', s+0.25e0) WHEN s<1000 THEN printf('%.0f sq m', s+0.25e0) ELSE printf('%.1fk sq m', (s+0.25e0)/1000e0) END AS area, lpad(CAST(i AS VARCHAR),8,' ')||'|'||rpad('x'||(i%10),4,' ') AS padded, CASE WHEN i%7=0 THEN '?' ELSE printf('%.2f', i*1e0) END AS fixed FROM x")
def text_formats(spark, d):
    e = F.col("event_id")
    s = e * 37 % 100000
    area = scores.area_text(s + 0.25)
    padded = F.concat(text.padded(e, 8, right=True), F.lit("|"), text.padded(F.concat(F.lit("x"), (e % 10).cast("string")), 4))
    return table(spark, d, "events", ["event_id"]).select("event_id", times.duration(s).alias("took"), area.alias("area"), padded.alias("padded"), text.fixed(F.when(e % 7 != 0, e), 2).alias("fixed"))


@query("SELECT event_id, date_trunc('second', ts) AS instant, strftime(ts - to_hours(CAST(event_id%12 AS BIGINT)), '%Y-%m-%dT%H:%M:%S')||(CASE WHEN event_id%12=0 THEN '+' ELSE '-' END)||lpad(CAST(event_id%12 AS VARCHAR),2,'0')||':00' AS local FROM events")
def local_times(spark, d):
    """A wall clock with its offset, and back."""
    e = table(spark, d, "events", ["event_id", "ts"]).withColumn("local", times.local_text("ts", -(F.col("event_id") % 12) * 3600))
    back = times.from_local("local", F.substring("local", 20, 6)).cast("timestamp_ntz")
    return e.select("event_id", back.alias("instant"), "local")


@query("SELECT event_id, greatest(0, CAST(floor(least(600-event_id%700, 6000-(event_id*7)%6500)/3e0) AS BIGINT)) AS allowance FROM events")
def even_share(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events", ["event_id"]).select("event_id", scores.even_share(F.lit(600), e % 700, F.lit(6000), e * 7 % 6500).alias("allowance"))


@query("SELECT s_suppkey, CASE s_suppkey%3 WHEN 0 THEN 'usgs_3dep_1m' WHEN 1 THEN 'usgs_3dep_10m' ELSE 'usgs_3dep' END AS source FROM supplier")
def raster_names(spark, d):
    s = F.col("s_suppkey")
    return table(spark, d, "supplier", ["s_suppkey"]).select("s_suppkey", text.raster_source(F.when(s % 3 == 0, "/dem/co_1m.vrt").when(s % 3 == 1, "/dem/co_10m.vrt").otherwise("/dem/co.tif")).alias("source"))


@query("SELECT o_custkey, CAST(i-1 AS INTEGER) AS idx, CASE WHEN i<=len(l) AND o_custkey%2=0 THEN t[i] ELSE i-1e0 END AS t, l[i]/10e0 AS lat, -l[i]/20e0 AS lng FROM (SELECT o_custkey, l, list_transform(l, lambda x: x*3e0) AS t, unnest(range(1, len(l)+1)) AS i FROM (SELECT o_custkey, list(o_orderkey%100 ORDER BY o_orderkey) AS l FROM orders GROUP BY 1))")
def stream_points(spark, d):
    """Points of stream bundles; odd users have no times, and times come as a bare array or as an object."""
    rows = table(spark, d, "orders", ["o_custkey", "o_orderkey"]).groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: (k % 100).cast("double")).alias("l"))
    t = F.transform("l", lambda x: x * 3)
    written = F.when(F.col("o_custkey") % 4 == 0, F.to_json(t)).when(F.col("o_custkey") % 4 == 2, F.to_json(F.struct(t.alias("data"))))
    bundle = rows.select("o_custkey", F.struct(F.transform("l", lambda x: F.array(x / 10, -x / 20)).alias("data")).alias("latlng"), F.struct(readers.either_stream(written).alias("data")).alias("time"), F.struct(F.lit(None).cast("array<double>").alias("data")).alias("altitude"))
    out = readers.points_of_streams(bundle, "o_custkey")
    return out.select(F.col("track_id").cast("long").alias("o_custkey"), "idx", "t", "lat", "lng")


@query(f"""WITH {lens.SUPPLIERS}, p AS (SELECT site_id, lat AS a, lng AS o, lat+0.003e0*(key%7) AS b, lng+0.01e0 AS u FROM suppliers),
r AS (SELECT *, atan((1-f)*tan(radians(a))) AS ra, atan((1-f)*tan(radians(b))) AS rb FROM p, (SELECT (6378137e0-6356752.314245e0)/6378137e0 AS f)),
c AS (SELECT *, pow(sin((rb-ra)/2),2)+cos(ra)*cos(rb)*pow(sin(radians(u-o)/2),2) AS h FROM r), s AS (SELECT *, 2*atan2(sqrt(h), sqrt(1-h)) AS g, (ra+rb)/2 AS m, (rb-ra)/2 AS q FROM c)
SELECT site_id, round({_hav('a', 'o', 'b', 'u')},4) AS sphere, round(2*6371000e0*asin(sqrt(pow(sin(radians(b-a)/2),2)+cos(radians(a))*cos(radians(b))*pow(sin(radians(u-o)/2),2))),4) AS by_sine,
  round(6378137e0*(g-f/2*((g-sin(g))*pow(sin(m)*cos(q)/cos(g/2),2)+(g+sin(g))*pow(cos(m)*sin(q)/sin(g/2),2))),3) AS spheroid FROM s""")
def distance_forms(spark, d):
    """Metres by the arc tangent, by the arc sine, and on the spheroid."""
    s = lens.suppliers(spark, d).withColumn("to_lat", F.col("lat") + 0.003 * (F.col("key") % 7)).withColumn("to_lng", F.col("lng") + 0.01)
    sphere, sine, real = (f("lat", "lng", "to_lat", "to_lng") for f in (geo.haversine, geo.haversine_asin, geo.spheroid_distance))
    return s.select("site_id", F.round(sphere, 4).alias("sphere"), F.round(sine, 4).alias("by_sine"), F.round(real, 3).alias("spheroid"))


@query(f"""WITH n AS (SELECT n_nationkey AS k, 10e0+n_nationkey AS lat, n_nationkey-120e0 AS lng FROM nation), g AS (SELECT k, lat, lng, lat+i*5/111320e0 AS a, lng+j*5/(111320e0*cos(radians(lat))) AS o FROM n, range(-5, 6) x(i), range(-5, 6) y(j))
SELECT k AS n_nationkey, 'grid' AS kind, round(a,9) AS lat, round(o,9) AS lng FROM g WHERE {_hav('lat', 'lng', 'a', 'o')}<=25.01e0
UNION ALL SELECT k, 'far', round(lat+100*cos(k*0.7e0)/111320e0,9), round(lng+100*sin(k*0.7e0)/(111320e0*cos(radians(lat))),9) FROM n""")
def candidate_grid(spark, d):
    """Grid points within 25 m, five metres apart, and a point 100 m away at an angle."""
    k = F.col("n_nationkey")
    n = table(spark, d, "nation", ["n_nationkey"]).select(k, (10.0 + k).alias("lat"), (k - 120.0).alias("lng"))
    grid = n.select(k, F.lit("grid").alias("kind"), F.explode(geo.grid_around("lat", "lng", 25.01, 5.0)).alias("p")).select(k, "kind", _r("p.lat", 9).alias("lat"), _r("p.lng", 9).alias("lng"))
    lat, lng = geo.offset_point("lat", "lng", F.lit(100.0), k * 0.7)
    return grid.unionByName(n.select(k, F.lit("far").alias("kind"), F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng")))


@query(f"WITH {lens.POLYGONS} SELECT poly_id, round((south+north)/2,9) AS lat, round((west+east)/2,9) AS lng, true AS sound, true AS same FROM polygons")
def polygon_texts(spark, d):
    """Centres of polygons that went through WKT and GeoJSON."""
    g = lens.polygons(spark, d).withColumn("ring", F.get("rings", F.lit(0)))
    written = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["lng"], p["lat"]))).alias("coordinates")))
    g = g.withColumn("wkt", geo.geojson_wkt(written)).withColumn("read", geo.parse_polygon("wkt"))
    lat, lng = geo.ring_centroid(F.get("read", F.lit(0)))
    line = geo.as_geojson("ring")
    same = (F.col("read") == F.col("rings")) & (geo.geojson_wkt(F.lit('{"type":"Line"}')) == "") & (F.get_json_object(line, "$.type") == "LineString")
    return g.select("poly_id", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"), geo.sound_rings("read").alias("sound"), same.alias("same"))


# --- terrain ------------------------------------------------------------------------------------

_SITE_FEATURES = f"""WITH {lens.TILES}, seed AS (SELECT * FROM tiles WHERE row=3 AND col=4), g AS (SELECT a.tile_id, a.elev-b.elev AS v, b.row-a.row AS dr, b.col-a.col AS dc FROM seed a JOIN tiles b ON a.tile_id=b.tile_id AND abs(a.row-b.row) IN (0,2) AND abs(a.col-b.col) IN (0,2) AND (a.row<>b.row OR a.col<>b.col)),
gg AS (SELECT tile_id, max(v) FILTER (WHERE dr=-2 AND dc=0) AS gradient_N, max(v) FILTER (WHERE dr=2 AND dc=2) AS gradient_SE, min(v) AS min_gradient, avg(v) AS mean_gradient, var_pop(v) AS grad_variance FROM g GROUP BY 1),
r AS (SELECT *, max(elev) OVER (PARTITION BY tile_id)-min(elev) OVER (PARTITION BY tile_id) AS local_relief, cume_dist() OVER (PARTITION BY tile_id ORDER BY elev) AS elev_rank, (rank() OVER (PARTITION BY tile_id ORDER BY elev)-1)*1e0/count(*) OVER (PARTITION BY tile_id) AS pct_lower FROM tiles),
c AS (SELECT a.tile_id, 4*max(a.elev)-sum(b.elev) AS curvature FROM seed a JOIN tiles b ON a.tile_id=b.tile_id AND abs(a.row-b.row)+abs(a.col-b.col)=1 GROUP BY 1)
SELECT r.tile_id, round(elev_rank,6) AS elev_rank, round(gradient_N,6) AS gradient_n, round(gradient_SE,6) AS gradient_se, round(min_gradient,6) AS min_gradient, round(mean_gradient,4) AS mean_gradient, round(grad_variance,4) AS grad_variance, round(local_relief,6) AS local_relief, round(pct_lower,6) AS pct_lower, round(curvature,6) AS curvature, 1.5e0 AS dist_to_seed FROM r JOIN gg USING (tile_id) JOIN c USING (tile_id) WHERE row=3 AND col=4"""


@query(_SITE_FEATURES)
def site_features(spark, d):
    points = table(spark, d, "embeddings", ["vec_id"]).select(F.col("vec_id").alias("tile_id"), F.lit(3).alias("row"), F.lit(4).alias("col"), F.lit(1.5).alias("dist_to_seed"))
    out = raster.site_features(lens.tiles(spark, d), points)
    return out.select("tile_id", _r("elev_rank"), F.round("gradient_N", 6).alias("gradient_n"), F.round("gradient_SE", 6).alias("gradient_se"), _r("min_gradient"), _r("mean_gradient", 4), _r("grad_variance", 4), _r("local_relief"), _r("pct_lower"), _r("curvature"), "dist_to_seed")


@query(f"""WITH {lens.TILES}, s AS (SELECT a.tile_id, a.row, a.col, max(a.elev) AS elev, sum(b.elev*(b.col-a.col)*(CASE WHEN b.row=a.row THEN 2 ELSE 1 END)) AS gx, sum(b.elev*(b.row-a.row)*(CASE WHEN b.col=a.col THEN 2 ELSE 1 END)) AS gy FROM tiles a JOIN tiles b ON a.tile_id=b.tile_id AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1 GROUP BY 1,2,3 HAVING count(*)=9),
q AS (SELECT *, abs(abs(gx)-abs(gy))/(sqrt(gx*gx+gy*gy)+1e-6) AS asymmetry FROM s), t AS (SELECT tile_id, max(elev) AS top FROM tiles GROUP BY 1),
k AS (SELECT q.tile_id, q.row, q.col, asymmetry, row_number() OVER (PARTITION BY q.tile_id ORDER BY asymmetry DESC, q.row, q.col) AS n FROM q JOIN t USING (tile_id) WHERE q.row BETWEEN 2 AND 5 AND q.col BETWEEN 2 AND 5 AND elev>=top-30 AND asymmetry>=0.5 AND sqrt((q.row-3)*(q.row-3)+(q.col-4)*(q.col-4))>=1) SELECT tile_id, row, col, round(asymmetry,6) AS asymmetry FROM k WHERE n<=2""")
def ridge_points(spark, d):
    seeds = table(spark, d, "embeddings", ["vec_id"]).select(F.col("vec_id").alias("tile_id"), F.lit(3).alias("seed_row"), F.lit(4).alias("seed_col"))
    return raster.ridge_points(lens.tiles(spark, d), seeds, apart=1.0).select("tile_id", "row", "col", _r("asymmetry"))


@query(f"WITH {lens.TILES}, m AS (SELECT a.tile_id, a.row, a.col, max(a.elev) AS elev FROM tiles a JOIN tiles b ON a.tile_id=b.tile_id AND abs(a.row-b.row)<=2 AND abs(a.col-b.col)<=2 GROUP BY 1,2,3 HAVING max(b.elev)=max(a.elev)), t AS (SELECT tile_id, max(elev) AS top FROM tiles GROUP BY 1), r AS (SELECT m.*, row_number() OVER (PARTITION BY m.tile_id ORDER BY row, col) AS n FROM m JOIN t USING (tile_id) WHERE top-elev BETWEEN 5 AND 50) SELECT tile_id, row, col, round(elev,6) AS elev FROM r WHERE n<=2")
def secondary_peaks(spark, d):
    return raster.secondary_peaks(lens.tiles(spark, d)).select("tile_id", "row", "col", _r("elev"))


def _seeds(spark, d) -> DataFrame:
    return table(spark, d, "embeddings", ["vec_id"]).select(F.col("vec_id").alias("tile_id"), F.lit(3).alias("seed_row"), F.lit(4).alias("seed_col"))


@query()
def training_rows(spark, d):
    """Samples of all kinds with their features; which cells are random is a matter of hashes, so a test checks the rules."""
    out = ml.training_rows(lens.tiles(spark, d), _seeds(spark, d))
    return out.select("tile_id", "row", "col", "sample", "label", *[_r(c) for c in raster.FEATURES])


@query()
def predict_sites(spark, d):
    """Candidates ranked by a forest fitted on the tiles' samples."""
    cells, seeds = lens.tiles(spark, d), _seeds(spark, d)
    model = ml.fit_forest(cut(ml.training_rows(cells, seeds)), raster.FEATURES, trees=10)
    return ml.predict_sites(model, cells, seeds, k=6, apart=2.0)


@query("SELECT vec_id AS tile_id, vec_id%3 AS p, row_number() OVER (PARTITION BY vec_id%10 ORDER BY vec_id%3 DESC, vec_id DESC) AS rank, vec_id=max(vec_id) OVER (PARTITION BY vec_id%10) AS is_highest FROM embeddings")
def rank_predictions(spark, d):
    v = F.col("vec_id")
    rows = table(spark, d, "embeddings", ["vec_id"]).select((v % 10).alias("tile_id"), F.lit(0).alias("row"), v.alias("col"), v.cast("double").alias("elevation"), (v % 3).alias("probability"))
    return ml.ranked(rows).select(F.col("col").alias("tile_id"), F.col("probability").alias("p"), F.col("rank").cast("long").alias("rank"), "is_highest")


@query("SELECT m AS metric, round(avg(v),9) AS mean, round(stddev_pop(v),9) AS std, CASE WHEN m='accuracy' THEN avg(v)>=0.9 END AS good FROM (SELECT unnest(['accuracy','precision','recall','f1']) AS m, unnest([1-n_nationkey/100e0, n_nationkey/50e0, n_nationkey/25e0, 0.5e0]) AS v FROM nation) GROUP BY 1")
def fold_summary(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation", ["n_nationkey"]).select((1 - k / 100.0).alias("accuracy"), (k / 50.0).alias("precision"), (k / 25.0).alias("recall"), F.lit(0.5).alias("f1"))
    return ml.summary(rows).select("metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "good")


@query(f"""WITH RECURSIVE {lens.TILES}, top AS (SELECT tile_id, arg_max(row*8+col, struct_pack(e := elev, r := -row, c := -col)) AS p, max(elev) AS e FROM tiles GROUP BY 1), high AS (SELECT t.tile_id, t.row, t.col FROM tiles t JOIN top USING (tile_id) WHERE t.elev>=top.e-10), zone AS (SELECT tile_id, CAST(p//8 AS INTEGER) AS row, CAST(p%8 AS INTEGER) AS col FROM top UNION SELECT h.tile_id, h.row, h.col FROM zone z JOIN high h ON h.tile_id=z.tile_id AND abs(h.row-z.row)+abs(h.col-z.col)=1),
z AS (SELECT tile_id, count(*) AS n, avg(row)+0.5e0 AS r, avg(col)+0.5e0 AS c FROM zone GROUP BY 1), q AS (SELECT z.*, top.e, n*0.0001e0*0.0001e0*111320e0*111320e0*cos(radians(40e0-r*0.0001e0)) AS area FROM z JOIN top USING (tile_id))
SELECT tile_id, round(area,4) AS area_sq_m, round(40e0-r*0.0001e0,9) AS centroid_lat, round(-105e0+c*0.0001e0,9) AS centroid_lng, round(area,3) AS ring_area, round(e,6) AS max_elevation, CASE WHEN tile_id%2=0 THEN 'primary' ELSE 'fallback' END AS origin, CASE WHEN area<50 THEN 'knife-edge / point summit' WHEN area<200 THEN 'small summit area' WHEN area<1000 THEN 'moderate summit plateau' ELSE 'large / flat summit' END AS kind FROM q""")
def summit_zones(spark, d):
    """Zones as polygons, half of them from the fallback raster; the rings' own area agrees with the cells'."""
    cells = lens.tiles(spark, d)
    origin = table(spark, d, "embeddings", ["vec_id"]).select(F.col("vec_id").alias("tile_id"), F.lit(40.0).alias("lat"), F.lit(-105.0).alias("lng"), F.lit(0.0001).alias("step"))
    out = raster.summit_zones(cells.where("tile_id % 2 = 0"), cells, origin, 10.0)
    # outer rings turn one way and holes the other, so signed areas add up
    signed = F.aggregate(F.flatten(F.transform("rings", geo._edges)), F.lit(0.0), lambda s, e: s + (e["a"]["lng"] + 105) * (e["b"]["lat"] - 40) - (e["b"]["lng"] + 105) * (e["a"]["lat"] - 40)) / 2
    ring_area = F.abs(signed) * 111320.0 * 111320.0 * F.cos(F.radians("centroid_lat"))
    return out.select("tile_id", _r("area_sq_m", 4), F.round("centroid_lat", 9).alias("centroid_lat"), F.round("centroid_lng", 9).alias("centroid_lng"), F.round(ring_area, 3).alias("ring_area"), _r("max_elevation"), "origin", "kind")


@query(f"WITH {lens.PLACES} SELECT site_id FROM places WHERE elevation IS NOT NULL AND (elevation>=2000 OR key%16<8)")
def verified_sites(spark, d):
    p = lens.places(spark, d).withColumn("snapped_distance_m", F.when(F.col("elevation").isNotNull(), (F.col("key") % 16).cast("double")))
    return ml.verified(p, 2000.0).select("site_id")


_WEIGHTS = "k AS (SELECT i, exp(-(i*i)/(2*0.3e0*0.3e0)) AS w FROM (SELECT unnest([-1, 0, 1]) AS i)), n AS (SELECT i, w/(SELECT sum(w) FROM k) AS w FROM k)"


@query(f"WITH {lens.TILES}, {_WEIGHTS} SELECT a.tile_id, a.row, a.col, round(sum(x.w*y.w*b.elev),6) AS elev FROM tiles a CROSS JOIN n x CROSS JOIN n y JOIN tiles b ON b.tile_id=a.tile_id AND b.row=greatest(0,least(7,a.row+x.i)) AND b.col=greatest(0,least(7,a.col+y.i)) GROUP BY 1,2,3")
def raster_smooth(spark, d):
    """A Gaussian over three cells; at an edge the cell itself stands in for the one beyond."""
    return raster.smooth(lens.tiles(spark, d), 0.3).select("tile_id", "row", "col", _r("elev"))


@query(f"WITH {lens.PLACES} SELECT site_id, round(500e0/111320e0,9) AS half_lat, round(500e0/(111320e0*greatest(0.1e0, cos(radians(lat*2)))),9) AS half_lng FROM places")
def degree_windows(spark, d):
    lat, lng = geo.raster_window(500.0, F.col("lat") * 2)
    return lens.places(spark, d).select("site_id", F.round(lat, 9).alias("half_lat"), F.round(lng, 9).alias("half_lng"))


@query("SELECT event_id, CAST(event_id%600 AS INTEGER) AS short, CASE WHEN event_id%5<>0 THEN CAST(event_id%6000 AS INTEGER) END AS daily FROM events")
def header_usage(spark, d):
    e = F.col("event_id")
    header = F.concat((e % 600).cast("string"), F.lit(","), F.when(e % 5 != 0, (e % 6000).cast("string")).otherwise("x"))
    short, daily = queue.usage(header)
    return table(spark, d, "events", ["event_id"]).select("event_id", short.alias("short"), daily.alias("daily"))


@query("SELECT event_id, CASE event_id%3 WHEN 0 THEN 'America/Denver' ELSE 'UTC' END AS zone FROM events")
def time_zones(spark, d):
    e = F.col("event_id")
    written = F.when(e % 3 == 0, "(GMT-07:00) America/Denver").when(e % 3 == 1, "(GMT+00:00)")
    return table(spark, d, "events", ["event_id"]).select("event_id", times.time_zone(written).alias("zone"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS used FROM events GROUP BY 1")
def daily_usage(spark, d):
    """Requests of each day; a new day begins at nought."""
    out = streams.rate_windows(table(spark, d, "events", ["ts"]), "ts", "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "used")
