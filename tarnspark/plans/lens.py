"""The domain's tables seen in the driver's tables: each as a frame and as a common table expression of SQL.

Positions, altitudes and statuses are integer arithmetic on keys, so both engines make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..sources.readers import table


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    elevation = F.when(s % 5 != 0, 1500.0 + F.col("s_acctbal") / 10.0)
    return table(spark, d, "supplier").select(s.cast("string").alias("site_id"), F.col("s_name").alias("name"), (37.0 + (s * 37) % 400 / 100.0).alias("lat"), (-109.0 + (s * 53) % 700 / 100.0).alias("lng"), elevation.alias("elevation"), s.alias("key"))


SUPPLIERS = """suppliers AS (SELECT CAST(s_suppkey AS VARCHAR) AS site_id, s_name AS name, 37e0 + ((s_suppkey*37)%400)/100e0 AS lat,
  -109e0 + ((s_suppkey*53)%700)/100e0 AS lng, CASE WHEN s_suppkey%5<>0 THEN 1500e0 + s_acctbal/10e0 END AS elevation, s_suppkey AS key FROM supplier)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    return suppliers(spark, d)


SITES = SUPPLIERS + ", sites AS (SELECT * FROM suppliers)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """A point for each event, near one of the sites; which one depends on the user and the day."""
    e, u = F.col("event_id"), F.col("user_id")
    n = table(spark, d, "supplier", ["s_suppkey"]).count()
    anchor = (u * 7 + F.floor(F.dayofmonth("ts") / 3)) % n
    rows = table(spark, d, "events", ["event_id", "user_id", "ts", "event_type", "value"]).withColumn("key", anchor)
    rows = rows.join(sites(spark, d).select("key", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), "elevation"), "key")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    lat = F.col("_lat") + ((e * 31) % 21 - 10) / 20000.0 + F.when(F.col("event_type") == "error", 0.05).otherwise(0.0)
    alt = F.when(u % 4 != 0, F.coalesce("elevation", F.lit(1500.0)) + F.col("value") / 10.0)
    return rows.select(u.cast("string").alias("track_id"), idx.alias("idx"), (micros("ts") / 1e6).alias("t"), lat.alias("lat"), (F.col("_lng") + ((e * 17) % 21 - 10) / 20000.0).alias("lng"), alt.alias("alt"))


POINTS = (
    SITES
    + """, points AS (SELECT CAST(user_id AS VARCHAR) AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
  epoch_us(ts)/1e6 AS t, s.lat + ((event_id*31)%21-10)/20000e0 + CASE WHEN event_type='error' THEN 0.05e0 ELSE 0e0 END AS lat,
  s.lng + ((event_id*17)%21-10)/20000e0 AS lng, CASE WHEN user_id%4<>0 THEN coalesce(s.elevation, 1500e0) + value/10e0 END AS alt
  FROM events JOIN sites s ON s.key = (user_id*7 + day(ts)//3) % (SELECT count(*) FROM supplier))"""
)


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle for each nation."""
    k = F.col("n_nationkey")
    west, south = -109.0 + (k % 5) * 1.4, 37.0 + F.floor(k / 5) * 0.8
    corner = lambda x, y: F.struct(x.alias("lng"), y.alias("lat"))
    ring = F.array(corner(west, south), corner(west + 1.4, south), corner(west + 1.4, south + 0.8), corner(west, south + 0.8), corner(west, south))
    return table(spark, d, "nation").select(k.cast("string").alias("poly_id"), F.col("n_name").alias("code"), F.col("n_regionkey").alias("region"), F.array(ring).alias("rings"), k.alias("key"))


POLYGONS = """polygons AS (SELECT CAST(n_nationkey AS VARCHAR) AS poly_id, n_name AS code, n_regionkey AS region, -109e0 + (n_nationkey%5)*1.4e0 AS west,
  37e0 + (n_nationkey//5)*0.8e0 AS south, -109e0 + (n_nationkey%5)*1.4e0 + 1.4e0 AS east, 37e0 + (n_nationkey//5)*0.8e0 + 0.8e0 AS north, n_nationkey AS key FROM nation)"""


def coasts(spark: SparkSession, d: str) -> DataFrame:
    """A wavy polygon with a hole for each hundred customers, a corner for each of their orders; the hole goes the other way."""
    k = F.floor(F.col("o_custkey") / 100).cast("long")
    own = Window.partitionBy("coast_id")
    rows = table(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(k.alias("coast_id"), "o_orderkey")
    rows = rows.withColumn("i", F.row_number().over(own.orderBy("o_orderkey"))).withColumn("n", F.count("*").over(own))
    a = 2 * 3.141592653589793 * (F.col("i") - 0.5) / F.col("n")
    r = 0.6 + 0.15 * F.cos(3 * a) + F.col("o_orderkey") % 10 / 10.0 / F.col("n")
    at = lambda size: F.struct(F.col("i"), F.round(-109.0 + (F.col("coast_id") * 53) % 70 / 10.0 + size * r * F.cos(a), 9).alias("lng"), F.round(37.0 + (F.col("coast_id") * 37) % 40 / 10.0 + size * r * F.sin(a), 9).alias("lat"))
    rings = rows.groupBy("coast_id").agg(*[F.array_sort(F.collect_list(at(size))).alias(name) for name, size in (("_outer", 1.0), ("_hole", 0.4))])
    closed = lambda c: F.transform(F.concat(c, F.slice(c, 1, 1)), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat")))
    return rings.select("coast_id", F.array(closed(F.col("_outer")), F.reverse(closed(F.col("_hole")))).alias("rings"))


COASTS = """numbered AS (SELECT o_custkey//100 AS coast_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey//100 ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey//100) AS n FROM orders),
turns AS (SELECT *, 2*3.141592653589793e0*(i-0.5e0)/n AS a FROM numbered), waves AS (SELECT *, 0.6e0+0.15e0*cos(3*a)+o_orderkey%10/10e0/n AS r FROM turns),
corners AS (SELECT coast_id, ring, i, round(-109e0+(coast_id*53)%70/10e0+size*r*cos(a), 9) AS lng, round(37e0+(coast_id*37)%40/10e0+size*r*sin(a), 9) AS lat FROM waves, (VALUES (1, 1e0), (2, 0.4e0)) AS s(ring, size))"""


def spots(spark: SparkSession, d: str) -> DataFrame:
    """A place for each customer."""
    c = F.col("c_custkey")
    return table(spark, d, "customer", ["c_custkey"]).select(c.alias("spot_id"), (37.0031 + (c * 379) % 4001 / 1000.0).alias("lat"), (-108.9967 + (c * 547) % 7001 / 1000.0).alias("lng"))


SPOTS = "spots AS (SELECT c_custkey AS spot_id, 37.0031e0 + ((c_custkey*379)%4001)/1000e0 AS lat, -108.9967e0 + ((c_custkey*547)%7001)/1000e0 AS lng FROM customer)"


def places(spark: SparkSession, d: str) -> DataFrame:
    """A point for each supplier, away from the polygons' edges."""
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(s.cast("string").alias("site_id"), (37.013 + (s * 37) % 400 / 100.0).alias("lat"), (-108.987 + (s * 53) % 700 / 100.0).alias("lng"), F.when(s % 3 == 0, "KNOWN").alias("country"), F.when(s % 5 != 0, 1500.0 + F.col("s_acctbal") / 10.0).alias("elevation"), s.alias("key"))


PLACES = """places AS (SELECT CAST(s_suppkey AS VARCHAR) AS site_id, 37.013e0 + ((s_suppkey*37)%400)/100e0 AS lat, -108.987e0 + ((s_suppkey*53)%700)/100e0 AS lng,
  CASE WHEN s_suppkey%3=0 THEN 'KNOWN' END AS country, CASE WHEN s_suppkey%5<>0 THEN 1500e0 + s_acctbal/10e0 END AS elevation, s_suppkey AS key FROM supplier)"""


#: Lines of a task, about.
LINES = 1 << 20


def line_tasks(spark: SparkSession, d: str) -> int:
    """Tasks for a step over all lines: the session's, or as many more as keep a task's memory the same however many lines there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem", ["l_orderkey"]).count() // LINES))


def lines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    item = table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_returnflag", "l_linenumber"])
    n = line_tasks(spark, d)
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        o, item = o.repartition(n, "o_orderkey"), item.repartition(n, "l_orderkey")
    return item.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "denied")
    return lines(spark, d).where(F.col("l_returnflag") != "R").select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("site_id"), F.col("o_orderkey").alias("activity_id"), F.col("o_orderdate").alias("ts"), status.alias("status"))


def manual(spark: SparkSession, d: str) -> DataFrame:
    activity = F.when(F.col("l_linenumber") % 2 != 0, F.col("o_orderkey"))
    return lines(spark, d).where(F.col("l_returnflag") == "R").select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("site_id"), activity.alias("activity_id"), F.col("o_orderdate").alias("ts"))


def activities(spark: SparkSession, d: str) -> DataFrame:
    """Each user's latest activity."""
    return table(spark, d, "orders", ["o_orderkey", "o_custkey"]).groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderkey").alias("activity_id"))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("site_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("elevation"), F.col("p_brand").alias("state"), F.col("p_type").alias("country"))


LEDGER = """ledger AS (SELECT o_custkey AS user_id, l_partkey AS site_id, o_orderkey AS activity_id, o_orderdate AS ts, CASE WHEN l_returnflag='A' THEN 'denied' END AS status
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_returnflag<>'R'),
manual AS (SELECT o_custkey AS user_id, l_partkey AS site_id, CASE WHEN l_linenumber%2<>0 THEN o_orderkey END AS activity_id, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_returnflag='R'),
seen AS (SELECT user_id, site_id, activity_id, ts FROM ledger WHERE coalesce(status,'auto_confirmed')<>'denied' UNION ALL SELECT user_id, site_id, activity_id, ts FROM manual),
activities AS (SELECT o_custkey AS user_id, max(o_orderkey) AS activity_id FROM orders GROUP BY 1),
peaks AS (SELECT p_partkey AS site_id, p_name AS name, p_retailprice AS elevation, p_brand AS state, p_type AS country FROM part)"""


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits close in time, one for each event: times a thousandth of the events'."""
    e = F.col("event_id")
    ts = F.timestamp_micros(F.floor(micros("ts") / 1000)).cast("timestamp_ntz")
    return table(spark, d, "events").select(e.alias("visit_id"), F.col("user_id").alias("activity_id"), (e % 5).alias("site_id"), ts.alias("ts"), (e % 11 == 0).alias("photos"), F.when(e % 7 == 0, "user_confirmed").alias("status"), F.when(e % 3 == 0, F.col("event_type")).alias("notes"))


VISITS = """visits AS (SELECT event_id AS visit_id, user_id AS activity_id, event_id%5 AS site_id, make_timestamp(epoch_us(ts)//1000) AS ts, event_id%11=0 AS photos,
  CASE WHEN event_id%7=0 THEN 'user_confirmed' END AS status, CASE WHEN event_id%3=0 THEN event_type END AS notes FROM events)"""


def queue(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("user_id"), F.when(F.col("event_type") == "signup", 1).otherwise(100).alias("priority"), F.col("ts").alias("created"), F.when(e % 3 == 0, F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("started"), F.when(e % 4 == 0, F.col("ts")).alias("completed"), (e % 7).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"), F.col("props").alias("json_data"))


QUEUE = """queue AS (SELECT event_id AS id, event_type AS action, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type='signup' THEN 1 ELSE 100 END AS priority, ts AS created,
  CASE WHEN event_id%3=0 THEN ts + INTERVAL 1 HOUR END AS started, CASE WHEN event_id%4=0 THEN ts END AS completed, CAST(event_id%7 AS INTEGER) AS attempts, props AS json_data FROM events),
clock AS (SELECT max(ts) AS now FROM events)"""


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 cells for each vector."""
    rows = table(spark, d, "embeddings", ["vec_id", "embedding"]).select(F.col("vec_id").alias("tile_id"), F.posexplode("embedding").alias("i", "elev"))
    return rows.select("tile_id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), F.round(F.col("elev").cast("double") * 100, 6).alias("elev"))


TILES = """tiles AS (SELECT vec_id AS tile_id, CAST((i-1)//8 AS INTEGER) AS row, CAST((i-1)%8 AS INTEGER) AS col, round(CAST(e AS DOUBLE)*100, 6) AS elev
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def latest(spark: SparkSession, d: str):
    """The events' last time, as the present."""
    return table(spark, d, "events", ["ts"]).agg(F.max("ts")).first()[0]
