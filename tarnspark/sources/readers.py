"""Sources: typed readers of landed files."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.times import time_zone


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, schema: str, keep_bad: bool = False) -> DataFrame:
    """One JSON document on a line. Bad lines are dropped, or kept with their text in ``_corrupt_record``."""
    if keep_bad:
        return spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE")
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def webhook_events(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Event bodies as queue rows: priority 1, marked as webhooks. A body may be an object or a text that holds one."""
    reader = spark.readStream if streaming else spark.read
    body = reader.format("text").load(path).select(F.when(F.startswith("value", F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"]).otherwise(F.col("value")).alias("json_data"))
    event = F.from_json("json_data", schemas.EVENT)
    return body.select(event["aspect_type"].alias("action"), event["owner_id"].cast("string").alias("user_id"), "json_data", F.lit(1).alias("priority"), F.lit(True).alias("is_webhook"), F.timestamp_seconds(event["event_time"]).cast("timestamp_ntz").alias("created"))


def activities(spark: SparkSession, path: str) -> DataFrame:
    """Landed activity documents as rows: activity_id, title, sport, started_at, offset_seconds, time_zone, is_public, start point."""
    rows = json_lines(spark, path, schemas.ACTIVITY)
    began = F.to_timestamp("start_date").cast("timestamp_ntz")
    return rows.select(F.col("id").alias("activity_id"), F.col("name").alias("title"), F.coalesce("sport_type", "type").alias("sport"), began.alias("started_at"), F.col("utc_offset").cast("long").alias("offset_seconds"), time_zone("timezone").alias("time_zone"), (~F.coalesce("private", F.lit(False))).alias("is_public"), F.get("start_latlng", F.lit(0)).alias("lat"), F.get("start_latlng", F.lit(1)).alias("lng"), "description")


def geonames(spark: SparkSession, path: str) -> DataFrame:
    """Named places of a landed lookup: site_id, name, lat, lng, elevation, state, country."""
    g = spark.read.schema(schemas.GEONAMES).json(path, multiLine=True).select(F.inline("geonames"))
    return g.select(F.col("geonameId").cast("string").alias("site_id"), "name", F.col("lat").try_cast("double").alias("lat"), F.col("lng").try_cast("double").alias("lng"), F.col("elevation").cast("double").alias("elevation"), F.col("adminCode1").alias("state"), F.col("countryCode").alias("country"))


def either_stream(column: str | Column) -> Column:
    """A stream's numbers, written as a bare array or as an object with ``data``."""
    return F.coalesce(F.from_json(column, "array<double>"), F.from_json(column, "data array<double>")["data"])


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    collection = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>>>"
    rows = spark.read.schema(collection).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select(F.col("f.id").alias("id"), F.col("f.properties").alias("properties"), F.get("f.geometry.coordinates", F.lit(0)).alias("lng"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def osm_sites(features: DataFrame) -> DataFrame:
    """Features as sites: the English name first, the id without its letter, the elevation a text begins with; without a name or a place they go."""
    from ..functions.text import leading_number

    p = lambda k: F.nullif(F.try_element_at("properties", F.lit(k)), F.lit(""))
    rows = features.select(F.substring("id", 2, 1 << 20).alias("site_id"), F.coalesce(p("name:en"), p("int_name"), p("name")).alias("name"), "lat", "lng", leading_number(p("ele")).alias("elevation"))
    return rows.dropna(subset=["site_id", "name", "lat", "lng"])


def points_of_streams(rows: DataFrame, key: str) -> DataFrame:
    """Stream bundles (latlng, time, altitude) as points; a missing time is the index, a missing altitude null."""
    n = F.sequence(F.lit(0), F.size("latlng.data") - 1)
    point = F.transform(F.when(F.size("latlng.data") > 0, n), lambda i: F.struct(i.alias("idx"), F.coalesce(F.get("time.data", i), i.cast("double")).alias("t"), F.get(F.get("latlng.data", i), F.lit(0)).alias("lat"), F.get(F.get("latlng.data", i), F.lit(1)).alias("lng"), F.get("altitude.data", i).alias("alt")))
    return rows.select(F.col(key).cast("string").alias("track_id"), F.inline(point))


def elevations(rows: DataFrame, column: str = "value") -> DataFrame:
    """Looked-up elevations of a service that says -1000000 where it has none."""
    v = F.col(column).cast("double")
    return rows.withColumn(column, F.when(v != -1000000, v))


def global_elevations(rows: DataFrame, column: str = "value") -> DataFrame:
    """Looked-up elevations of a service for which all below -1000 m are none."""
    v = F.col(column).cast("double")
    return rows.withColumn(column, F.when(v >= -1000, v))


def lookup_batches(points: DataFrame, key: str, size: int = 100) -> DataFrame:
    """Points (lat, lng) as requests of ``size`` places at most, with a number that a rerun repeats: batch, ids, locations.

    Places are dealt by a hash and numbered within their part, so no task sees all of them.
    """
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    rows = points.select(key, "lat", "lng", part.alias("part")).withColumn("n", F.floor((F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1) / size))
    listed = F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), F.concat_ws(",", "lat", "lng").alias("at"))))
    out = rows.groupBy("part", "n").agg(listed.alias("_l"))
    return out.select(F.concat_ws("-", "part", "n").alias("batch"), F.transform("_l", lambda x: x["id"]).alias("ids"), F.array_join(F.transform("_l", lambda x: x["at"]), "|").alias("locations"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths and sizes of files of a folder and those below it; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


#: What an archive's layers may be, the best first.
LAYERS = (".gdb", ".zip", ".shp")


def archive_members(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """path, member, size of the files inside archives, read where the archives are."""

    def listed(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["path", "member", "size"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "content").mapInPandas(listed, "path string, member string, size long")


def best_layer(paths: DataFrame, column: str = "path") -> DataFrame:
    """folder, path: of each folder's layers the best kind, and of that the first by name."""
    p = F.lower(F.regexp_replace(column, "/+$", ""))
    kind = F.coalesce(*[F.when(p.endswith(k), F.lit(i)) for i, k in enumerate(LAYERS)])
    rows = paths.select(F.regexp_extract(column, "^(.*)/[^/]+/?$", 1).alias("folder"), F.col(column).alias("path"), kind.alias("kind")).where(F.col("kind").isNotNull())
    return rows.groupBy("folder").agg(F.min(F.struct("kind", "path")).alias("_b")).select("folder", F.col("_b.path").alias("path"))


def layer(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, most: int | None = None) -> DataFrame:
    """A landed layer; columns and conditions reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    df = df.select(*columns) if columns else df
    return df.limit(most) if most else df


def has_columns(df: DataFrame, *names: str) -> dict[str, bool]:
    have = {c.lower() for c in df.columns}
    return {n: n.lower() in have for n in names}


def known_tables(spark: SparkSession, *names: str) -> dict[str, bool]:
    return {n: spark.catalog.tableExists(n) for n in names}


def jdbc_parts(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table read in ``parts`` ranges of a numeric key at once, for a copy."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), fetchsize="10000", **options).load()


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def synthetic_tracks(spark: SparkSession, tracks: int, points: int = 2000, seed: int = 1) -> DataFrame:
    """Circling tracks with noise, by a seed."""
    rows = spark.range(tracks * points).select(F.floor(F.col("id") / points).cast("string").alias("track_id"), (F.col("id") % points).cast("int").alias("idx"))
    noise = lambda k: (F.pmod(F.xxhash64("track_id", "idx", F.lit(seed * 2 + k)), F.lit(1001)) / 1000.0 - 0.5) * 0.0005
    return rows.select("track_id", "idx", F.col("idx").cast("double").alias("t"), (40 + F.sin(F.col("idx") / 1000.0) * 0.01 + noise(0)).alias("lat"), (-105 + F.cos(F.col("idx") / 1000.0) * 0.01 + noise(1)).alias("lng"), F.lit(None).cast("double").alias("alt"))


def synthetic_sites(spark: SparkSession, n: int = 50) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(i.cast("string").alias("site_id"), (40 + F.sin(i) * 0.02).alias("lat"), (-105 + F.cos(i) * 0.02).alias("lng"), (4000.0 + i).alias("elevation"))
