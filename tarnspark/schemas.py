"""Schemas of the logical tables, as DDL, and how a frame is brought into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


POINTS = "track_id string, idx int, t double, lat double, lng double, alt double"
SITES = "site_id string, name string, lat double, lng double, elevation double, state string, country string"
VISITS = "track_id string, site_id string, lat double, lng double, elevation double, idx int, confidence double, needs_confirmation boolean"
LEDGER = "visit_id string, user_id string, activity_id string, site_id string, ts timestamp_ntz, is_public boolean, confidence double, needs_confirmation boolean, status string, notes string"
QUEUE = "id long, action string, user_id string, priority int, created timestamp_ntz, started timestamp_ntz, completed timestamp_ntz, attempts int, error string, json_data string, is_webhook boolean"
RATE_LIMITS = "id int, short_term_limit int, daily_limit int, short_term_usage int, daily_usage int"
EVENT = "aspect_type string, event_time long, object_id long, object_type string, owner_id long, subscription_id long, updates struct<title:string,type:string,private:string,authorized:string>"
MESSAGE = "id long, action string, created string, started string, completed string, json_data string, is_webhook boolean"
STREAMS = "latlng struct<data:array<array<double>>>, time struct<data:array<double>>, altitude struct<data:array<double>>, distance struct<data:array<double>>"
ACTIVITY = "id long, name string, description string, sport_type string, type string, start_date string, start_date_local string, timezone string, utc_offset double, start_latlng array<double>, distance double, elapsed_time long, total_elevation_gain double, private boolean, map struct<polyline:string,summary_polyline:string>"
EXTERNAL = "ext_id string, name string, lat double, lng double, elevation double, source string, source_url string"
POLYGONS = "poly_id string, name string, code string, rings array<array<struct<lng:double,lat:double>>>"
RASTER = "tile_id string, row int, col int, elev double"
GEONAMES = "geonames array<struct<geonameId:long,name:string,lat:string,lng:string,elevation:int,adminCode1:string,countryCode:string,fcode:string>>"
FEATURES = "id string, properties map<string,string>, geometry struct<type:string,coordinates:array<double>>"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order and types; a column that is absent is null. Names match in any case."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])
