"""The catalogue of sites: geocoding, tagging with lands, provenance, ingestion, collections, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import ring_area, spheroid_distance
from ..functions.text import percent, state_of
from .cover import in_polygons
from .ledger import insert_ignore


def geocode(sites: DataFrame, polygons: DataFrame, column: str, where: Column | None = None, batch: int | None = None) -> DataFrame:
    """sites with ``column`` filled from the polygon around them where it is null; of several the smallest, then by code.

    ``where`` restricts the sites that may be filled. With ``batch`` only so many of them are, the first by id.
    """
    area = F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda s, a: s + a)
    open_ = sites.where(F.col(column).isNull() & F.col("lat").isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))).select("site_id", "lat", "lng")
    open_ = open_.orderBy("site_id").limit(batch) if batch else open_
    found = in_polygons(open_, polygons.withColumn("_area", area)).groupBy("site_id").agg(F.min(F.struct("_area", "code")).alias("_p"))
    joined = sites.join(found, "site_id", "left")
    return joined.withColumn(column, F.coalesce(column, "_p.code")).drop("_p").select(*sites.columns)


def state_code(code: Column, postal: Column, name: Column) -> Column:
    """The part behind the hyphen of a code, else the postal code, the code or the name."""
    return F.when(code.like("%-%"), F.split_part(code, F.lit("-"), F.lit(2))).otherwise(F.coalesce(postal, code, name))


#: How the country whose counties are known is written.
COUNTIES_IN = ("US", "United States", "USA")


def geocode_levels(sites: DataFrame, countries: DataFrame, states: DataFrame, counties: DataFrame, batch: int | None = None) -> DataFrame:
    """sites with country, state and county filled in this order where they are null.

    countries: rings, code. states: rings, iso, postal, name. counties: rings, longer, name; they are looked up for sites of one
    country only, by what the first step found.
    """
    out = geocode(sites, countries, "country", batch=batch)
    out = geocode(out, states.withColumn("code", state_code(F.col("iso"), F.col("postal"), F.col("name"))), "state", batch=batch)
    return geocode(out, counties.withColumn("code", F.coalesce("longer", "name")), "county", F.col("country").isin(*COUNTIES_IN), batch)


def attempted(sites: DataFrame, found: DataFrame, column: str, now: Column) -> DataFrame:
    """sites after a lookup (site_id, value): a value fills what is missing, and what was asked for in vain is marked as failed.

    The marks are ``<column>_failed`` and ``<column>_tried_at``; sites that weren't asked for keep theirs.
    """
    joined = sites.join(found.select("site_id", F.col("value").alias("_value"), F.lit(True).alias("_asked")), "site_id", "left")
    marks = {f"{column}_failed": (F.col("_value").isNull(), "boolean"), f"{column}_tried_at": (now, "timestamp_ntz")}
    old = lambda c, kind: F.col(c) if c in sites.columns else F.lit(None).cast(kind)
    out = joined.withColumns({c: F.when(F.col("_asked"), new).otherwise(old(c, kind)) for c, (new, kind) in marks.items()})
    return out.withColumn(column, F.coalesce(column, F.col("_value"))).drop("_value", "_asked")


def tag_lands(sites: DataFrame, lands: DataFrame, tagged: DataFrame) -> DataFrame:
    """(site_id, poly_id) of sites that have no tag yet and the lands around them."""
    fresh = sites.join(tagged.select("site_id").distinct(), "site_id", "left_anti")
    return in_polygons(fresh.select("site_id", "lat", "lng"), lands).select("site_id", "poly_id").distinct()


def provenance(site_id: Column, known: Column) -> Column:
    """Where a site comes from, by its id, if it isn't known."""
    return F.coalesce(known, F.when(site_id.rlike("^[0-9]+$"), "osm").when(site_id.rlike("^pq[0-9]+$"), "manual").otherwise("unknown"))


def new_site_id(source: Column, ext_id: Column) -> Column:
    """A deterministic id, so a rerun makes no second site."""
    return F.concat(F.lit("x"), F.substring(F.sha2(F.concat_ws(":", source, ext_id), 256), 1, 24))


def linked_values(catalogue: DataFrame, links: DataFrame, external: DataFrame, coordinates: bool = False, seeds: bool = False, elevation: bool = False, label: str = "external") -> DataFrame:
    """catalogue with what a linked source (site_id, source, ext_id; ext_id, lat, lng, elevation) may overwrite by policy.

    New primary coordinates also become the seed's and put a site's lands in doubt; an elevation has to be above 0.
    """
    own = links.join(external.select("ext_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("elevation").alias("_height")), "ext_id")
    joined = catalogue.join(own.groupBy("site_id").agg(F.min(F.struct("ext_id", "_lat", "_lng", "_height")).alias("_x")), "site_id", "left")
    have, height = F.col("_x").isNotNull() & F.lit(coordinates), F.col("_x._height")
    seeded, higher = F.col("_x").isNotNull() & F.lit(coordinates or seeds), F.coalesce(height > 0, F.lit(False)) & F.lit(elevation)
    new = {"lat": (have, F.col("_x._lat")), "lng": (have, F.col("_x._lng")), "seed_lat": (seeded, F.col("_x._lat")), "seed_lng": (seeded, F.col("_x._lng")), "elevation": (higher, height), "elevation_source": (higher, F.lit(label)), "lands_checked": (have, F.lit(False))}
    return joined.select(*[F.when(new[c][0], new[c][1]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in catalogue.columns])


def without_tags(tags: DataFrame, moved: DataFrame) -> DataFrame:
    """The lands' tags without those of sites that moved; they have to be found anew."""
    return tags.join(moved.select("site_id").distinct(), "site_id", "left_anti").select(*tags.columns)


#: How sure a match has to be to enter a collection.
INCLUDED = ("high", "medium")


def collection_matches(matches: DataFrame, levels: tuple[str, ...] = INCLUDED, create: bool = True) -> DataFrame:
    """matches (name, lat, lng, site_id, confidence, create_new) with ``use``: matched, created or left_out.

    A row marked create_new never takes its match. Without coordinates (or with zeros) nothing can be created.
    """
    anew = F.coalesce("create_new", F.lit(False))
    matched = ~anew & F.col("site_id").isNotNull() & (F.col("confidence") != "none") & F.col("confidence").isin(*levels)
    placed = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0)
    created = ((F.col("confidence") == "none") | anew) & placed & F.lit(create)
    return matches.withColumn("use", F.when(matched, "matched").when(created, "created").otherwise("left_out"))


def load_collection(catalogue: DataFrame, members: DataFrame, collection: int | str, matches: DataFrame, region: str, levels: tuple[str, ...] = INCLUDED, move: bool = False) -> tuple[DataFrame, DataFrame]:
    """The catalogue and the members after a reviewed list has been loaded as one collection.

    Both are new versions, so a writer that moves its pointers when both are there loads all or nothing. Sites to create
    get ids that depend on the region and the name, and the region's state; with ``move`` matched sites take the list's
    coordinates, and its elevation if it has one.
    """
    used = collection_matches(matches, levels).where(F.col("use") != "left_out")
    used = used.withColumn("site_id", F.when(F.col("use") == "matched", F.col("site_id")).otherwise(new_site_id(F.lit(region), F.col("name"))))
    fresh = used.where(F.col("use") == "created").withColumn("state", state_of(F.lit(region)))
    rows = fresh.select(*[F.col(c).cast(catalogue.schema[c].dataType) if c in fresh.columns else F.lit(None).cast(catalogue.schema[c].dataType).alias(c) for c in catalogue.columns])
    out = catalogue
    if move:
        own = used.where(F.col("use") == "matched").groupBy("site_id").agg(F.min(F.struct("name", "lat", "lng", "elevation")).alias("_m"))
        joined = catalogue.join(own.where(F.col("_m.lat").isNotNull() & F.col("_m.lng").isNotNull()), "site_id", "left")
        out = joined.select(*[F.coalesce(F.nullif(F.col(f"_m.{c}"), F.lit(0.0)), F.col(c)).alias(c) if c in ("lat", "lng", "elevation") else F.col(c) for c in catalogue.columns])
    return insert_ignore(out, rows, [["site_id"]]), replace_members(members, collection, used)


def review_file(matches: DataFrame) -> DataFrame:
    """What a reviewer gets of a collection's matches, the unsure ones first; similarity in percent."""
    level = F.when(F.col("confidence") == "none", 0).when(F.col("confidence") == "low", 1).when(F.col("confidence") == "medium", 2).otherwise(3)
    rows = matches.select("name", "lat", "lng", "elevation", "site_id", "distance_m", F.round(F.col("name_similarity") * 100).cast("int").alias("similarity"), "confidence", (F.col("confidence") != "none").alias("include"), F.lit(False).alias("create_new"))
    return rows.orderBy(level, "name")


def review_counts(matches: DataFrame) -> DataFrame:
    """Matches by how sure they are, and their share."""
    of = lambda k: F.count_if(F.col("confidence") == k).alias(k)
    out = matches.agg(F.count("*").alias("total"), *map(of, ("high", "medium", "low", "none")))
    return out.withColumn("matched_percent", percent(F.col("total") - F.col("none"), "total"))


def ingest(catalogue: DataFrame, links: DataFrame, external: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue and its links (site_id, source, ext_id) after a reviewed import.

    decisions: ext_id, site_id, approved. Approved ones are linked, rejected ones become new sites, pending ones wait.
    External sites without an id can't be kept track of and are left out.
    """
    known = external.where(F.col("ext_id").isNotNull()).join(decisions.select("ext_id", F.col("site_id").alias("_site"), "approved"), "ext_id")
    linked = known.where("approved").select(F.col("_site").alias("site_id"), "source", "ext_id")
    fresh = known.where(~F.col("approved")).join(links.select("source", "ext_id"), ["source", "ext_id"], "left_anti").withColumn("site_id", new_site_id(F.col("source"), F.col("ext_id")))
    rows = fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(catalogue.schema[c].dataType).alias(c) for c in catalogue.columns])
    more = linked.unionByName(fresh.select("site_id", "source", "ext_id"))
    return insert_ignore(catalogue, rows, [["site_id"]]), insert_ignore(links, more, [["site_id", "source"], ["source", "ext_id"]])


def replace_members(members: DataFrame, collection: int | str, rows: DataFrame) -> DataFrame:
    """members with a collection's rows replaced as a whole."""
    return members.where(F.col("collection_id") != collection).unionByName(rows.select(F.lit(collection).cast(members.schema["collection_id"].dataType).alias("collection_id"), "site_id").distinct())


def review_page(sites: DataFrame, page: int, size: int) -> DataFrame:
    """A page of sites to review, the highest first, with the number of all."""
    waiting = sites.where("needs_review")
    total = waiting.agg(F.count("*").alias("total"))
    return waiting.orderBy(F.desc_nulls_last("elevation"), "site_id").offset(page * size).limit(size).crossJoin(F.broadcast(total))


def review_metrics(elevation: Column, snapped: Column, metres: Column) -> tuple[Column, Column]:
    """Change of elevation, and the band of the distance moved."""
    return snapped - elevation, F.when(metres < 20, "near").when(metres < 50, "moved").otherwise("far")


def accept(sites: DataFrame, decisions: DataFrame) -> DataFrame:
    """sites after review (site_id, action accept, reject or custom, lat, lng): only accepted and custom ones move."""
    joined = sites.join(decisions.select("site_id", "action", F.col("lat").alias("_lat"), F.col("lng").alias("_lng")), "site_id", "left")
    custom, moved = F.col("action") == "custom", F.col("action").isin("accept", "custom")
    lat, lng = F.when(custom, F.col("_lat")).otherwise(F.col("snapped_lat")), F.when(custom, F.col("_lng")).otherwise(F.col("snapped_lng"))
    keep = lambda new, old: F.when(F.coalesce(moved, F.lit(False)), new).otherwise(F.col(old))
    out = joined.withColumn("_d", keep(spheroid_distance("lat", "lng", lat, lng), "snapped_distance_m"))
    out = out.withColumn("_new_lat", keep(F.coalesce(lat, F.col("lat")), "lat")).withColumn("_new_lng", keep(F.coalesce(lng, F.col("lng")), "lng"))
    out = out.withColumn("needs_review", F.when(F.col("action").isNotNull(), F.lit(False)).otherwise(F.col("needs_review")))
    out = out.withColumn("elevation", keep(F.coalesce("snapped_elevation", "elevation"), "elevation"))
    return out.withColumn("lat", F.col("_new_lat")).withColumn("lng", F.col("_new_lng")).withColumn("snapped_distance_m", F.col("_d")).select(*sites.columns)


def repeated_coordinates(sites: DataFrame, share: float = 0.3, least: int = 10) -> DataFrame:
    """n, most (sites at the commonest place) and whether a scrape looks broken: a place with too large a share."""
    place = F.format_string("%.5f,%.5f", "lat", "lng")
    counts = sites.groupBy(place.alias("place")).agg(F.count("*").alias("k"))
    return counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.max("k"), F.lit(0)).alias("most")).withColumn("suspicious", (F.col("n") >= least) & (F.col("most") >= share * F.col("n")))


def fallback(primary: DataFrame, secondary: DataFrame, key: str, value: str) -> DataFrame:
    """primary with missing values taken from secondary, and where each comes from."""
    joined = primary.join(secondary.select(key, F.col(value).alias("_second")), key, "left")
    source = F.when(F.col(value).isNotNull(), "primary").when(F.col("_second").isNotNull(), "secondary").otherwise("failed")
    return joined.withColumn("origin", source).withColumn(value, F.coalesce(value, "_second")).drop("_second")


def hourly_weather(visits: DataFrame, weather: DataFrame) -> DataFrame:
    """visits (site_id, ts) with the value of their hour from weather (site_id, day, hourly array); past its end the last."""
    day = visits.withColumn("day", F.to_date("ts"))
    hour = F.least(F.hour("ts"), F.size("hourly") - 1)
    return day.join(weather, ["site_id", "day"], "left").withColumn("value", F.get("hourly", hour)).drop("hourly")


def latest_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") == 1).drop("_n")
