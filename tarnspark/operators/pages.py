"""Sites from landed web pages: list pages, detail pages, tables of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def listed(pages: DataFrame, host: str, allow: str, deny: tuple[str, ...] = ()) -> DataFrame:
    """url, from_page of the detail pages that list pages (page_id, url, html) link to and a crawl may follow, each once."""
    out = pages.where(~F.coalesce(text.blocked_page("html"), F.lit(False))).select("page_id", "url", F.explode(text.links("html")).alias("_href"))
    out = out.select("page_id", text.absolute_url("url", F.col("_href")).alias("url")).withColumn("url", F.regexp_replace("url", "#.*$", ""))
    return out.where(text.followed("url", host, allow, deny)).groupBy("url").agg(F.min("page_id").alias("from_page"))


def details(pages: DataFrame) -> DataFrame:
    """page_id, name, lat, lng, elevation (m), county, blocked of detail pages: a place from a map link, else from the text."""
    body = text.strip_tags("html")
    places = F.transform(text.links("html"), lambda u: F.struct(*[c.alias(n) for n, c in zip(("lat", "lng"), text.coords_from_url(u), strict=True)]))
    linked = F.get(F.filter(places, lambda p: text.plausible(p["lat"], p["lng"])), F.lit(0))
    lat, lng = text.coords_from_text(F.col("_body"))
    rows = pages.withColumn("_body", body).withColumn("_linked", linked)
    blocked = F.coalesce(text.blocked_page("html"), F.lit(False))
    rows = rows.select("page_id", F.when(~blocked, text.heading("html")).alias("name"), F.coalesce("_linked.lat", lat).alias("lat"), F.coalesce("_linked.lng", lng).alias("lng"), text.feet_in("_body").alias("elevation"), F.coalesce(text.labelled_cell("html", "County"), text.labelled_cell("html", "Second Level Region")).alias("county"), blocked.alias("blocked"))
    return rows


def rank_rows(pages: DataFrame, cells: int = 6) -> DataFrame:
    """page_id, name, overall_rank, rank, elevation (m), area of each table row with so many cells and a number in the fourth."""
    rows = pages.select("page_id", F.posexplode(text.table_rows("html")).alias("place", "row")).where(F.size("row") >= cells)
    whole = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(F.get("row", F.lit(k)), r"^([\d,]+)", 1), ",", ""), F.lit("")).try_cast("int")
    out = rows.select("page_id", "place", F.get("row", F.lit(0)).alias("name"), whole(2).alias("overall_rank"), whole(3).alias("rank"), (whole(4) * 0.3048).alias("elevation"), F.get("row", F.lit(5)).alias("area"))
    return out.where(F.col("rank").isNotNull())
