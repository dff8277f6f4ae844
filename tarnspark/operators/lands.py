"""Imports of public lands and of administrative boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import sound_rings, vertex_count
from ..functions.text import property_of

#: Designations that are taken whatever their size; others have to be this large.
DESIGNATIONS = ("NP", "NM", "NF", "NG", "NWR", "WILD", "WSA", "NRA", "NCA", "SP", "SF", "SW", "SRA")
LEAST_ACRES, ACRE_SQ_M = 1000.0, 4046.86


def acres_of(acres: Column, area_sq_m: Column) -> Column:
    """The stated acres, else those of the area; 0 counts as missing."""
    return F.coalesce(F.nullif(acres, F.lit(0.0)), F.nullif(area_sq_m, F.lit(0.0)) / ACRE_SQ_M)


def designated(designation: Column, acres: Column) -> Column:
    return F.coalesce(designation.isin(*DESIGNATIONS), F.lit(False)) | F.coalesce(acres >= LEAST_ACRES, F.lit(False))


def public_lands(features: DataFrame) -> DataFrame:
    """Features (properties map, rings) as lands: those with a sound geometry that are designated or large, texts cleaned."""
    p = lambda *names: property_of("properties", *names)
    rows = features.where(sound_rings("rings")).select(
        p("Unit_Nm", "Own_Name").alias("name"), p("Des_Tp", "Desig_Tp").alias("designation"), p("Loc_Ds", "Loc_Nm").alias("designation_name"), p("Mang_Type", "Own_Type").alias("manager_type"),
        p("Mang_Name", "Own_Name").alias("manager_name"), p("Pub_Access", "Access").alias("access"), acres_of(p("GIS_Acres").try_cast("double"), p("Shape_Area").try_cast("double")).alias("acres"), p("State_Nm").alias("state"), "rings",
    )
    return rows.where(designated(F.col("designation"), F.col("acres")))


def boundaries(features: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Features as boundaries with the named columns, each from the first property that it lists; those without any name go."""
    rows = features.where(sound_rings("rings")).select(*[property_of("properties", *of).alias(c) for c, of in names.items()], "rings")
    return rows.dropna(how="all", subset=list(names))


def by_designation(lands: DataFrame, n: int = 15) -> DataFrame:
    """The n commonest designations."""
    return lands.groupBy("designation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("designation")).limit(n)


def heaviest(lands: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The n geometries with the most corners, and the most of all, for a look at what slows joins."""
    rows = lands.select(key, vertex_count("rings").alias("vertices"))
    top = rows.agg(F.max("vertices").alias("most"))
    return rows.orderBy(F.desc("vertices"), key).limit(n).crossJoin(F.broadcast(top))


def busiest(tags: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Sites with several tags, the busiest first."""
    return tags.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), key).limit(n)
