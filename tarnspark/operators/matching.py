"""Matching an external list of sites to the catalogue: best matches, and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import name_words, word_similarity
from ..session import cut
from .cells import first_of_places, places, within_distance


@dataclass(frozen=True)
class MatchOptions:
    """Thresholds of an import. Values are those of the most detailed source."""

    radius_m: float = 2000.0
    candidates: int = 25
    least_score: float = 0.35
    accept_score: float = 0.75
    accept_distance_m: float = 150.0
    accept_name: float = 0.7
    accept_margin: float = 0.12


def options_of(settings: Mapping[str, str], prefix: str) -> MatchOptions:
    """The options of one import, from settings such as ``<prefix>radius_m``; what isn't set, or is empty, keeps its default.

    A setting of the prefix that is no option, or no number, is an error.
    """
    own = {k[len(prefix) :]: v for k, v in settings.items() if k.startswith(prefix)}
    known = {f.name: type(f.default) for f in fields(MatchOptions)}
    if unknown := own.keys() - known.keys():
        raise ValueError(f"no options: {', '.join(sorted(unknown))}")
    return MatchOptions(**{k: known[k](v) for k, v in own.items() if v not in (None, "")})


def imported(external: DataFrame, catalogue: DataFrame, presets: Mapping[str, MatchOptions], linked: DataFrame | None = None) -> DataFrame:
    """``match_one_to_one`` of each source's own sites (external has ``source``) by its own options; sources without options are left out."""
    each = [match_one_to_one(external.where(F.col("source") == name).drop("source"), catalogue, linked, options).withColumn("source", F.lit(name)) for name, options in presets.items()]
    return reduce(DataFrame.unionByName, each)


def candidates(external: DataFrame, catalogue: DataFrame, radius: float, most: int) -> DataFrame:
    """external (ext_id, name, lat, lng, elevation) x catalogue (site_id, ...) within the radius, nearest first, scored."""
    ext = external.select("ext_id", "lat", "lng", F.col("elevation").alias("ext_elevation"), name_words("name").alias("_ext"))
    site = catalogue.select("site_id", F.col("elevation").alias("site_elevation"), name_words("name").alias("_site"))
    met = within_distance(ext, places(catalogue, most), radius).drop("r_lat", "r_lng")
    found = first_of_places(met, "ext_id", "distance_m", most, "cand_rank").join(site, "site_id")
    found = found.withColumn("name_similarity", word_similarity(F.col("_ext"), F.col("_site")))
    elevation = scores.match_elevation(F.col("ext_elevation"), F.col("site_elevation"))
    return found.withColumn("score", scores.match_score(F.col("name_similarity"), F.col("distance_m"), radius, elevation)).drop("_ext", "_site", "lat", "lng")


def best_match(external: DataFrame, catalogue: DataFrame, radius: float = 500.0, most: int = 10) -> DataFrame:
    """ext_id, site_id, distance_m, name_similarity, score, confidence of every external site; nulls where none matches."""
    ranked = Window.partitionBy("ext_id").orderBy(F.desc("score"), "distance_m", "site_id")
    best = candidates(external, catalogue, radius, most).where(F.col("score") > 0).withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") == 1)
    out = external.select("ext_id").join(best.select("ext_id", "site_id", "distance_m", "name_similarity", "score"), "ext_id", "left")
    return out.withColumn("confidence", scores.match_level(F.col("name_similarity"), F.col("distance_m")))


def greedy_pairs(edges: DataFrame, left: str = "ext_id", right: str = "site_id", order: list | None = None) -> DataFrame:
    """The edges that a greedy pass in the order of score would keep, each end used once.

    With a total order that pass equals taking, round by round, the edges that come first for both of their
    ends. Edges are written to the checkpoint folder after each round, so lineage doesn't grow.
    """
    order = order or [F.desc("score"), F.asc(left), F.asc(right)]
    taken, left_over = None, cut(edges)
    while not left_over.isEmpty():
        a, b = Window.partitionBy(left).orderBy(*order), Window.partitionBy(right).orderBy(*order)
        ranked = left_over.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b))
        now = cut(ranked.where((F.col("_a") == 1) & (F.col("_b") == 1)).drop("_a", "_b"))
        taken = now if taken is None else taken.unionByName(now)
        left_over = cut(left_over.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti").select(*edges.columns))
    return edges.limit(0) if taken is None else taken


def match_one_to_one(external: DataFrame, catalogue: DataFrame, linked: DataFrame | None = None, options: MatchOptions = MatchOptions()) -> DataFrame:
    """ext_id, outcome (high, review, unmatched, skipped), site_id, distance_m, name_similarity, score, second_score.

    linked: ext_id of sites that the catalogue has already; they are skipped.
    """
    open_ = external if linked is None else external.join(linked.select("ext_id").distinct(), "ext_id", "left_anti")
    found = candidates(open_, catalogue, options.radius_m, options.candidates)
    ranked = Window.partitionBy("ext_id").orderBy(F.desc("score"), "cand_rank")
    best = found.withColumn("_n", F.row_number().over(ranked)).groupBy("ext_id").agg(F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("best_score"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("second_score"))
    pairs = greedy_pairs(found.where(F.col("score") >= options.least_score), order=[F.desc("score"), F.asc("ext_id"), F.asc("cand_rank")])
    out = external.select("ext_id").join(pairs.select("ext_id", "site_id", "distance_m", "name_similarity", "score"), "ext_id", "left").join(best, "ext_id", "left")
    margin = F.col("best_score") - F.col("second_score")
    sure = (F.col("score") >= options.accept_score) & (F.col("distance_m") <= options.accept_distance_m) & (F.col("name_similarity") >= options.accept_name) & (margin.isNull() | (margin >= options.accept_margin))
    outcome = F.when(F.col("site_id").isNull(), "unmatched").when(sure, "high").otherwise("review")
    if linked is not None:
        out = out.join(linked.select("ext_id").distinct().withColumn("_linked", F.lit(True)), "ext_id", "left")
        outcome = F.when(F.col("_linked"), "skipped").otherwise(outcome)
    return out.select("ext_id", outcome.alias("outcome"), "site_id", "distance_m", "name_similarity", "score", "second_score")
