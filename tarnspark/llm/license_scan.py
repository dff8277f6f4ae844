"""Licence scan: ordered signature rules, keyword prefilter, containment suppression. DataFrame functions only.

Every document is reduced to its words, joined by two blanks, so that a rule's pattern takes the blank
on either side of each of its words and matches may stand next to each other. A document without any
rule's keyword is done after one test of each distinct keyword; of the others only the rules whose own
keyword occurs are tried. All of it is one projection: no shuffle, and no row leaves its task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import Rule, rules

#: ASCII letters of either case, digits and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def pattern(rule: Rule) -> str:
    """A rule's pattern over a normalised text: every word between single blanks of its own."""
    written = rule.pattern.replace(" ", "  ").replace(".{", "(?:.{")
    written = re.sub(r"\(\?:\.(\{\d+,\d+\})", r"(?:.\1)", written)
    written = re.sub(r"\((?!\?)", "(?:", written)
    # an optional blank, written "x ?y", is two blanks or none
    return " (?:" + written.replace("  ?", "(?:  )?") + ") "


def _lower_ascii(s: Column) -> Column:
    """A to Z in lower case as far as rules can tell. lower() is much faster than translate(), and apart from A to Z only the
    Kelvin sign and the dotted capital I become ASCII letters by it."""
    odd = F.contains(s, F.lit("\u212a")) | F.contains(s, F.lit("\u0130"))
    return F.when(odd, F.translate(s, LOWER.upper(), LOWER)).otherwise(F.lower(s))


def _rules_column(found: list[Rule]) -> Column:
    rows = [F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(pattern(r)).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.lit(r.base).alias("base"), F.lit(i).alias("nth")) for i, r in enumerate(found)]
    return F.array(*rows)


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _starts(norm: Column, rule: Column) -> Column:
    """Spans of a rule's matches: the number of the first and of the last word."""
    between = F.split(norm, rule["pattern"], -1)
    matched = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    sizes = F.transform(matched, lambda m, i: F.struct(_blanks(F.get(between, i)).alias("gap"), _blanks(m).alias("own")))
    # blanks in front of match i: those of the gaps up to i and of the matches before it
    empty = F.array().cast("array<struct<first:int,last:int>>")
    walk = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["own"]).alias("at"),
            F.concat(a["spans"], F.array(F.struct(((a["at"] + x["gap"]) / 2).cast("int").alias("first"), ((a["at"] + x["gap"] + x["own"]) / 2 - 1).cast("int").alias("last")))).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return walk


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    A detection is suppressed when one of a higher priority, or an earlier one of the same, covers all its
    words; base detections stay. ``score`` is the largest weight of a detection that stays. A null or empty
    text has 0 words, no detections, empty label strings, score 0 and null positions. Repeated rows stay
    repeated, other columns are ignored, an empty table gives an empty result.
    """
    found = rules() if table is None else table
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    joined_words = F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))
    normal = words.select("doc_id", F.size("_words").cast("long").alias("n_words"), joined_words.alias("_norm")).withColumn("_norm", _lower_ascii(F.col("_norm")))
    keywords = sorted({r.keyword for r in found})
    # the longer keywords that contain a shorter one add nothing to the first test
    least = [k for k in keywords if not any(o != k and o in k for o in keywords)]
    any_keyword = F.lit(False)
    for k in least:
        any_keyword = any_keyword | F.contains("_norm", F.lit(k))

    tried = F.filter(_rules_column(found), lambda r: F.contains(F.col("_norm"), r["keyword"]))
    spans = F.flatten(
        F.transform(
            tried,
            lambda r: F.transform(_starts(F.col("_norm"), r), lambda s: F.struct(s["first"].alias("first"), (-s["last"]).alias("_last"), (-r["priority"]).alias("_priority"), r["nth"].alias("nth"), s["last"].alias("last"), r["priority"].alias("priority"), r["base"].alias("base"), r["label"].alias("label"), r["weight"].alias("weight"))),
        )
    )
    # in order of the first word, the longest first, an earlier detection covers this one if it ends no sooner
    ordered = F.array_sort(spans)
    nothing = F.array().cast("array<string>")
    top = max([r.priority for r in found], default=0)
    start = F.struct(F.array_repeat(F.lit(-1), top + 1).alias("ends"), nothing.alias("base"), nothing.alias("all"), F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("kept"))

    def step(a: Column, s: Column) -> Column:
        covered = F.exists(F.slice(a["ends"], s["priority"] + 1, F.lit(top + 1)), lambda e: e >= s["last"])
        stays = s["base"] | ~covered
        label = F.array(s["label"])
        return F.struct(
            F.transform(a["ends"], lambda e, i: F.when(i == s["priority"], F.greatest(e, s["last"])).otherwise(e)).alias("ends"),
            F.when(s["base"], F.array_union(a["base"], label)).otherwise(a["base"]).alias("base"),
            F.when(stays, F.array_union(a["all"], label)).otherwise(a["all"]).alias("all"),
            (a["n_base"] + s["base"].cast("long")).alias("n_base"),
            F.when(s["base"], F.least(a["first"], s["first"])).otherwise(a["first"]).alias("first"),
            F.when(s["base"], F.greatest(a["last"], s["first"])).otherwise(a["last"]).alias("last"),
            F.when(stays, F.greatest(a["score"], s["weight"])).otherwise(a["score"]).alias("score"),
            (a["kept"] + stays.cast("long")).alias("kept"),
        )

    result = F.when(any_keyword, F.aggregate(ordered, start, step))
    done = normal.select("doc_id", "n_words", result.alias("_r"))
    joined = lambda name: F.coalesce(F.array_join(F.array_sort(F.col(f"_r.{name}")), ","), F.lit(""))
    return done.select(
        "doc_id",
        "n_words",
        F.coalesce("_r.n_base", F.lit(0).cast("long")).alias("n_base"),
        F.col("_r.first").cast("long").alias("first_word"),
        F.col("_r.last").cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("all").alias("labels"),
        F.coalesce("_r.score", F.lit(0.0)).alias("score"),
        F.coalesce("_r.kept", F.lit(0).cast("long")).alias("n_detections"),
    )
