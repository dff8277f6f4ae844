"""A user's progress: history, records, collections, streaks, firsts and the summary text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import js_round
from ..functions.text import plural, thousands


def history(ledger: DataFrame, manual: DataFrame) -> DataFrame:
    """user_id, site_id, activity_id, ts of detected visits that weren't denied and of manual entries."""
    columns = ["user_id", "site_id", "activity_id", "ts"]
    counted = ledger.where(F.coalesce("status", F.lit("auto_confirmed")) != "denied")
    return counted.select(*columns).unionByName(manual.select(*columns))


def visit_counts(seen: DataFrame, tasks: int) -> DataFrame:
    """user_id, n, with_activity, sites: each user's visits, those of an activity, and different sites; pairs of user and site in ``tasks`` parts."""
    dealt = seen.select("user_id", "site_id", F.col("activity_id").isNotNull().alias("_known")).repartition(tasks, "user_id", "site_id")
    pairs = dealt.groupBy("user_id", "site_id").agg(F.count("*").alias("n"), F.count_if("_known").alias("with_activity"))
    return pairs.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("with_activity").alias("with_activity"), F.count("site_id").alias("sites"))


def before(seen: DataFrame, activities: DataFrame) -> DataFrame:
    """(user, activity) of ``activities`` x the user's visits of other activities or of none, a site as often as it was visited."""
    a = activities.select("user_id", F.col("activity_id").alias("current_id"))
    other = F.col("activity_id").isNull() | (F.col("activity_id") != F.col("current_id"))
    return seen.join(a, "user_id").where(other).select("user_id", "current_id", "site_id")


def prior_highest(seen: DataFrame, activities: DataFrame, sites: DataFrame) -> DataFrame:
    known = before(seen, activities).join(sites.where(F.col("elevation").isNotNull()).select("site_id", "elevation"), "site_id")
    return known.groupBy("user_id", "current_id").agg(F.max("elevation").alias("max_elevation"))


def prior_places(seen: DataFrame, activities: DataFrame, sites: DataFrame) -> DataFrame:
    placed = sites.where(F.col("state").isNotNull() | F.col("country").isNotNull()).select("site_id", "state", "country")
    return before(seen, activities).join(placed, "site_id").select("user_id", "current_id", "state", "country").distinct()


def site_stats(seen: DataFrame, activities: DataFrame) -> DataFrame:
    """Lifetime and prior visits of each site that the activity visited."""
    visited = seen.join(activities.select("user_id", "activity_id"), ["user_id", "activity_id"], "left_semi").select("user_id", F.col("activity_id").alias("current_id"), "site_id").distinct()
    both = visited.join(seen, ["user_id", "site_id"])
    prior = F.col("activity_id").isNull() | (F.col("activity_id") != F.col("current_id"))
    return both.groupBy("user_id", "current_id", "site_id").agg(F.count("*").alias("lifetime"), F.count_if(prior).alias("prior"))


def collection_progress(seen: DataFrame, members: DataFrame) -> DataFrame:
    """members (collection_id, site_id) -> for every user with a visit in a collection: total and completed sites."""
    totals = members.groupBy("collection_id").agg(F.count("site_id").alias("total"))
    done = seen.select("user_id", "site_id").distinct().join(members, "site_id").groupBy("user_id", "collection_id").agg(F.count("site_id").alias("completed"))
    return done.join(totals, "collection_id").where(F.col("total") > 0).select("user_id", "collection_id", "total", "completed")


def monthly_streak(seen: DataFrame, now: Column) -> DataFrame:
    """Consecutive months with a visit, back from the latest, which has to be this month or the last."""
    months = seen.select("user_id", F.trunc("ts", "month").alias("month")).distinct()
    latest = Window.partitionBy("user_id").orderBy(F.desc("month"))
    ranked = months.withColumn("_n", F.row_number().over(latest)).withColumn("_last", F.max("month").over(Window.partitionBy("user_id")))
    joined_up = F.months_between("_last", "month").cast("int") == F.col("_n") - 1
    this = F.trunc(now, "month")
    current = F.col("_last") >= F.add_months(this, -1)
    out = ranked.groupBy("user_id").agg(F.first("_last").alias("last_month"), F.count_if(joined_up).alias("_run"))
    current, this = F.col("last_month") >= F.add_months(this, -1), this
    return out.select("user_id", F.when(current, F.col("_run")).otherwise(0).cast("long").alias("streak"), (F.col("last_month") == this).alias("is_active"), "last_month")


def first_places(seen: DataFrame, sites: DataFrame, place: str) -> DataFrame:
    """Each user's first visit in each place."""
    order = Window.partitionBy("user_id", place).orderBy("ts", "activity_id", "site_id")
    known = seen.where(F.col("activity_id").isNotNull()).join(sites.select("site_id", place), "site_id").where(F.col(place).isNotNull())
    return known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def feet(metres: Column) -> Column:
    return js_round(metres * 3.28084).cast("long")


def summary(stats: DataFrame, sites: DataFrame) -> DataFrame:
    """One text for each activity: a line for each site, by site."""
    line = F.concat(F.col("name"), F.lit(" ("), thousands(feet(F.col("elevation"))), F.lit(" ft): "), F.when(F.col("prior") == 0, F.lit("first visit")).otherwise(F.concat(F.col("lifetime").cast("string"), F.lit(" "), plural(F.col("lifetime"), "visit", "visits"))))
    rows = stats.join(sites.select("site_id", "name", "elevation"), "site_id").withColumn("_line", line)
    return rows.groupBy("user_id", "current_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site_id", "_line"))), lambda x: x["_line"]), "\n").alias("summary"))


def first_seen_counts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each key, with ``place``, the key's place in the order in which keys were first seen."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy("_first", key)).cast("long")).drop("_first")
