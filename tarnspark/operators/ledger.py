"""Changes to tables as new versions of them, and duplicate visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import iso, micros
from ..session import cut


def _on(keys: list[str], left: str = "l", right: str = "r") -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys))


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], update: list[str] | None = None, preserve: bool = False) -> DataFrame:
    """target after changes: rows with a known key are updated in ``update`` (all other columns if None), others are added.

    With ``preserve`` a null in the changes keeps the old value. Keys have to be unique in the changes.
    """
    update = [c for c in target.columns if c not in keys] if update is None else update
    old, new = target.withColumn("_old", F.lit(True)).alias("l"), changes.withColumn("_new", F.lit(True)).alias("r")
    joined = old.join(new, _on(keys), "full_outer")

    def value(c: str) -> Column:
        mine, theirs = F.col(f"l.{c}"), F.col(f"r.{c}") if c in changes.columns else F.lit(None)
        if c in keys:
            return F.coalesce(mine, theirs)
        changed = F.coalesce(theirs, mine) if preserve else theirs
        if c not in update or c not in changes.columns:
            return F.when(F.col("l._old"), mine).otherwise(theirs)
        return F.when(F.col("r._new"), changed).otherwise(mine)

    return joined.select(*[value(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, rows: DataFrame, unique: list[list[str]]) -> DataFrame:
    """target with the rows that agree with it, and with each other, on none of the unique keys."""
    fresh = rows.select(*target.columns)
    for keys in unique:
        fresh = fresh.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns)
    for keys in unique:
        fresh = fresh.dropDuplicates(keys)
    return target.unionByName(fresh)


def update_where(target: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return target.select(*[F.when(condition, values[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in values else F.col(c) for c in target.columns])


def delete(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), keys, "left_anti").select(*target.columns)


def delete_cascade(tables: dict[str, tuple[DataFrame, list[str]]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows whose column (the one given for the gone table's key) is among the gone ids."""
    ids = gone.toDF("_gone").distinct()
    return {name: df.join(ids, F.col(keys[0]) == F.col("_gone"), "left_anti") for name, (df, keys) in tables.items()}


def returning(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), keys, "left_semi")


def visit_id(activity: Column, site: Column, ts: Column) -> Column:
    return F.concat_ws("-", activity, site, iso(ts))


def _in_slots(left: DataFrame, right: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with a slot of time, as l and r, and the condition that two rows are no more than ``seconds`` apart.

    A row of the right side stands in its slot and in the two beside it, so a busy key is cut along time.
    """
    limit = max(1, int(seconds * 1e6))
    slot = F.floor(micros("ts") / limit)
    a, b = left.withColumn("_slot", slot).alias("l"), right.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1))).alias("r")
    return a, b, (F.col("l._slot") == F.col("r._slot")) & (F.abs(micros("l.ts") - micros("r.ts")) <= int(seconds * 1e6))


def duplicate_pairs(visits: DataFrame, seconds: float = 300) -> DataFrame:
    """Pairs (id1 < id2) of one activity and site no more than ``seconds`` apart."""
    rows = visits.select("visit_id", "activity_id", "site_id", "ts")
    a, b, near = _in_slots(rows, rows, seconds)
    joined = a.join(b, _on(["activity_id", "site_id"]) & near & (F.col("l.visit_id") < F.col("r.visit_id")))
    return joined.select(F.col("l.visit_id").alias("id1"), F.col("r.visit_id").alias("id2"), F.col("l.activity_id").alias("activity_id"), F.col("l.site_id").alias("site_id"))


def _next_starts(times: DataFrame, limit: int) -> DataFrame:
    """times (_k, _us, _slot) with ``_jump``: the first time more than ``limit`` behind, null behind the last.

    Slots are as wide as the limit, so it lies in the next slot, or is the first time of the first slot after that which has any.
    """
    slots = times.groupBy("_k", "_slot").agg(F.min("_us").alias("_first"))
    by_slot = Window.partitionBy("_k").orderBy("_slot")
    after = F.when(F.lead("_slot").over(by_slot) == F.col("_slot") + 1, F.lead("_first", 2).over(by_slot)).otherwise(F.lead("_first").over(by_slot))
    slots = slots.select("_k", "_slot", after.alias("_after"))
    # what is asked of a slot stands in front of equal times of it, as only later ones count
    asked = times.select("_k", (F.col("_slot") + 1).alias("_slot"), (F.col("_us") + limit).alias("_at"), F.lit(0).alias("_kind"))
    there = times.select("_k", "_slot", F.col("_us").alias("_at"), F.lit(1).alias("_kind"))
    down = Window.partitionBy("_k", "_slot").orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, -1)
    met = asked.unionByName(there).withColumn("_next", F.last(F.when(F.col("_kind") == 1, F.col("_at")), ignorenulls=True).over(down)).where("_kind = 0")
    near = met.select("_k", (F.col("_slot") - 1).alias("_slot"), (F.col("_at") - limit).alias("_us"), "_next")
    return near.join(slots, ["_k", "_slot"]).select("_k", "_us", F.coalesce("_next", "_after").alias("_jump"))


#: Distinct times of a key that may be folded as one array.
FOLD = 5000


def window_starts(times: DataFrame, limit: int) -> DataFrame:
    """(_k, _us) of the times that start a window: a key's first, and from each start the first more than ``limit`` behind it.

    times: _k, _us, _slot, each once. Keys of up to FOLD times are folded, each as one array; of others the starts
    are found by doubling.
    """
    sizes = times.groupBy("_k").agg(F.count("*").alias("_n"))
    sized = cut(times.join(sizes, "_k"))

    def step(starts: Column, us: Column) -> Column:
        return F.when((F.size(starts) == 0) | (us - F.element_at(starts, -1) > limit), F.concat(starts, F.array(us))).otherwise(starts)

    folded = F.aggregate(F.array_sort(F.collect_list("_us")), F.array().cast("array<bigint>"), step)
    few = sized.where(F.col("_n") <= FOLD).groupBy("_k").agg(folded.alias("_starts")).select("_k", F.explode("_starts").alias("_us"))
    many = sized.where(F.col("_n") > FOLD).drop("_n")
    return few if many.isEmpty() else few.unionByName(doubled_starts(many, limit))


def doubled_starts(times: DataFrame, limit: int) -> DataFrame:
    """The same for keys of any size: who is reached in so many jumps reaches as many more in one, so the rounds are the logarithm of
    a key's windows. Jumps that lead nowhere go."""
    jumps = cut(_next_starts(times, limit))
    starts = cut(jumps.groupBy("_k").agg(F.min("_us").alias("_us")))
    while True:
        found = starts.join(jumps, ["_k", "_us"]).where(F.col("_jump").isNotNull()).select("_k", F.col("_jump").alias("_us"))
        more = cut(starts.unionByName(found).distinct())
        if more.count() == starts.count():
            return more
        starts = more
        onward = jumps.select("_k", F.col("_us").alias("_jump"), F.col("_jump").alias("_then"))
        jumps = cut(jumps.where(F.col("_jump").isNotNull()).join(onward, ["_k", "_jump"]).where(F.col("_then").isNotNull()).select("_k", "_us", F.col("_then").alias("_jump")))


def windows_from_first(visits: DataFrame, keys: list[str], seconds: float = 300) -> DataFrame:
    """visits with ``window``: a new window starts at the first row more than ``seconds`` behind its window's start.

    Whatever a key's rows, no task or array gets more of them than those of one slot of time, but for a row for each slot. A row
    without a time has no window; a null key is a key.
    """
    limit = max(1, int(seconds * 1e6))
    us = micros("ts")
    rows = visits.withColumn("_k", F.struct(*keys)).withColumn("_us", us).withColumn("_slot", F.floor(us / limit).cast("long"))
    times = rows.where(F.col("_us").isNotNull()).select("_k", "_us", "_slot").distinct()
    starts = window_starts(times, limit)
    numbered = starts.withColumn("window", F.row_number().over(Window.partitionBy("_k").orderBy("_us")))
    # starts lie more than a slot apart, so a slot has one at most, and a row's is in its own slot or in the one before
    numbered = cut(numbered.select("_k", F.floor(F.col("_us") / limit).cast("long").alias("_slot"), F.col("_us").alias("_start"), "window"))
    before = numbered.select("_k", (F.col("_slot") + 1).alias("_slot"), F.col("window").alias("_earlier"))
    out = rows.join(numbered, ["_k", "_slot"], "left").join(before, ["_k", "_slot"], "left")
    window = F.when(F.col("_start") <= F.col("_us"), F.col("window")).otherwise(F.col("_earlier"))
    return out.select(*visits.columns, window.alias("window"))


def keep_best(visits: DataFrame, keys: list[str], preferences: list[Column], seconds: float = 300) -> DataFrame:
    """visits with ``keep``: one for each window, by the preferences, then the oldest, then the id."""
    windowed = windows_from_first(visits, keys, seconds)
    order = Window.partitionBy(*keys, "window").orderBy(*preferences, F.asc("ts"), F.asc("visit_id"))
    return windowed.withColumn("keep", F.row_number().over(order) == 1)


def not_seen(new: DataFrame, known: DataFrame, keys: list[str], seconds: float = 300) -> DataFrame:
    """Rows of ``new`` without a known row of the same keys within ``seconds``; rows of ``new`` don't suppress each other."""
    a, b, near = _in_slots(new, known.select(*keys, "ts"), seconds)
    return a.join(b, _on(keys) & near, "left_anti").select(*new.columns)


def not_elsewhere(new: DataFrame, known: DataFrame, seconds: float = 300) -> DataFrame:
    """Rows of ``new`` whose user has no visit of the site in another activity, or in none, within ``seconds``."""
    other = F.col("r.activity_id").isNull() | (F.col("r.activity_id") != F.col("l.activity_id"))
    a, b, near = _in_slots(new, known.select("user_id", "activity_id", "site_id", "ts"), seconds)
    return a.join(b, _on(["user_id", "site_id"]) & near & other, "left_anti").select(*new.columns)


def save_visits(ledger: DataFrame, new: DataFrame, manual: DataFrame, seconds: float = 300) -> DataFrame:
    """ledger after new visits (user_id, activity_id, site_id, ts, is_public, confidence, needs_confirmation).

    A visit is dropped if another activity of the user, or a manual entry, has the site within ``seconds``. Others get
    a deterministic id; a known id only has its confidence and its need of confirmation updated.
    """
    columns = ["user_id", "activity_id", "site_id", "ts"]
    known = ledger.select(*columns).unionByName(manual.select(*columns))
    fresh = not_elsewhere(new, known, seconds).withColumn("visit_id", visit_id(F.col("activity_id").cast("string"), F.col("site_id").cast("string"), F.col("ts"))).dropDuplicates(["visit_id"])
    return upsert(ledger, fresh, ["visit_id"], ["confidence", "needs_confirmation"])


def reprocess(ledger: DataFrame, detected: DataFrame, seconds: float = 300) -> DataFrame:
    """ledger with detected visits of its own activities that it lacks; nothing is removed."""
    fresh = not_seen(detected, ledger, ["activity_id", "site_id"], seconds)
    fresh = fresh.withColumn("visit_id", visit_id(F.col("activity_id").cast("string"), F.col("site_id").cast("string"), F.col("ts")))
    return insert_ignore(ledger, fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(ledger.schema[c].dataType).alias(c) for c in ledger.columns]), [["visit_id"]])
