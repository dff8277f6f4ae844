"""Mixing sources to target weights. DataFrame functions only.

Documents fall into blocks by a hash of doc_id. A source's quota of words is drawn as whole passes over
its blocks and, for what is left, as a run of blocks in permuted order; only the last block of the run is
entered document by document, in permuted order too. How many of each source's drawn blocks an output
shard gets comes from a splitting tree: at every node the blocks are divided into halves, and the number
of each source's blocks in the left half is drawn without replacement, so the counts are multivariate
hypergeometric and add up exactly. Each shard then takes its own run of a source's permuted draws and
can be shuffled by itself. All random numbers are hashes, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, REPEAT = 1.5, 2
#: 2**LEVELS output shards at least; more if the mix has more words than that many shards should hold.
LEVELS, SHARD_WORDS = 3, 1 << 27
#: Parts of a shard that are shuffled by themselves.
PARTS = 64
#: Documents of a block, on average, until there are MOST_BLOCKS of them in each source.
BLOCK, MOST_BLOCKS = 1024, 1 << 16
SEED = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, source_size -> source, source_size, nth, weight, target. One row for each source.

    Weights follow the sources in code point order, null last. Resharing the excess until no target is
    above its cap comes to one level: every target is the lesser of its cap and weight x level. A source of
    size 0 has target 0. Other columns are ignored; an empty table gives an empty result.
    """
    everything = Window.orderBy(F.asc_nulls_last("source"))
    rows = sizes.withColumn("nth", F.row_number().over(everything) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("_cap", F.col("source_size") * float(repeat)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    rising = Window.orderBy("_ratio", "nth")
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    all_words = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("_level", (all_words * float(share) - before) / onward)
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("target", F.least("_cap", F.coalesce(level * F.col("weight"), F.col("_cap"))))
    return rows.select("source", "source_size", "nth", "weight", "target")


def _uniform(*parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), F.lit(1 << 40)) / float(1 << 40)


def split(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """nth, n (drawn blocks of a source) -> shard, nth, n, with each source's n divided among 2**levels shards.

    A source has some thousand blocks whatever its size, so the root's draws are bounded; deeper nodes are drawn side by side.
    A source without blocks gets none; an empty table gives an empty result. Other columns are ignored.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("nth").cast("long").alias("nth"), F.col("n").cast("long").alias("n")))).alias("counts")).select(F.lit(1).cast("long").alias("node"), "counts")
    for level in range(levels):
        if level and level % 3 == 0:
            nodes = cut(nodes.repartition("node"))
        whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"])
        start = F.struct(whole.alias("all"), F.floor(whole / 2).alias("room"), F.array().cast("array<bigint>").alias("left"))

        def draw(a: Column, c: Column) -> Column:
            blocks = F.filter(F.sequence(F.lit(0).cast("long"), c["n"]), lambda j: j > 0)
            return F.aggregate(
                blocks,
                F.struct(a["all"].alias("all"), a["room"].alias("room"), a["left"].alias("left"), F.lit(0).cast("long").alias("n")),
                lambda b, j: F.struct(
                    (b["all"] - 1).alias("all"),
                    (b["room"] - F.when(_uniform(seed, F.col("node"), c["nth"], j) * b["all"] < b["room"], 1).otherwise(0)).alias("room"),
                    b["left"].alias("left"),
                    (b["n"] + F.when(_uniform(seed, F.col("node"), c["nth"], j) * b["all"] < b["room"], 1).otherwise(0)).alias("n"),
                ),
                lambda b: F.struct(b["all"].alias("all"), b["room"].alias("room"), F.concat(b["left"], F.array(b["n"])).alias("left")),
            )

        drawn = nodes.withColumn("left", F.aggregate("counts", start, draw, lambda a: a["left"]))
        side = lambda n: F.zip_with("counts", "left", lambda c, k: F.struct(c["nth"].alias("nth"), n(c["n"], k).alias("n")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), side(lambda n, k: k).alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), side(lambda n, k: n - k).alias("counts")))
        nodes = drawn.select(F.explode(halves).alias("_h")).select("_h.node", "_h.counts")
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.inline("counts")).where(F.col("n") > 0)


def mix(docs: DataFrame, levels: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shards of every document.

    ``taken`` counts the words that the mix takes of the document, repeats included: whole passes times
    its size, and of one document of each source a part. ``shards`` names the output shard of each draw, as
    many as it is drawn. A null text has size 0 and nothing is taken of it; a null source is a source of
    its own; rows without a doc_id fall into blocks by their text; repeated rows count as documents; an empty table gives an empty
    result. Other columns are ignored. Sources are taken to be few enough for one row to list them.
    """
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0))
    size = F.when(F.col("text").isNull(), 0).otherwise(size).cast("long")
    place = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), "doc_id")).otherwise(F.xxhash64(F.lit(seed), "text"))
    rows = cut(docs.select("doc_id", "source", size.alias("size"), place.alias("block")))
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks_each = max(1, min(MOST_BLOCKS, -(-n // BLOCK)))
    levels = max(LEVELS, math.ceil(math.log2(max(1, SHARE * words / SHARD_WORDS)))) if levels is None else levels
    rows = rows.withColumn("_own", F.col("block")).withColumn("block", F.pmod("block", F.lit(blocks_each)))
    blocks = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    sources = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    quota = F.round("target").cast("long")
    sources = cut(sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", quota - F.col("passes") * F.col("source_size")))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block")
    drawn = blocks.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    drawn = drawn.withColumn("place", F.row_number().over(permuted)).withColumn("_before", F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    drawn = drawn.withColumn("extra", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("_before"))))
    drawn = cut(drawn.withColumn("draws", F.col("passes") + (F.col("extra") > 0).cast("long")).drop("_before"))

    # which shard each draw of a block goes to: a shard's draws of a source follow those of the shards before it
    shares = split(drawn.groupBy("nth").agg(F.sum("draws").alias("n")), levels, seed)
    up_to = F.sum("n").over(Window.partitionBy("nth").orderBy("shard"))
    slots = shares.withColumn("_up_to", up_to).select("shard", "nth", F.explode(F.sequence(F.col("_up_to") - F.col("n") + 1, "_up_to")).alias("turn"))
    turns = drawn.where(F.col("draws") > 0).select("source", "nth", "block", "place", F.explode(F.sequence(F.lit(1).cast("long"), "draws")).alias("epoch"))
    turns = turns.withColumn("turn", F.row_number().over(Window.partitionBy("nth").orderBy("epoch", "place")).cast("long"))
    dealt = turns.join(slots, ["nth", "turn"]).groupBy("nth", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"]).alias("shards"))
    plan = drawn.join(dealt, ["nth", "block"], "left").select(F.col("source").alias("_source"), F.col("block").alias("_block"), "source_size", "target", "passes", "words", "extra", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))

    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 2), "_own"), "doc_id", "size")
    reached = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_before", reached).join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    last = F.greatest(F.lit(0), F.least("size", F.col("extra") - F.col("_before")))
    placed = placed.withColumn("_last", last).withColumn("taken", F.col("passes") * F.col("size") + F.col("_last"))
    times = F.col("passes") + (F.col("_last") > 0).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", F.slice("shards", F.lit(1), times.cast("int")).alias("shards"))


def apply(docs: DataFrame, levels: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents of the mix, all their columns, each as often as it is drawn; shuffled within parts of a shard.

    Only the last document that a source's quota reaches is drawn in part: a draw of less than half of its words is left out,
    any other takes all of it, so a source's words are within one document of its target. Rows without doc_id stay once each,
    and so do documents of no words, which add none; repeated rows of a doc_id are drawn like its largest one. Columns keep
    their values; an empty table stays empty.
    """
    taken, key, draws, shards, turn, shard, at = fresh(docs, "taken", "key", "draws", "shards", "turn", "shard", "at")
    plan = mix(docs, levels, seed).where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(key)).agg(F.max(F.struct("size", "taken", "shards")).alias(taken))
    times = F.when(F.col(f"{taken}.size") > 0, F.round(F.col(f"{taken}.taken") / F.col(f"{taken}.size"))).otherwise(F.lit(1)).cast("int")
    plan = plan.select(key, times.alias(draws), F.col(f"{taken}.shards").alias(shards))
    found = docs.join(plan, docs["doc_id"] == F.col(key), "left").withColumn(draws, F.coalesce(draws, F.lit(1)))
    turns = F.when(F.col(draws) > 0, F.sequence(F.lit(1), F.col(draws)))
    rows = found.withColumn(turn, F.explode(turns)).withColumn(shard, F.coalesce(F.get(shards, F.col(turn) - 1), F.lit(0)))
    rows = rows.withColumn(at, F.xxhash64(F.lit(seed + 3), "doc_id", turn))
    return rows.repartition(F.col(shard), F.pmod(at, F.lit(PARTS))).sortWithinPartitions(shard, at).select(*docs.columns)
