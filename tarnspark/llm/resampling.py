"""Importance resampling towards a target's distribution of hashed n-grams. DataFrame functions only.

Every place of a text gives an array of the one to three words that begin there; the arrays are exploded and each n-gram
becomes a bucket by crc32 modulo BUCKETS. Buckets are counted in the documents and in the target, the two counts make
a table of gains with at most BUCKETS rows, which is broadcast and joined to the exploded n-grams again, and the
gains are summed by document. Counts and sums are made on the map side first, so what is shuffled is a row for each
bucket and task, and a few numbers for each document: no text and no n-gram ever moves. The n-grams are made twice; kept
between the passes they would take more disk than the texts.

A draw adds a document's own noise (Gumbel's distribution, from a hash of its id), so that the highest scores are a weighted
sample without replacement. Scores are sorted by range; a row's rank is its place in its partition and the
rows in the partitions before, of which the driver sees one number each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, shuffle_width
from .license_scan import LOWER

#: What parts words: all of ASCII but letters and digits.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
GRAMS = 3
BUCKETS = 10_000
#: Documents of fewer words aren't drawn; of the others SHARE of a hundred are.
LEAST_WORDS, SHARE = 20, 5
SEED = "42:"
#: Scored rows of a range, about; rows that one row of copies becomes at a time.
RANGE, COPIES = 1_000_000, 10_000


def words(text: Column) -> Column:
    """The words of a text. Separators become blanks and A to Z small letters in one pass, nothing else changes."""
    plain = F.translate(F.coalesce(text, F.lit("")), LOWER.upper() + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def grams(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``place``, ``size``, ``bucket`` of each n-gram: the word it begins at (from 0), its words but one, its bucket.

    A text without words gives one row with nulls in place and bucket and 0 in size.
    """
    found, run, gram = fresh(texts, "words", "run", "gram")
    rows = texts.select(*keep, words(F.col(text)).alias(found))
    # each word with those behind it; an array has nulls behind its end
    follow = F.arrays_zip(*[F.slice(found, k + 1, (1 << 31) - 1).alias(f"w{k}") for k in range(GRAMS)])
    rows = rows.select(*keep, F.posexplode_outer(follow).alias("place", run))
    joined = [F.col(f"{run}.w0")]
    for k in range(1, GRAMS):
        joined.append(F.concat(joined[-1], F.lit(" "), F.col(f"{run}.w{k}")))
    rows = rows.select(*keep, "place", F.posexplode(F.array(*joined)).alias("size", gram))
    rows = rows.where(F.col(gram).isNotNull() | F.col("place").isNull() & (F.col("size") == 0))
    return rows.select(*keep, "place", "size", F.pmod(F.crc32(F.col(gram).cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket"))


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """bucket, n: how many n-grams of all texts fall into each bucket that occurs; BUCKETS rows at most."""
    return grams(texts.select(text), text, []).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain of the buckets that occur in docs: the log ratio of smoothed frequencies, target to docs, in thousandths."""
    own, wanted = (cut(bucket_counts(x)) for x in (docs, target))
    total = lambda df: float(df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    all_own, all_wanted = F.lit(total(own) + BUCKETS), F.lit(total(wanted) + BUCKETS)
    pairs = own.join(F.broadcast(wanted.select("bucket", F.col("n").alias("t"))), "bucket", "left")
    s, t = F.col("n").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    return pairs.select("bucket", F.floor(1000 * F.log((t + 1) * all_own / ((s + 1) * all_wanted))).cast("long").alias("gain"))


def noise(doc_id: Column) -> Column:
    """A document's own draw from Gumbel's distribution, in thousandths."""
    digits = F.sha2(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, _text (its hash), copies, n_words, n_features, weight: a row for each different text of each doc_id."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    first = F.coalesce((F.col("place") == 0) & (F.col("size") == 0), F.lit(True))
    found = grams(rows, "text", ["doc_id", "_text"]).join(F.broadcast(gains(docs, target)), "bucket", "left")
    sums = found.groupBy("doc_id", "_text").agg(F.count_if(first).alias("copies"), F.count_if((F.col("size") == 0) & F.col("place").isNotNull()).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    each = [(F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("n_words", "n_features")]
    return sums.select("doc_id", "_text", "copies", *each, F.expr("weight div copies").alias("weight"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with ``rank``, from 1 in the order given, from one distributed sort and the sizes of its partitions."""
    place, part, before = fresh(rows, "place", "part", "before")
    spark = rows.sparkSession
    width = max(shuffle_width(spark), math.ceil(rows.count() / RANGE))
    # a row's id is its partition's number, in the bits from 33 on, and its place in the partition
    sort = cut(rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))
    sort = sort.withColumn(part, F.shiftright(place, 33))
    sizes = sorted((r[part], r["count"]) for r in sort.groupBy(part).count().collect())
    begins = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    table = spark.createDataFrame(begins, f"{part} long, {before} long")
    return sort.join(F.broadcast(table), part).withColumn("rank", F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(place, part, before)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null if it isn't drawn.

    docs: doc_id, text; target: text. A null or empty text and one without words has no features and weight 0. A null doc_id
    is kept, hashed as no digits and ranked behind others of its score; rows that repeat count and are ranked each on its own.
    Without a target all gains are those of a target without words; an empty table gives an empty result. Other columns are
    ignored.
    """
    each = cut(weights(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    # one row for each copy, a block of copies at a time
    each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("_from"))
    each = each.select("*", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("copies")) - 1)).alias("_copy"))
    able = F.col("n_words") >= least_words
    drawn = each.where(able).count() * share // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_text"), F.asc("_copy")]
    result = ["doc_id", "n_features", "weight", "score"]
    in_order = ranked(each.where(able).select(*result, "_text", "_copy"), order)
    rest = each.where(~able).select(*result, F.lit(None).cast("long").alias("rank"))
    return in_order.select(*result, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(rest)
