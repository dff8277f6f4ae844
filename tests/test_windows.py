"""Windows that start anew, against a plain pass."""

import random

from pyspark.sql import functions as F

from tarnspark.operators import ledger


def plain(rows, seconds):
    out, start, n = {}, {}, {}
    for visit, key, t in sorted(rows, key=lambda r: (str(r[1]), r[2])):
        if key not in start or t - start[key] > seconds:
            start[key], n[key] = t, n.get(key, 0) + 1
        out[visit] = n[key]
    return out


def test_random_keys(spark, monkeypatch):
    monkeypatch.setattr(ledger, "FOLD", 90)  # some are folded, some doubled
    rng, rows = random.Random(4), []
    for k in [None, *range(12)]:
        t = 0.0
        for _ in range(rng.randint(1, 250)):
            t += rng.choice([0, 0.5, 1, 30, 100, 299, 300, 301, 5000])
            rows.append((len(rows), k, t))
    frame = spark.createDataFrame([*rows, (-1, 3, None)], "visit_id long, k int, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).cast("timestamp_ntz"))
    got = {r.visit_id: r.window for r in ledger.windows_from_first(frame, ["k"]).collect()}
    assert got.pop(-1) is None and got == plain(rows, 300)


def test_one_key_with_a_million_rows_a_second_apart(spark):
    n = 1_000_000
    frame = spark.range(n).select(F.col("id").alias("visit_id"), F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("ts"))
    found = ledger.windows_from_first(frame, ["k"])
    wrong = found.where(F.col("window") != F.floor(F.col("visit_id") / 301) + 1).count()
    assert wrong == 0 and found.count() == n
    # far beyond what is folded as an array
    assert n > 100 * ledger.FOLD
    assert ledger.window_starts(frame.select(F.struct("k").alias("_k"), F.expr("unix_micros(ts::timestamp)").alias("_us"), F.expr("unix_micros(ts::timestamp) div 300000000").alias("_slot")), 300_000_000).count() == -(-n // 301)
