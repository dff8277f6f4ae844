"""Ranges are dealt out once and read once."""

import pytest
from pyspark.sql import functions as F

from tarnspark.operators import batches, ml, ranges


def test_each_row_is_read_once_over_a_run_that_breaks_off(spark, tmp_path):
    path, seen, calls = str(tmp_path / "work"), [], []
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit("x").alias("v")).unionByName(spark.createDataFrame([(None, "null")], "k long, v string"))

    def work(part):
        calls.append(len(part.inputFiles()))
        got = [r.k for r in part.select("k").collect()]
        if len(calls) == 4:
            raise RuntimeError("stopped")
        seen.append(got)
        return len(got), 0

    with pytest.raises(RuntimeError):
        ranges.run(rows, "k", path, 9, work, keep=True)
    assert len(seen) == 3 and ranges.not_done(spark, path).count() == 6
    before = sum(map(len, seen))
    assert ranges.run(rows.where("false"), "k", path, 9, work, keep=True) == 6  # what was dealt is taken up, not the table
    every = [k for part in seen for k in part]
    assert len(every) == 5001 and before + sum(map(len, seen[3:])) == 5001 and set(every) == {None, *range(5000)}
    # ranges follow each other
    spans = [(min(p), max(p)) for p in ([k for k in part if k is not None] for part in seen)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    total = batches.totals(batches.load_progress(spark, f"{path}/done"), 5001).first()
    assert total.processed == 5001 and total.percent == 100.0
    assert ranges.run(rows, "k", path, 9, work) == 0
    assert not (tmp_path / "work").exists()


def test_bounds_and_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("c", 4)], "k string, v int")
    bounds = ranges.deal(rows, "k", str(tmp_path / "a"), 2).collect()
    assert sum(r["rows"] for r in bounds) == 4 and min(r["first"] for r in bounds) == "a" and max(r["last"] for r in bounds) == "c"
    assert ranges.run(rows.limit(0), "k", str(tmp_path / "b"), 3, lambda part: (part.count(), 0)) == 0


def test_importances_find_the_feature_that_tells(spark):
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.col("id") % 7 / 100).alias("tells"), (F.col("id") * 7919 % 101).cast("double").alias("noise"), F.lit(1.0).alias("flat"))
    found = ml.importances(ml.fit_forest(rows, ["noise", "tells", "flat"], trees=5), ["noise", "tells", "flat"]).collect()
    assert sum(r.importance for r in found) == pytest.approx(1.0) and found[0].feature == "tells" and found[0].importance > 0.9 and {r.feature: r.importance for r in found}["flat"] == 0
