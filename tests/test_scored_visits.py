"""Scored visits of a stream equal the batch's."""

import random

import pytest
from pyspark.sql import functions as F

from tarnspark.operators import visits
from tarnspark.streaming import scored_visits

from .test_visits import CASES, HIGH, POINT, SITE

STREAMED = POINT + ", ts timestamp, has_alt boolean"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def rounded(found):
    return sorted((r.track_id, r.site_id, r.visit, r.mode, r.lat, r.lng, r.elevation, r.idx, r.t, round(r.min_dist, 6), r.samples, round(r.seconds, 6), round(r.confidence, 9), r["class"], r.needs_confirmation) for r in found.collect())


def run(spark, parts, sites, folder, known=None):
    """Each part is a trigger of a query of its own that goes on from the checkpoint."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(STREAMED).parquet(f"{folder}/in")
        found = scored_visits.visits(scored_visits.near_rows(stream, sites), 1800.0, known=known)
        query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None, i
    return spark.read.parquet(f"{folder}/out")


def streamed(spark, rows):
    has = {r[0] for r in rows if r[5] is not None}
    frame = spark.createDataFrame([(*r, r[0] in has) for r in rows], POINT + ", has_alt boolean")
    return frame.withColumn("ts", F.timestamp_millis(F.floor((F.col("t") + 1_700_000_000) * 1000))).select(*[c.split()[0] for c in STREAMED.split(", ")])


def tracks(seed):
    rng, rows = random.Random(seed), []
    for k in range(12):
        t = 0.0
        for i in range(150):
            t += rng.choice([1, 20, 90, 200, 500])
            off = rng.choice([0.0, 0.0003, 0.0008, 0.0012, 0.0014, 0.003, 0.003])
            rows.append((str(k), i, t, 40.0 + off * rng.random(), -105.0 - off, None if k % 3 == 0 or rng.random() < 0.2 else 4290.0 + rng.random() * 20))
    for name, (xy, alt, _, times, _) in CASES.items():
        rows += [(name, i, float(times[i] if times else 30 * i), lat, -105.0 - off, float(alt[i]) if alt else None) for i, (off, lat) in enumerate(xy)]
    return rows


#: A point long after all others; event time passes them by it.
LAST = ("zz", 0, 1e6, 10.0, 10.0, None)


def test_stream_with_restarts_equals_the_batch(rocks, tmp_path, monkeypatch):
    monkeypatch.setattr(scored_visits, "ALTITUDES", 3)
    rows = tracks(3)
    sites = rocks.createDataFrame([*HIGH, ("bare", 40.0005, -105.0005, None)], SITE)
    at = [0, 9_000, 18_000, 1e9]
    parts = [streamed(rocks, [r for r in rows if a <= r[2] < b] + ([LAST] if b == 1e9 else [])) for a, b in zip(at, at[1:], strict=False)]
    # whether a track has altitudes is known from its start
    has = {r[0] for r in rows if r[5] is not None}
    parts = [p.withColumn("has_alt", F.col("track_id").isin(has)) for p in parts]
    want = rounded(visits.detect_visits(rocks.createDataFrame(rows, POINT), sites))
    got = rounded(run(rocks, [*parts, streamed(rocks, [(*LAST[:2], 2e6, *LAST[3:])])], sites, str(tmp_path)))
    assert len(want) > 40 and got == want


def test_stream_goes_on_behind_the_batch(rocks, tmp_path):
    there = [(0.0, 0.0), (30.0, 0.0001), (60.0, 0.0), (300.0, 0.01), (330.0, 0.011)]
    rows = [("a", i + 5 * k, t + 400 * k, 40.0 + off, -105.0, 4300.0) for k in range(4) for i, (t, off) in enumerate(there)]
    sites = rocks.createDataFrame(HIGH[:1], SITE)
    early, later = [r for r in rows if r[1] < 10], [r for r in rows if r[1] >= 10]
    known = scored_visits.handed_over(streamed(rocks, early), sites)
    assert [tuple(r) for r in known.collect()] == [("a", "p1", 4, 460.0)]
    got = rounded(run(rocks, [streamed(rocks, later), streamed(rocks, [LAST]), streamed(rocks, [(*LAST[:2], 2e6, *LAST[3:])])], sites, str(tmp_path), known))
    whole = rounded(visits.detect_visits(rocks.createDataFrame(rows, POINT), sites))
    assert got == [r for r in whole if r[7] >= 10] and len(got) == 2
