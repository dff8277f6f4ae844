"""Operators that SQL can't express, sources and sinks, and rules at their edges."""

import json
import struct
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnspark.functions import geo, text, times
from tarnspark.operators import batches, claims, ledger, ml, predicates, raster, updates, visits
from tarnspark.plans import lens
from tarnspark.plans import queries as plans
from tarnspark.sources import readers, sinks
from tarnspark.sources.shapefile import shapefiles

D = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "written, want",
    [
        ("N 37° 39' 37.23\", W 107° 35' 06.63\"", (37.6603417, -107.5851750)),
        ("37° 39' 37.23\" N, 107° 35' 06.63\" W", (37.6603417, -107.5851750)),
        ("36°34'43\"N, 118°17'31\"W", (36.5786111, -118.2919444)),
        ("s 10°, e 20° 30'", (-10.0, 20.5)),
        ("N 91° 0' 0\", W 10° 0' 0\"", (None, None)),
        ("37 39, 107 35", (None, None)),
        (None, (None, None)),
    ],
)
def test_degrees(spark, written, want):
    got = value(spark, F.struct(*text.coords_from_dms(F.lit(written))))
    assert [None if v is None else round(v, 6) for v in got] == [None if v is None else round(v, 6) for v in want]


@pytest.mark.parametrize(
    "written, want",
    [
        ("36.5786°N, 118.2920°W", (36.5786, -118.292)),
        ("36.5786 N 118.2920 W", (36.5786, -118.292)),
        ("36.5786, 118.2920 or 36.5786, -118.2920", (36.5786, -118.292)),
        ("0.1234, 0.1234", (None, None)),
        ("36°34&#039;43&quot;N, 118°17'31\"W", (36.578611, -118.291944)),
        ("", (None, None)),
    ],
)
def test_places_in_text(spark, written, want):
    got = value(spark, F.struct(*text.coords_from_text(F.lit(written))))
    assert [None if v is None else round(v, 6) for v in got] == list(want)


def test_links(spark):
    at = lambda u: tuple(value(spark, F.struct(*text.coords_from_url(F.lit(u)))))
    assert at("https://m.example.com/?lat=1.5&long=-2") == (1.5, -2.0) and at("https://m.example.com/?z=2&M=3.5,-4&lat=1&lon=2") == (3.5, -4.0)
    assert at("https://m.example.com/?q=abc&ll=5,6") == (5.0, 6.0) and at("no link") == (None, None)


def test_updates_take_typed_fields_only(spark):
    body = lambda **u: json.dumps({"aspect_type": "update", "object_id": 4, "updates": u})
    rows = [(1, datetime(2024, 1, 1), body(title="a", private=True)), (2, datetime(2024, 1, 2), body(title=7, type="Run")), (3, datetime(2024, 1, 3), body(private="false")), (4, datetime(2024, 1, 4), "no json"), (5, datetime(2024, 1, 5), None)]
    got = updates.patches(spark.createDataFrame(rows, "id long, created timestamp_ntz, json_data string")).collect()
    assert [tuple(r) for r in got] == [(4, "a", "Run", True)]


def test_options(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "a int, b string")
    ids = lambda **o: sorted(r.a for r in predicates.chosen(df, o).collect())
    assert ids(b__not_in=["x"]) == [3] and ids(b__missing_or_not="x") == [1, 3] and ids(b__null=True) == [1] and ids(a__most=2, b=None) == [1, 2]
    with pytest.raises(ValueError):
        predicates.chosen(df, {"a": None})
    assert predicates.chosen(df, {}, need_one=False).count() == 3


def test_windows_start_anew_behind_a_gap(spark):
    seconds = [0, 200, 400, 500, 700, 701, 1100, 1101, 5000]
    rows = [(i, 1, datetime(2024, 1, 1) + timedelta(seconds=s)) for i, s in enumerate(seconds)] + [(99, 2, datetime(2024, 1, 1))]
    got = {r.visit_id: r.window for r in ledger.windows_from_first(spark.createDataFrame(rows, "visit_id long, k int, ts timestamp_ntz"), ["k"]).collect()}
    assert [got[i] for i in range(9)] == plain_windows(seconds) and got[99] == 1


def plain_windows(seconds, limit=300):
    start, n, out = None, 0, []
    for s in seconds:
        if start is None or s - start > limit:
            start, n = s, n + 1
        out.append(n)
    return out


def test_claims_in_rounds_equal_one_pass(spark):
    rng = np.random.default_rng(3)
    seeds = pd.DataFrame({"seed_id": [f"s{i}" for i in range(60)], "elevation": [None if i % 7 == 0 else float(rng.integers(5)) for i in range(60)]})
    rows = [(s, e, r, 40 + float(rng.random()) * 0.002, -105 + float(rng.random()) * 0.002) for s, e in zip(seeds.seed_id, seeds.elevation, strict=True) for r in (1, 2, 3)]
    df = spark.createDataFrame([(s, None if e is None or np.isnan(e) else e, r, a, b) for s, e, r, a, b in rows], "seed_id string, elevation double, rank int, lat double, lng double")
    want = claims._settle(df.toPandas(), 50.0)
    got = claims.in_rounds(df, 50.0).collect()
    assert sorted((r.seed_id, r["rank"], r.collided) for r in got) == sorted(want.itertuples(index=False, name=None))
    assert any(want["collided"]) and not all(want["collided"])


def test_trial_run_is_the_run_without_altitudes(spark):
    p, s = lens.points(spark, D), lens.sites(spark, D)
    last = [r.track_id for r in p.groupBy("track_id").agg(F.max("t").alias("ts")).orderBy(F.desc("ts"), "track_id").limit(50).collect()]
    want = visits.detect_visits(p.where(F.col("track_id").isin(last)).withColumn("alt", F.lit(None).cast("double")), s)
    got = plans.QUERIES["trial_run"](spark, D)
    assert got.count() == want.count() > 0 and {r.mode for r in got.collect()} <= {"C", "D"}


def test_training_rows(spark):
    rows = plans.QUERIES["training_rows"](spark, D).toPandas()
    assert set(rows["sample"]) >= {"positive", "random"} and set(rows.loc[rows["sample"] == "positive", "label"]) == {1}
    assert not rows.duplicated(["tile_id", "row", "col"]).any() and (rows[rows["sample"] != "positive"]["label"] == 0).all()
    assert rows.groupby(["tile_id", "sample"]).size().max() <= 2 and not ((rows["sample"] == "random") & (rows["elev_rank"] > 0.95) & (rows["pct_lower"] > 0.9)).any()
    secondary = plans.QUERIES["secondary_peaks"](spark, D).toPandas()
    seeds = rows.loc[rows["sample"] == "positive", ["tile_id", "row", "col"]].itertuples(index=False, name=None)
    want = set(secondary[["tile_id", "row", "col"]].itertuples(index=False, name=None)) - set(seeds)
    assert set(rows.loc[rows["sample"] == "secondary", ["tile_id", "row", "col"]].itertuples(index=False, name=None)) == want


def test_outlines(spark):
    square, ring = {(r, c) for r in range(3) for c in range(4)}, {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    assert raster._outline(square) == [[(0, 0), (0, 4), (3, 4), (3, 0), (0, 0)]] and len(raster._outline(ring)) == 2
    touching = raster._outline({(0, 0), (1, 1)})
    assert sum(len(r) - 1 for r in touching) == 8


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    rows, seen, path = spark.range(10, 45).withColumnRenamed("id", "k"), [], str(tmp_path / "progress")

    def work(batch):
        seen.append([r.k for r in batch.collect()])
        if len(seen) == 2:
            raise RuntimeError("stopped")
        return 1, 0

    with pytest.raises(RuntimeError):
        batches.run(rows, "k", path, 10, work)
    assert batches.load_progress(spark, path).count() == 1
    assert batches.run(rows, "k", path, 10, work, keep=True) == 3 and seen[1] == seen[2] and sorted(sum(seen[:1] + seen[2:], [])) == list(range(10, 45))
    t = batches.totals(batches.load_progress(spark, path), 70).first()
    assert (t.processed, t.found, t.percent) == (35, 4, 50.0)
    batches.clear_progress(spark, path)
    assert batches.load_progress(spark, path).count() == 0 and batches.run(rows.limit(0), "k", path, 10, work) == 0


def write_shapefile(path, polygons, fields):
    shp, shx, at = b"", b"", 50
    for i, rings in enumerate(polygons):
        points = [p for r in rings or [] for p in r]
        starts = np.cumsum([0, *map(len, rings or [])])[:-1]
        body = struct.pack("<i", 0) if rings is None else struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    path.write_bytes(head(len(shp)) + shp)
    path.with_suffix(".shx").write_bytes(head(len(shx)) + shx)
    names = list(fields)
    table = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(polygons), 33 + 32 * len(names), 1 + 10 * len(names))
    table += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14 for n in names) + b"\r"
    for row in zip(*fields.values(), strict=True):
        table += b" " + b"".join(v.encode("latin-1").ljust(10) for v in row)
    path.with_suffix(".dbf").write_bytes(table)


def test_shapefile(spark, tmp_path):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    write_shapefile(tmp_path / "a.shp", [[square], [square, square], None], {"NAME": ["one", "zwölf", ""], "ACRES": ["5", "6", "7"]})
    rows = sorted(shapefiles(spark, str(tmp_path)).collect(), key=lambda r: r.record)
    assert [r.properties for r in rows] == [{"NAME": "one", "ACRES": "5"}, {"NAME": "zwölf", "ACRES": "6"}, {"NAME": None, "ACRES": "7"}]
    assert [None if r.rings is None else [[tuple(p) for p in ring] for ring in r.rings] for r in rows] == [[square], [square, square], None]


def test_archives_and_layers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("deep/a.shp", "1234")
        z.writestr("deep/b.gdb/t", "1")
    assert {(r.member, r["size"]) for r in readers.archive_members(spark, str(tmp_path)).collect()} == {("deep/a.shp", 4), ("deep/b.gdb/t", 1)}
    paths = spark.createDataFrame([("/d/a.shp",), ("/d/b.zip",), ("/e/c.gdb/",), ("/e/a.zip",), ("/f/x.txt",)], "path string")
    assert {(r.folder, r.path) for r in readers.best_layer(paths).collect()} == {("/d", "/d/b.zip"), ("/e", "/e/c.gdb/")}


def test_landed_documents(spark, tmp_path):
    doc = {"id": 5, "name": "Hike", "type": "Hike", "start_date": "2024-05-01T10:00:00Z", "timezone": "(GMT-07:00) America/Denver", "utc_offset": -21600.0, "start_latlng": [39.0, -105.0], "private": True}
    (tmp_path / "a.json").write_text(json.dumps(doc) + "\nnot json\n")
    r = readers.activities(spark, str(tmp_path / "a.json")).collect()
    assert len(r) == 1 and (r[0].sport, r[0].time_zone, r[0].offset_seconds, r[0].is_public, r[0].lat) == ("Hike", "America/Denver", -21600, False, 39.0)
    (tmp_path / "g.json").write_text(json.dumps({"geonames": [{"geonameId": 1, "name": "A", "lat": "39.5", "lng": "-105.5", "elevation": 10, "adminCode1": "CO", "countryCode": "US"}]}))
    assert tuple(readers.geonames(spark, str(tmp_path / "g.json")).first()) == ("1", "A", 39.5, -105.5, 10.0, "CO", "US")
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"id": "n7", "properties": {"name": "P", "name:en": "Q", "ele": "12 m"}, "geometry": {"type": "Point", "coordinates": [-105.0, 39.0]}}, {"id": "n8", "properties": {}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}))
    assert [tuple(x) for x in readers.osm_sites(readers.geojson_features(spark, str(tmp_path / "f.json"))).collect()] == [("7", "Q", 39.0, -105.0, 12.0)]


def test_sinks(spark, tmp_path):
    df = spark.range(95).withColumnRenamed("id", "k")
    sizes = [r["count"] for r in sinks.outbox(df, "k", parts=3).groupBy("batch").count().collect()]
    assert sum(sizes) == 95 and max(sizes) == 10 and len(sizes) <= 12
    spark.sql("CREATE DATABASE IF NOT EXISTS more")
    for _ in range(2):
        sinks.reload(df, "more.t", ["k"], 2)
    assert spark.table("more.t").count() == 95 and sinks.add_columns(spark, "more.t", {"K": "long", "note": "string"}) == ["note"] and sinks.add_columns(spark, "more.t", {"note": "string"}) == []
    assert readers.known_tables(spark, "more.t", "more.u") == {"more.t": True, "more.u": False} and readers.has_columns(df, "K", "z") == {"K": True, "z": False}
    sinks.by_outcome(df.withColumn("outcome", F.when(F.col("k") < 5, "high").otherwise("none")), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).groupBy("outcome").count().where("outcome = 'high'").first()["count"] == 5
    sinks.csv(df, str(tmp_path / "c"))
    assert readers.csv_table(spark, str(tmp_path / "c"), "k long").count() == 95
    lines = sinks.with_errors(spark.createDataFrame([(1, "ok", None), (2, "x", "bad")], "id int, r string, e string"), "r", "e").collect()
    assert [json.loads(x.value) for x in lines] == [{"id": 1, "r": "ok"}, {"id": 2, "error": "bad"}]
    df.write.parquet(str(tmp_path / "l"))
    assert readers.layer(spark, str(tmp_path / "l"), ["k"], "k > 90", 3).count() == 3


def test_times_and_geometry(spark):
    assert value(spark, times.from_local(F.lit("2024-03-01T10:00:00.789Z"), F.lit("-07:00")).cast("timestamp_ntz")) == datetime(2024, 3, 1, 17)
    assert value(spark, geo.spheroid_distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111319.49, abs=0.5)
    assert value(spark, geo.spheroid_distance(F.lit(40.0), F.lit(-105.0), F.lit(41.0), F.lit(-105.0))) == pytest.approx(111042.0, abs=15)
    assert value(spark, geo.spheroid_distance(F.lit(40.0), F.lit(-105.0), F.lit(40.0), F.lit(-105.0))) == 0.0
    g = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}'
    assert value(spark, geo.geojson_wkt(F.lit(g))) == "MULTIPOLYGON(((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)))"


def test_folds_summary_says_whether_a_model_is_good(spark):
    rows = spark.createDataFrame([(0.8, 0.5, 0.5, 0.5), (0.9, 0.5, 0.5, 0.5)], "accuracy double, precision double, recall double, f1 double")
    got = {r.metric: r for r in ml.summary(rows).collect()}
    assert got["accuracy"].good is False and got["accuracy"].std == pytest.approx(0.05) and got["f1"].good is None
