"""Inverse projections against published numbers."""

import math

import pytest
from pyspark.sql import functions as F

from tarnspark.functions import projections
from tarnspark.sources import shapefile

from .test_more import write_shapefile

CLARKE = 'GEOGCS["g",DATUM["d",SPHEROID["Clarke 1866",6378206.4,294.978698214]],PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]]'
MAP = 'PROJCS["m",{0},PROJECTION["{1}"],{2},UNIT["{3}",{4}]]'


def prj(kind, unit=("Meter", 1.0), **values):
    return MAP.format(CLARKE, kind, ",".join(f'PARAMETER["{n}",{v}]' for n, v in values.items()), *unit)


def place(spark, p, x, y):
    lat, lng = projections.to_degrees(p, F.lit(float(x)), F.lit(float(y)))
    return tuple(spark.range(1).select(lat.alias("lat"), lng.alias("lng")).first())


#: The worked examples of the manual: text, easting, northing, latitude, longitude.
EXAMPLES = {
    "albers": (prj("Albers", false_easting=0, false_northing=0, central_meridian=-96, standard_parallel_1=29.5, standard_parallel_2=45.5, latitude_of_origin=23), 1885472.7, 1535925.0, 35.0, -75.0),
    "lambert": (prj("Lambert_Conformal_Conic", false_easting=0, false_northing=0, central_meridian=-96, standard_parallel_1=33, standard_parallel_2=45, latitude_of_origin=23), 1894410.9, 1564649.5, 35.0, -75.0),
    "mercator": (prj("Transverse_Mercator", false_easting=0, false_northing=0, central_meridian=-75, scale_factor=0.9996, latitude_of_origin=0), 127106.5, 4484124.4, 40.5, -73.5),
}


@pytest.mark.parametrize("name", EXAMPLES)
def test_published_examples_within_a_metre(spark, name):
    text, x, y, lat, lng = EXAMPLES[name]
    p = projections.parse_prj(text)
    assert p.kind == name and p.axis == 6378206.4
    got = place(spark, p, x, y)
    assert abs(got[0] - lat) * 111_000 < 1 and abs(got[1] - lng) * 111_000 * math.cos(math.radians(lat)) < 1


@pytest.mark.parametrize("name", EXAMPLES)
def test_units_and_false_origins(spark, name):
    text, x, y, lat, lng = EXAMPLES[name]
    feet = text.replace('UNIT["Meter",1.0]', 'UNIT["Foot_US",0.3048006096012192]').replace('"false_easting",0', '"false_easting",2000000').replace('"false_northing",0', '"false_northing",-500')
    unit = 0.3048006096012192
    got = place(spark, projections.parse_prj(feet), x / unit + 2_000_000, y / unit - 500)
    assert abs(got[0] - lat) < 1e-5 and abs(got[1] - lng) < 1e-5


def test_the_origin_and_a_zone(spark):
    for name in ("albers", "lambert"):
        assert place(spark, projections.parse_prj(EXAMPLES[name][0]), 0, 0) == (pytest.approx(23, abs=1e-7), pytest.approx(-96, abs=1e-7))
    zone = projections.Projection("mercator", values={"false_easting": 500_000.0, "central_meridian": -81.0, "scale_factor": 0.9996})
    got = place(spark, zone, 630_084, 4_833_438)
    assert abs(got[0] - (43 + 38 / 60 + 33.24 / 3600)) < 1e-5 and abs(got[1] + (79 + 23 / 60 + 13.7 / 3600)) < 1e-5


def test_texts(spark):
    assert projections.parse_prj(CLARKE).kind == "degrees"
    with pytest.raises(ValueError, match="isn't known"):
        projections.parse_prj(prj("Krovak", a=1))


def test_rings_with_long_edges_cut(spark):
    p = projections.parse_prj(EXAMPLES["albers"][0])
    square = F.array(*[F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4500, 0), (4500, 4500), (0, 4500), (0, 0))])
    row = spark.range(1).select(projections.rings_in_degrees(F.array(square), p, 1000.0).alias("rings"), projections.cut_edges(square, 1000.0).alias("cut")).first()
    assert len(row.rings[0]) == 4 * 5 + 1 and row.rings[0][0] == row.rings[0][-1]
    assert all(abs(c.lat - 23) < 0.05 and abs(c.lng + 96) < 0.05 for c in row.rings[0])
    assert max(math.hypot(b.lng - a.lng, b.lat - a.lat) for a, b in zip(row.cut, row.cut[1:], strict=False)) <= 1000
    assert spark.range(1).select(projections.cut_edges(F.array().cast("array<struct<lng:double,lat:double>>"), 5.0).alias("c")).first().c == []


def test_a_projected_layer(spark, tmp_path):
    square = [(0.0, 0.0), (3000.0, 0.0), (3000.0, 3000.0), (0.0, 0.0)]
    path = tmp_path / "a.shp"
    write_shapefile(path, [[square], [square, square], None], {"NAME": ["one", "two", "none"], "ACRES": ["5", "6", "7"]})
    plain = shapefile.in_degrees(spark, str(path)).orderBy("record").collect()
    assert [tuple(c) for c in plain[0].rings[0]] == square and plain[0].properties["NAME"] == "one" and plain[2].rings is None
    path.with_suffix(".prj").write_text(EXAMPLES["lambert"][0])
    found = shapefile.in_degrees(spark, str(path), "properties['ACRES'] > 5", ["NAME"], 1).collect()
    assert [(r.record, r.NAME, len(r.rings)) for r in found] == [(1, "two", 2)]
    # the third corner is 3 km east and 3 km north of the origin on the map, whose scale there is some 3 % too large
    far = max(found[0].rings[0], key=lambda c: c.lat)
    assert abs((far.lat - 23) * 110_750 - 3000) < 150 and abs((far.lng + 96) * 102_500 - 3000) < 150
