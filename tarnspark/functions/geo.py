"""Geography as column expressions: distances on a sphere, degree windows, polygons, WKT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius, metres for a degree of latitude, the equator, degrees in a radian.
EARTH_RADIUS_M = 6371000.0
LAT_DEGREE_M = 110574.0
LNG_DEGREE_M = 111320.0
EQUATOR_M = 40075000.0
RADIAN_DEG = 57.2958


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine(lat1, lng1, lat2, lng2) -> Column:
    """Metres between two points on the sphere."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat = F.sin((b - a) / 2)
    half_lng = F.sin(F.radians(_c(lng2) - _c(lng1)) / 2)
    chord = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lng * half_lng
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


#: Half axes of the world geodetic system's spheroid.
SPHEROID_A, SPHEROID_B = 6378137.0, 6356752.314245


def spheroid_distance(lat1, lng1, lat2, lng2) -> Column:
    """Metres on the spheroid by Lambert's formula: some millionths off the geodesic, but for opposite points."""
    flat = (SPHEROID_A - SPHEROID_B) / SPHEROID_A
    reduced = lambda lat: F.atan((1 - flat) * F.tan(F.radians(_c(lat))))
    a, b = reduced(lat1), reduced(lat2)
    half_lat, half_lng = F.sin((b - a) / 2), F.sin(F.radians(_c(lng2) - _c(lng1)) / 2)
    chord = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lng * half_lng
    sigma = 2 * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))
    p, q = (a + b) / 2, (b - a) / 2
    square = lambda x: x * x
    x = (sigma - F.sin(sigma)) * square(F.sin(p) * F.cos(q)) / square(F.cos(sigma / 2))
    y = (sigma + F.sin(sigma)) * square(F.cos(p) * F.sin(q)) / square(F.sin(sigma / 2))
    return F.when(chord <= 0, 0.0).otherwise(SPHEROID_A * (sigma - flat / 2 * (x + y)))


def haversine_asin(lat1, lng1, lat2, lng2) -> Column:
    """Metres between two points on the sphere, by the arc sine."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat, half_lng = F.sin((b - a) / 2), F.sin(F.radians(_c(lng2) - _c(lng1)) / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(half_lat * half_lat + F.cos(a) * F.cos(b) * half_lng * half_lng))


def offset_point(lat, lng, metres, angle) -> tuple[Column, Column]:
    """The point so many metres away at an angle from north, on a local plane."""
    return _c(lat) + _c(metres) * F.cos(_c(angle)) / LNG_DEGREE_M, _c(lng) + _c(metres) * F.sin(_c(angle)) / (LNG_DEGREE_M * F.cos(F.radians(_c(lat))))


def grid_around(lat, lng, radius: float, step: float) -> Column:
    """(lat, lng) of a grid's points no more than ``radius`` metres away."""
    n = int(radius / step)
    lat, lng = _c(lat), _c(lng)
    steps = F.sequence(F.lit(-n), F.lit(n))
    wide = LNG_DEGREE_M * F.cos(F.radians(lat))
    points = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((lat + i * step / LNG_DEGREE_M).alias("lat"), (lng + j * step / wide).alias("lng")))))
    return F.filter(points, lambda p: haversine(lat, lng, p["lat"], p["lng"]) <= radius)


def same_place(lat, lng, of_lat, of_lng, half_lat, half_lng) -> Column:
    """Whether a place lies in the closed box around another."""
    return _c(lat).between(_c(of_lat) - _c(half_lat), _c(of_lat) + _c(half_lat)) & _c(lng).between(_c(of_lng) - _c(half_lng), _c(of_lng) + _c(half_lng))


def degrees_of(metres, lat) -> tuple[Column, Column]:
    """Degrees of latitude and of longitude that ``metres`` span at a latitude."""
    m = _c(metres)
    return F.abs(m / LAT_DEGREE_M), F.abs(m / (EQUATOR_M * F.cos(_c(lat) / RADIAN_DEG)) * 360.0)


def coarse_box(metres, lat) -> tuple[Column, Column]:
    """Half-widths of the coarse box that opens a visit; a width of zero or none becomes 0.01."""
    width = _c(metres) / (LNG_DEGREE_M * F.cos(F.radians(_c(lat))))
    return _c(metres) / LAT_DEGREE_M, F.when((width == 0) | F.isnan(width) | width.isNull(), 0.01).otherwise(width)


def raster_window(metres, lat, clamp: bool = True) -> tuple[Column, Column]:
    cosine = F.cos(F.radians(_c(lat)))
    return _c(metres) / LNG_DEGREE_M, _c(metres) / (LNG_DEGREE_M * (F.greatest(F.lit(0.1), cosine) if clamp else cosine))


def inside_box(lng, lat, west, south, east, north) -> Column:
    """Strictly inside: the boundary doesn't count."""
    return (_c(lng) > _c(west)) & (_c(lng) < _c(east)) & (_c(lat) > _c(south)) & (_c(lat) < _c(north))


def segment_meets_box(x1, y1, x2, y2, west, south, east, north) -> Column:
    """Whether a segment touches a closed box (slab clipping)."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))

    def slab(start: Column, delta: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = (low - start) / F.nullif(delta, F.lit(0.0)), (high - start) / F.nullif(delta, F.lit(0.0))
        within = (start >= low) & (start <= high)
        enter = F.when(delta == 0, F.when(within, 0.0).otherwise(2.0)).otherwise(F.least(a, b))
        leave = F.when(delta == 0, F.when(within, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))
        return enter, leave

    ex, lx = slab(x1, x2 - x1, _c(west), _c(east))
    ey, ly = slab(y1, y2 - y1, _c(south), _c(north))
    return F.greatest(F.lit(0.0), ex, ey) <= F.least(F.lit(1.0), lx, ly)


def track_meets_box(points, west, south, east, north) -> Column:
    """Whether a track, an array of (lng, lat), touches a box with a vertex or in between."""
    p = _c(points)
    pairs = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b")))
    return F.exists(pairs, lambda s: segment_meets_box(s["a"]["lng"], s["a"]["lat"], s["b"]["lng"], s["b"]["lat"], west, south, east, north))


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_rings(lng, lat, rings) -> Column:
    """Even-odd ray casting over all rings of a polygon or multipolygon; holes need no other treatment."""
    x, y = _c(lng), _c(lat)

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["lat"] > y) != (b["lat"] > y)) & (x < (b["lng"] - a["lng"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lng"])

    return F.size(F.filter(F.flatten(F.transform(_c(rings), _edges)), crosses)) % 2 == 1


def signed_area(ring) -> Column:
    """Planar area in square degrees, by the shoelace formula; negative for a ring that goes clockwise."""
    return F.aggregate(_edges(_c(ring)), F.lit(0.0), lambda s, e: s + e["a"]["lng"] * e["b"]["lat"] - e["b"]["lng"] * e["a"]["lat"]) / 2


def ring_area(ring) -> Column:
    return F.abs(signed_area(ring))


def area_sq_m(ring, lat) -> Column:
    return ring_area(ring) * LNG_DEGREE_M * LNG_DEGREE_M * F.cos(F.radians(_c(lat)))


def ring_centroid(ring) -> tuple[Column, Column]:
    """(lat, lng) of a ring's centre of area; null if it has none."""
    edges = _edges(_c(ring))
    cross = lambda e: e["a"]["lng"] * e["b"]["lat"] - e["b"]["lng"] * e["a"]["lat"]
    total = lambda f: F.aggregate(edges, F.lit(0.0), lambda s, e: s + f(e))
    double = F.nullif(total(cross), F.lit(0.0))
    return total(lambda e: (e["a"]["lat"] + e["b"]["lat"]) * cross(e)) / (3 * double), total(lambda e: (e["a"]["lng"] + e["b"]["lng"]) * cross(e)) / (3 * double)


def sound_rings(rings) -> Column:
    """Whether all rings are closed, have three corners or more, and an area."""
    good = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & (ring_area(r) > 0)
    return F.coalesce((F.size(_c(rings)) > 0) & F.forall(_c(rings), good), F.lit(False))


def vertex_count(rings) -> Column:
    return F.size(F.flatten(_c(rings)))


def wkt_ring(ring) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(_c(ring), lambda p: F.concat_ws(" ", p["lng"].cast("string"), p["lat"].cast("string"))), ", "), F.lit(")"))


def wkt_polygon(rings) -> Column:
    return F.concat(F.lit("POLYGON("), F.array_join(F.transform(_c(rings), wkt_ring), ", "), F.lit(")"))


def wkt_point(lng, lat) -> Column:
    return F.concat(F.lit("POINT("), _c(lng).cast("string"), F.lit(" "), _c(lat).cast("string"), F.lit(")"))


def parse_linestring(wkt) -> Column:
    """LINESTRING text as an array of (lng, lat)."""
    inside = F.regexp_extract(_c(wkt), r"^\s*LINESTRING\s*\((.*)\)\s*$", 1)
    return F.transform(F.split(inside, r"\s*,\s*"), lambda p: F.struct(F.split_part(F.trim(p), F.lit(" "), F.lit(1)).cast("double").alias("lng"), F.split_part(F.trim(p), F.lit(" "), F.lit(-1)).cast("double").alias("lat")))


def envelope(west, south, east, north) -> Column:
    """A box as one closed ring."""
    corner = lambda x, y: F.struct(_c(x).alias("lng"), _c(y).alias("lat"))
    return F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))


def parse_polygon(wkt) -> Column:
    """POLYGON text as rings of (lng, lat)."""
    rings = F.regexp_extract_all(_c(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.transform(rings, lambda r: parse_linestring(F.concat(F.lit("LINESTRING("), r, F.lit(")"))))


def as_geojson(points) -> Column:
    """A track, an array of (lng, lat), as a GeoJSON line."""
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(_c(points), lambda p: F.array(p["lng"], p["lat"])).alias("coordinates")))


def geojson_wkt(geometry) -> Column:
    """The WKT of a GeoJSON point, polygon or multipolygon; any other text gives an empty one."""
    g = _c(geometry)
    kind, written = F.get_json_object(g, "$.type"), F.get_json_object(g, "$.coordinates")
    place = lambda p: F.concat_ws(" ", F.get(p, F.lit(0)).cast("string"), F.get(p, F.lit(1)).cast("string"))
    listed = lambda items, f: F.concat(F.lit("("), F.array_join(F.transform(items, f), ", "), F.lit(")"))
    ring = lambda r: listed(r, place)
    rings = lambda rs: listed(rs, ring)
    point = F.concat(F.lit("POINT("), place(F.from_json(written, "array<double>")), F.lit(")"))
    polygon = F.concat(F.lit("POLYGON"), rings(F.from_json(written, "array<array<array<double>>>")))
    several = F.concat(F.lit("MULTIPOLYGON"), listed(F.from_json(written, "array<array<array<array<double>>>>"), rings))
    return F.coalesce(F.when(kind == "Point", point).when(kind == "Polygon", polygon).when(kind == "MultiPolygon", several), F.lit(""))
