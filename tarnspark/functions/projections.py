"""Places on maps back to degrees: the inverse of three projections of the spheroid, and descriptions of them in .prj files.

Formulas are the published ones (Snyder, Map Projections: A Working Manual, 1987) as column expressions: Albers' equal-area and
Lambert's conformal conic with two standard parallels, and the transverse Mercator. Latitudes come from series, good to a
millimetre or so within the areas these projections are used for.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Projection:
    """kind: degrees, albers, lambert or mercator; the spheroid's half axis and flattening; metres of a unit; parameters by name."""

    kind: str
    axis: float = 6378137.0
    flat: float = 1 / 298.257223563
    unit: float = 1.0
    values: dict[str, float] = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash((self.kind, self.axis, self.flat, self.unit))

    def value(self, *names: str, default: float = 0.0) -> float:
        return next((self.values[n] for n in names if n in self.values), default)


#: How .prj files write the projections.
KINDS = {"albers": "albers", "albers_conic_equal_area": "albers", "lambert_conformal_conic": "lambert", "lambert_conformal_conic_2sp": "lambert", "transverse_mercator": "mercator", "gauss_kruger": "mercator"}


def parse_prj(text: str) -> Projection:
    """The projection of a .prj file's text; of one without, degrees. A projection that isn't known here is an error."""
    spheroid = re.search(r'SPHEROID\s*\[\s*"[^"]*"\s*,\s*([-+.\deE]+)\s*,\s*([-+.\deE]+)', text, re.I)
    axis, inverse = (float(x) for x in spheroid.groups()) if spheroid else (6378137.0, 298.257223563)
    flat = 1 / inverse if inverse else 0.0
    named = re.search(r'PROJECTION\s*\[\s*"([^"]*)"', text, re.I)
    if not named:
        return Projection("degrees", axis, flat)
    kind = KINDS.get(named[1].strip().lower().replace(" ", "_"))
    if not kind:
        raise ValueError(f"projection {named[1]} isn't known")
    values = {n.strip().lower().replace(" ", "_"): float(v) for n, v in re.findall(r'PARAMETER\s*\[\s*"([^"]*)"\s*,\s*([-+.\deE]+)', text, re.I)}
    units = re.findall(r'UNIT\s*\[\s*"[^"]*"\s*,\s*([-+.\deE]+)', text, re.I)
    return Projection(kind, axis, flat, float(units[-1]) if len(units) > 1 else 1.0, values)


def _m(e2: float, lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - e2 * math.sin(lat) ** 2)


def _from_conformal(p: Projection) -> tuple[float, ...]:
    """Coefficients of the series from a conformal latitude to the geodetic one."""
    n = p.flat / (2 - p.flat)
    return 2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630


def _albers(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    e2 = p.flat * (2 - p.flat)
    e = math.sqrt(e2)

    def q(s: float) -> float:
        return 2 * s if not e else (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    one, two, origin = (math.radians(p.value(n, *more)) for n, more in (("standard_parallel_1", ()), ("standard_parallel_2", ()), ("latitude_of_origin", ("latitude_of_center",))))
    a, b, c = q(math.sin(one)), q(math.sin(two)), q(math.sin(origin))
    n = (_m(e2, one) ** 2 - _m(e2, two) ** 2) / (b - a) if one != two else math.sin(one)
    whole = _m(e2, one) ** 2 + n * a
    rho0 = p.axis * math.sqrt(whole - n * c) / n
    sign = 1.0 if n > 0 else -1.0
    down = rho0 - y
    rho = F.sqrt(x * x + down * down)
    own = (F.lit(whole) - rho * rho * n * n / p.axis**2) / n
    # the latitude of a sphere of equal area, then a series
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), own / q(1.0))))
    terms = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
    lat = beta + sum((c * F.sin(2 * j * beta) for j, c in enumerate(terms, 1)), F.lit(0.0))
    return F.degrees(lat), F.degrees(F.atan2(sign * x, sign * down) / n)


def _lambert(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    e = math.sqrt(p.flat * (2 - p.flat))

    def t(lat: float) -> float:
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    one, two, origin = (math.radians(p.value(n, *more)) for n, more in (("standard_parallel_1", ("latitude_of_origin",)), ("standard_parallel_2", ("standard_parallel_1",)), ("latitude_of_origin", ("latitude_of_center",))))
    n = (math.log(_m(e * e, one)) - math.log(_m(e * e, two))) / (math.log(t(one)) - math.log(t(two))) if one != two else math.sin(one)
    scale = p.axis * _m(e * e, one) / (n * t(one) ** n) * p.value("scale_factor", default=1.0)
    sign = 1.0 if n > 0 else -1.0
    down = scale * t(origin) ** n - y
    own = F.pow(F.sqrt(x * x + down * down) / abs(scale), 1 / n)
    chi = math.pi / 2 - 2 * F.atan(own)
    lat = chi + sum((c * F.sin(2 * j * chi) for j, c in enumerate(_from_conformal(p), 1)), F.lit(0.0))
    return F.degrees(lat), F.degrees(F.atan2(sign * x, sign * down) / n)


def _mercator(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    """By Krueger's series to the fourth order."""
    n = p.flat / (2 - p.flat)
    radius = p.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * p.value("scale_factor", default=1.0)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    origin, k = math.radians(p.value("latitude_of_origin")), 2 * math.sqrt(n) / (1 + n)
    conformal = math.atan(math.sinh(math.atanh(math.sin(origin)) - k * math.atanh(k * math.sin(origin))))
    begin = conformal + sum(c * math.sin(2 * j * conformal) for j, c in enumerate(alpha, 1))
    xi, eta = y / radius + begin, x / radius
    up = xi - sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(beta, 1)), F.lit(0.0))
    right = eta - sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(beta, 1)), F.lit(0.0))
    chi = F.asin(F.sin(up) / F.cosh(right))
    lat = chi + sum((c * F.sin(2 * j * chi) for j, c in enumerate(_from_conformal(p), 1)), F.lit(0.0))
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(right), F.cos(up)))


def to_degrees(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lng) of a place of a map, on the map's own spheroid."""
    if p.kind == "degrees":
        return y, x
    x, y = (x - p.value("false_easting")) * p.unit, (y - p.value("false_northing")) * p.unit
    lat, turn = {"albers": _albers, "lambert": _lambert, "mercator": _mercator}[p.kind](p, x, y)
    middle = p.value("central_meridian", "longitude_of_center", "longitude_of_origin")
    return lat, F.pmod(turn + middle + 180.0, F.lit(360.0)) - 180.0


def cut_edges(ring: Column, longest: float) -> Column:
    """A ring (lng, lat in the map's units) with edges no longer than ``longest``: straight lines of a map bend in degrees."""
    ends = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.size(ring)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def pieces(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["lng"] - a["lng"], b["lat"] - a["lat"]
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / longest)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((a["lng"] + dx * k / n).alias("lng"), (a["lat"] + dy * k / n).alias("lat")))

    last = F.element_at(ring, -1)
    return F.when(F.size(ring) > 0, F.concat(F.flatten(F.transform(ends, pieces)), F.array(F.struct(last["lng"].alias("lng"), last["lat"].alias("lat"))))).otherwise(ring)


def rings_in_degrees(rings: Column, p: Projection, longest: float = 1000.0) -> Column:
    """Rings of a projected layer in degrees; long edges are cut first, at ``longest`` metres."""
    if p.kind == "degrees":
        return rings

    def corner(c: Column) -> Column:
        lat, lng = to_degrees(p, c["lng"], c["lat"])
        return F.struct(lng.alias("lng"), lat.alias("lat"))

    return F.transform(rings, lambda r: F.transform(cut_edges(r, longest / p.unit), corner))
