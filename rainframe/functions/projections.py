"""Inverse map projections as column expressions: from metres on a map to degrees.

A projection is read from the text of a .prj file or known by its EPSG number. The formulas are those of Snyder's working manual (Map
projections, 1987), for an ellipsoid, but for the transverse Mercator, which is by Krueger's series; all that does not depend on the point is worked out once, in Python."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Datums that agree with WGS 84 to within about two metres, by parts of their names: fixed values.
SAME_DATUM = ("wgs_1984", "wgs84", "world_geodetic_system_1984", "etrs_1989", "etrs89", "european_terrestrial_reference_system_1989", "north_american_1983", "north_american_datum_1983", "china_2000", "cgcs_2000", "gda_1994", "gda94", "itrf")
#: Projections by the names that files give them: fixed values.
KINDS = {
    "transverse_mercator": "transverse",
    "gauss_kruger": "transverse",
    "lambert_conformal_conic": "lambert",
    "lambert_conformal_conic_1sp": "lambert",
    "lambert_conformal_conic_2sp": "lambert",
    "albers": "albers",
    "albers_conic_equal_area": "albers",
    "mercator": "mercator",
    "mercator_1sp": "mercator",
    "mercator_2sp": "mercator",
    "mercator_auxiliary_sphere": "web",
    "popular_visualisation_pseudo_mercator": "web",
}


class Projection(NamedTuple):
    """Semi-major axis and squared eccentricity, the kind (None: degrees already), its parameters in degrees and metres, metres of a unit
    and degrees of an angular one."""

    kind: str | None
    a: float = 6378137.0
    e2: float = 0.0066943799901413165
    parameters: dict[str, float] = {}
    metres: float = 1.0
    degrees: float = 1.0


def from_wkt(text: str) -> Projection:
    """A projection from the text of a .prj file. Unknown projections, datums far from WGS 84 and other prime meridians than Greenwich
    are errors: coordinates are never taken for what they are not."""
    quoted = lambda key: [m.lower().replace(" ", "_") for m in re.findall(rf'\b{key}\s*\[\s*"([^"]*)"', text, re.I)]
    numbers = lambda key: [(k.lower().replace(" ", "_"), float(v)) for k, v in re.findall(rf'\b{key}\s*\[\s*"([^"]*)"\s*,\s*([-+.\deE]+)', text, re.I)]
    datum = quoted("DATUM")
    if not datum or not any(known in datum[0] for known in SAME_DATUM):
        raise ValueError(f"no way from the datum {datum[0] if datum else text[:80]!r} to longitude and latitude")
    if any(v for _, v in numbers("PRIMEM")):
        raise ValueError("longitudes are counted from another meridian than Greenwich")
    axis = re.search(r'\bSPHEROID\s*\[\s*"[^"]*"\s*,\s*([.\deE+]+)\s*,\s*([.\deE+]+)', text, re.I)
    a, flat = (float(axis[1]), float(axis[2])) if axis else (6378137.0, 298.257223563)
    f = 1 / flat if flat else 0.0
    e2 = f * (2 - f)
    units = numbers("UNIT")
    angle = math.degrees(units[0][1]) if units else 1.0
    angle = 1.0 if abs(angle - 1) < 1e-9 else angle
    named = quoted("PROJECTION")
    if not named:
        return Projection(None, a, e2, degrees=angle)
    if named[0] not in KINDS:
        raise ValueError(f"the projection {named[0]!r} is not known here")
    kind, parameters = KINDS[named[0]], dict(numbers("PARAMETER"))
    # the last unit is the map's; an angular one stands in the geographic part before it
    return Projection(kind, a, e2, parameters, units[-1][1] if len(units) > 1 else 1.0, angle)


def from_epsg(code: int) -> Projection:
    """Degrees (4326), Web Mercator (3857) and the zones of UTM on WGS 84 (326xx north, 327xx south)."""
    if code in (4326, 4979, 4258, 4269):
        return Projection(None)
    if code in (3857, 900913):
        return Projection("web")
    zone = code % 100
    if code // 100 in (326, 327) and 1 <= zone <= 60:
        return Projection("transverse", parameters={"central_meridian": zone * 6.0 - 183, "scale_factor": 0.9996, "false_easting": 500000.0, "false_northing": 0.0 if code < 32700 else 10000000.0})
    raise ValueError(f"EPSG:{code} is not known here")


def crs_of(document: dict) -> Projection:
    """What a GeoJSON document says of its coordinates; without a word they are degrees."""
    name = str(((document.get("crs") or {}).get("properties") or {}).get("name", "CRS84"))
    if name.upper().endswith("CRS84"):
        return Projection(None)
    code = re.search(r"EPSG:+(?:[\d.]*:)?(\d+)$", name, re.I)
    if not code:
        raise ValueError(f"the coordinates' system {name!r} is not known here")
    return from_epsg(int(code[1]))


def to_degrees(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of points on the map."""
    if p.kind is None:
        return x * p.degrees, y * p.degrees
    get = lambda *names, default=0.0: next((p.parameters[n] for n in names if n in p.parameters), default)
    u = (x * p.metres - get("false_easting") * p.metres) / p.a
    v = (y * p.metres - get("false_northing") * p.metres) / p.a
    turn = math.radians(p.degrees)
    lon0 = get("central_meridian", "longitude_of_center", "longitude_of_origin") * turn
    lat0 = get("latitude_of_origin", "latitude_of_center") * turn
    first, second = get("standard_parallel_1", default=math.nan) * turn, get("standard_parallel_2", default=math.nan) * turn
    lon, lat = _INVERSE[p.kind](p.e2, u, v, lat0, first, second, get("scale_factor", default=1.0))
    lon = F.degrees(lon + lon0)
    return lon - 360 * F.floor((lon + 180) / 360), F.degrees(lat)


def _sines(x: Column, *by: float) -> Column:
    """x plus the sum of by[k] * sin(2 (k + 1) x)."""
    out = x
    for k, c in enumerate(by):
        out = out + c * F.sin(2 * (k + 1) * x)
    return out


def _from_conformal(e2: float, t: Column) -> Column:
    """Latitude from t = tan(pi / 4 - chi / 2), chi being the conformal latitude."""
    e4, e6, e8 = e2**2, e2**3, e2**4
    return _sines(
        math.pi / 2 - 2 * F.atan(t),
        e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360,
        7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520,
        7 * e6 / 120 + 81 * e8 / 1120,
        4279 * e8 / 161280,
    )


def _m(e2: float, lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - e2 * math.sin(lat) ** 2)


def _t(e2: float, lat: float) -> float:
    s = math.sqrt(e2) * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (math.sqrt(e2) / 2)


def _q(e2: float, lat: float) -> float:
    s, e = math.sin(lat), math.sqrt(e2)
    return 2 * s if e == 0 else (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _web(e2, u, v, lat0, first, second, k0):
    return u, math.pi / 2 - 2 * F.atan(F.exp(-v))


def _mercator(e2, u, v, lat0, first, second, k0):
    k = k0 if math.isnan(first) else _m(e2, first)
    return u / k, _from_conformal(e2, F.exp(-v / k))


def _lambert(e2, u, v, lat0, first, second, k0):
    first = lat0 if math.isnan(first) else first
    second = first if math.isnan(second) else second
    n = math.sin(first) if abs(first - second) < 1e-10 else math.log(_m(e2, first) / _m(e2, second)) / math.log(_t(e2, first) / _t(e2, second))
    scale = k0 * _m(e2, first) / (n * _t(e2, first) ** n)
    up = scale * _t(e2, lat0) ** n - v
    sign = math.copysign(1.0, n)
    rho = sign * F.hypot(u, up)
    return F.atan2(sign * u, sign * up) / n, _from_conformal(e2, F.pow(rho / scale, F.lit(1 / n)))


def _albers(e2, u, v, lat0, first, second, k0):
    second = first if math.isnan(second) else second
    n = math.sin(first) if abs(first - second) < 1e-10 else (_m(e2, first) ** 2 - _m(e2, second) ** 2) / (_q(e2, second) - _q(e2, first))
    c = _m(e2, first) ** 2 + n * _q(e2, first)
    up = math.sqrt(c - n * _q(e2, lat0)) / n - v
    sign = math.copysign(1.0, n)
    q = (c - (u * u + up * up) * n * n) / n
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _q(e2, math.pi / 2))))
    e4, e6 = e2**2, e2**3
    return F.atan2(sign * u, sign * up) / n, _sines(beta, e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360)


def _transverse(e2, u, v, lat0, first, second, k0):
    """By the series in the third flattening, which hold far from the central meridian too."""
    e4, e6 = e2**2, e2**3
    along = (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat0 - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * math.sin(2 * lat0) + (15 * e4 / 256 + 45 * e6 / 1024) * math.sin(4 * lat0) - 35 * e6 / 3072 * math.sin(6 * lat0)
    r = math.sqrt(1 - e2)
    n = (1 - r) / (1 + r)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    north, east = (along + v / k0) / radius, u / k0 / radius
    by = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    up = sum((-c * F.sin(2 * (j + 1) * north) * F.cosh(2 * (j + 1) * east) for j, c in enumerate(by)), north)
    right = sum((-c * F.cos(2 * (j + 1) * north) * F.sinh(2 * (j + 1) * east) for j, c in enumerate(by)), east)
    chi = F.asin(F.sin(up) / F.cosh(right))
    return F.atan2(F.sinh(right), F.cos(up)), _sines(chi, 2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)


_INVERSE = {"web": _web, "mercator": _mercator, "lambert": _lambert, "albers": _albers, "transverse": _transverse}
