"""Coordinate reference systems in closed form, as Column expressions and for driver-side numbers alike.

Known: geographic (WGS 84, WGS 72, NAD83), Web Mercator, ellipsoidal Mercator,
UTM (WGS 84, WGS 72, NAD83) and the sphere's sinusoidal projection.  UTM uses
Krueger's series to the fourth order.  Others raise.
"""

from __future__ import annotations

import json
import math
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import MissingCrs
from gridloom.functions.affine import Bounds

#: Fixed values: (semi-major axis, inverse flattening).
ELLIPSOIDS = {"WGS 84": (6378137.0, 298.257223563), "WGS 72": (6378135.0, 298.26), "NAD83": (6378137.0, 298.257222101)}
#: Fixed value: radius of the sphere of the usual sinusoidal tile grids.
SINUSOIDAL_RADIUS = 6371007.181


class Crs(NamedTuple):
    """kind: geographic, web_mercator, mercator, utm or sinusoidal."""

    kind: str
    datum: str = "WGS 84"
    zone: int = 0
    south: bool = False
    code: str = ""

    def __str__(self) -> str:
        return self.code

    @property
    def geographic(self) -> bool:
        return self.kind == "geographic"

    @property
    def units(self) -> str:
        return "degree" if self.geographic else "metre"


def _utm(zone: int, south: bool, datum: str) -> Crs:
    if not 1 <= zone <= 60:
        raise ValueError(f"there is no UTM zone {zone}")
    base = {("WGS 84", False): 32600, ("WGS 84", True): 32700, ("WGS 72", False): 32200, ("WGS 72", True): 32300, ("NAD83", False): 26900}[datum, south]
    return Crs("utm", datum, zone, south, f"EPSG:{base + zone}")


def _epsg(code: int) -> Crs:
    known = {4326: Crs("geographic", code="EPSG:4326"), 4322: Crs("geographic", "WGS 72", code="EPSG:4322"), 4269: Crs("geographic", "NAD83", code="EPSG:4269"), 3857: Crs("web_mercator", code="EPSG:3857"), 3395: Crs("mercator", code="EPSG:3395")}
    if code in known:
        return known[code]
    for base, datum, south, last in ((32600, "WGS 84", False, 60), (32700, "WGS 84", True, 60), (32200, "WGS 72", False, 60), (32300, "WGS 72", True, 60), (26900, "NAD83", False, 23)):
        if base < code <= base + last:
            return _utm(code - base, south, datum)
    raise ValueError(f"EPSG:{code} is not in the registry")


def parse_crs(value) -> Crs:
    """A Crs from one, an EPSG number, "EPSG:n", a PROJ string, WKT, PROJJSON, or an object that has WKT."""
    if isinstance(value, Crs):
        return value
    if value is None or value == "":
        raise MissingCrs("no coordinate reference system is given")
    if isinstance(value, (int, np.integer)):
        return _epsg(int(value))
    for name in ("wkt", "to_wkt"):
        if hasattr(value, name):
            found = getattr(value, name)
            return parse_crs(found() if callable(found) else found)
    if isinstance(value, dict):
        if "id" in value:
            return parse_crs(f"{value['id']['authority']}:{value['id']['code']}")
        if "init" in value:
            return parse_crs(value["init"])
        return parse_crs(" ".join(f"+{k}" if v is True else f"+{k}={v}" for k, v in value.items()))
    text = str(value).strip()
    if text.startswith("{"):
        return parse_crs(json.loads(text))
    if m := re.fullmatch(r"(?:\+?init=)?epsg:(\d+)(?:\s.*)?", text, re.I):
        return _epsg(int(m[1]))
    if text.isdigit():
        return _epsg(int(text))
    if text.upper() in ("WGS84", "WGS 84", "OGC:CRS84", "CRS84"):
        return _epsg(4326)
    if re.fullmatch(r"(?:modis:|sr-org:)?(?:sinusoidal|6974|6842)", text, re.I):
        return Crs("sinusoidal", code="SINUSOIDAL")
    if "+proj" in text:
        p = dict(re.findall(r"\+(\w+)(?:=(\S+))?", text))
        datum = {"WGS72": "WGS 72", "NAD83": "NAD83"}.get(p.get("datum") or {"WGS72": "WGS72", "GRS80": "NAD83"}.get(p.get("ellps", ""), ""), "WGS 84")
        kind = p["proj"]
        if kind in ("longlat", "latlong"):
            return _epsg({"WGS 84": 4326, "WGS 72": 4322, "NAD83": 4269}[datum])
        if kind == "utm":
            return _utm(int(p["zone"]), "south" in p, datum)
        if kind == "merc":
            return _epsg(3857 if p.get("a") == p.get("b") and "a" in p else 3395)
        if kind == "sinu":
            return Crs("sinusoidal", code="SINUSOIDAL")
        raise ValueError(f"projection {kind!r} is not in the registry")
    codes = re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?', text)
    if codes:  # the last one is that of the whole system
        return _epsg(int(codes[-1]))
    if "Sinusoidal" in text:
        return Crs("sinusoidal", code="SINUSOIDAL")
    if m := re.search(r"UTM zone (\d+)([NS])", text):
        return _utm(int(m[1]), m[2] == "S", "NAD83" if "NAD83" in text else "WGS 72" if "WGS 72" in text else "WGS 84")
    raise ValueError(f"can't read a coordinate reference system from {text[:80]!r}")


class _Numbers:
    sin, cos, sinh, cosh, asinh, atanh, asin, hypot, tanh = np.sin, np.cos, np.sinh, np.cosh, np.arcsinh, np.arctanh, np.arcsin, np.hypot, np.tanh
    atan2 = np.arctan2


class _Columns:
    sin, cos, sinh, cosh, asinh, atanh, asin, hypot, tanh = F.sin, F.cos, F.sinh, F.cosh, F.asinh, F.atanh, F.asin, F.hypot, F.tanh
    atan2 = F.atan2


def _math(*values):
    return _Columns if any(isinstance(v, Column) for v in values) else _Numbers


def _third_flattening(datum: str) -> tuple[float, float, float]:
    a, inverse = ELLIPSOIDS[datum]
    f = 1 / inverse
    return a, f / (2 - f), math.sqrt(f * (2 - f))


def _krueger(n: float):
    """Rectifying radius over the axis, and the coefficients of both series and of latitude."""
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return radius, alpha, beta, delta


def _isometric(m, phi, ecc):
    s = m.sin(phi)
    return m.atanh(s) - ecc * m.atanh(s * ecc)


def _latitude(m, conformal, delta):
    phi = conformal
    for j, c in enumerate(delta, 1):
        phi = phi + c * m.sin(conformal * (2 * j))
    return phi


def from_lonlat(crs: Crs, lon, lat):
    """(x, y) of degrees, as numbers, arrays or Columns."""
    if crs.geographic:
        return lon, lat
    m, rad = _math(lon, lat), math.pi / 180
    lam, phi = lon * rad, lat * rad
    if crs.kind == "sinusoidal":
        return SINUSOIDAL_RADIUS * lam * m.cos(phi), SINUSOIDAL_RADIUS * phi
    a, n, ecc = _third_flattening(crs.datum)
    if crs.kind == "web_mercator":
        return a * lam, a * m.atanh(m.sin(phi))
    if crs.kind == "mercator":
        return a * lam, a * _isometric(m, phi, ecc)
    radius, alpha, _, _ = _krueger(n)
    lam = (lon - (6 * crs.zone - 183)) * rad
    t = m.sinh(_isometric(m, phi, ecc))
    xi0, eta0 = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.hypot(t, m.cos(lam)))
    xi, eta = xi0, eta0
    for j, c in enumerate(alpha, 1):
        xi = xi + c * m.sin(xi0 * (2 * j)) * m.cosh(eta0 * (2 * j))
        eta = eta + c * m.cos(xi0 * (2 * j)) * m.sinh(eta0 * (2 * j))
    return 500000.0 + eta * (0.9996 * a * radius), (1e7 if crs.south else 0.0) + xi * (0.9996 * a * radius)


def to_lonlat(crs: Crs, x, y):
    """Degrees of (x, y)."""
    if crs.geographic:
        return x, y
    m, deg = _math(x, y), 180 / math.pi
    if crs.kind == "sinusoidal":
        phi = y / SINUSOIDAL_RADIUS
        return x / (m.cos(phi) * SINUSOIDAL_RADIUS) * deg, phi * deg
    a, n, ecc = _third_flattening(crs.datum)
    if crs.kind == "web_mercator":
        return x / a * deg, m.asin(m.tanh(y / a)) * deg
    radius, _, beta, delta = _krueger(n)
    if crs.kind == "mercator":
        return x / a * deg, _latitude(m, m.asin(m.tanh(y / a)), delta) * deg
    xi0, eta0 = (y - (1e7 if crs.south else 0.0)) / (0.9996 * a * radius), (x - 500000.0) / (0.9996 * a * radius)
    xi, eta = xi0, eta0
    for j, c in enumerate(beta, 1):
        xi = xi - c * m.sin(xi0 * (2 * j)) * m.cosh(eta0 * (2 * j))
        eta = eta - c * m.cos(xi0 * (2 * j)) * m.sinh(eta0 * (2 * j))
    phi = _latitude(m, m.asin(m.sin(xi) / m.cosh(eta)), delta)
    return m.atan2(m.sinh(eta), m.cos(xi)) * deg + (6 * crs.zone - 183), phi * deg


def transform(src: Crs, dst: Crs, x, y):
    """(x, y) from one system to another."""
    src, dst = parse_crs(src), parse_crs(dst)
    return (x, y) if src == dst else from_lonlat(dst, *to_lonlat(src, x, y))


def edge_points(bounds, n: int = 21) -> np.ndarray:
    """Points along the four edges, n between corners."""
    left, bottom, right, top = bounds
    t = np.linspace(0, 1, n + 2)
    xs, ys = left + (right - left) * t, bottom + (top - bottom) * t
    return np.concatenate([np.stack([xs, np.full_like(t, y)], 1) for y in (bottom, top)] + [np.stack([np.full_like(t, x), ys], 1) for x in (left, right)])


def transform_bounds(src, dst, bounds, densify: int = 21) -> Bounds:
    """Outer bounds of the densified edges in another system; boxes across the antimeridian are not split."""
    p = edge_points(bounds, densify)
    x, y = transform(parse_crs(src), parse_crs(dst), p[:, 0], p[:, 1])
    return Bounds(float(np.min(x)), float(np.min(y)), float(np.max(x)), float(np.max(y)))


def utm_crs_of(crs, bounds, datum: str = "WGS 84") -> Crs:
    """The UTM system of the middle of some bounds, with the exceptions of Norway and Svalbard."""
    if crs is None:
        raise MissingCrs("bounds without a coordinate reference system have no UTM zone")
    left, bottom, right, top = transform_bounds(crs, 4326, bounds)
    lon, lat = (left + right) / 2, (bottom + top) / 2
    if not (-80 <= lat <= 84 and -180 <= lon <= 180):
        raise RuntimeError("no UTM system covers these bounds")
    zone = min(int((lon + 180) // 6) + 1, 60)
    if 56 <= lat < 64 and 3 <= lon < 12:
        zone = 32
    if lat >= 72 and 0 <= lon < 42:
        zone = 31 + 2 * int((lon + 3) // 12)
    return _utm(zone, lat < 0, datum)
