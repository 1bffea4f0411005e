"""Coordinates and plane geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Metres per degree in bbox_around.
DEGREE_M = 111_320.0

# GRS80 and ETRS-TM35FIN; the series of the map projection's public standard.
_A, _F = 6378137.0, 1 / 298.257222101
_N = _F / (2 - _F)
_A1 = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(2 * _F - _F**2)
K0, LON0, EAST0 = 0.9996, math.radians(27.0), 500_000.0
FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin((F.radians(lat2) - F.radians(lat1)) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin((F.radians(lon2) - F.radians(lon1)) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(clip(a, 0, 1)))


def local_xy(lat: Column, lon: Column, lat0: float, lon0: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Metres east and north of (lat0, lon0), on a frame that is linear about it."""
    ky = 180 / (math.pi * EARTH_KM * 1000)
    kx = ky / math.cos(math.radians(lat0))
    return (lon - lon0) / kx + x0, (lat - lat0) / ky + y0


def local_lonlat(x: Column, y: Column, lat0: float, lon0: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    ky = 180 / (math.pi * EARTH_KM * 1000)
    kx = ky / math.cos(math.radians(lat0))
    return (x - x0) * kx + lon0, (y - y0) * ky + lat0


def tm35fin(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing of ETRS-TM35FIN."""
    phi, lam = F.radians(lat), F.radians(lon) - LON0
    q = F.asinh(F.tan(phi)) - _E * F.atanh(_E * F.sin(phi))
    beta = F.atan(F.sinh(q))
    eta1 = F.atanh(F.cos(beta) * F.sin(lam))
    xi1 = F.asin(F.sin(beta) * F.cosh(eta1))
    xi, eta = xi1, eta1
    for k, h in enumerate(FORWARD, 1):
        xi = xi + h * F.sin(2 * k * xi1) * F.cosh(2 * k * eta1)
        eta = eta + h * F.cos(2 * k * xi1) * F.sinh(2 * k * eta1)
    return _A1 * K0 * eta + EAST0, _A1 * K0 * xi


def tm35fin_inverse(east: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude; six rounds of the fixed point for the isometric latitude."""
    xi, eta = north / (_A1 * K0), (east - EAST0) / (_A1 * K0)
    xi1, eta1 = xi, eta
    for k, h in enumerate(INVERSE, 1):
        xi1 = xi1 - h * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta1 = eta1 - h * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    beta = F.asin(F.sin(xi1) / F.cosh(eta1))
    lam = F.asin(F.tanh(eta1) / F.cos(beta))
    q = F.asinh(F.tan(beta))
    q1 = F.reduce(F.sequence(F.lit(1), F.lit(6)), q, lambda acc, _: q + _E * F.atanh(_E * F.tanh(acc)))
    return F.degrees(F.atan(F.sinh(q1))), F.degrees(lam + LON0)


def frame_for(crs: str | None) -> str:
    """The frame that a CRS name asks for."""
    name = (crs or "").strip().upper()
    if name in ("", "EPSG:3067", "TM35FIN", "ETRS-TM35FIN"):
        return "tm35fin"
    raise ValueError(f"no frame for {crs}")


def bbox_around(lat: Column, lon: Column, metres: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north."""
    dy, dx = metres / DEGREE_M, metres / (DEGREE_M * F.cos(F.radians(lat)))
    return lon - dx, lat - dy, lon + dx, lat + dy


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional Web-Mercator tile coordinates."""
    n = float(2**zoom)
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """Distance of a point from a segment, and the foot point."""
    dx, dy = bx - ax, by - ay
    t = clip(((px - ax) * dx + (py - ay) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9)), 0, 1)
    fx, fy = ax + t * dx, ay + t * dy
    return F.sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy)), fx, fy


def math_angle(compass: Column) -> Column:
    """Counter-clockwise from east, in radians, of a compass bearing in degrees."""
    return F.radians(90 - compass)


def downwind(wind_from: Column) -> Column:
    """The bearing that a wind FROM a bearing blows to."""
    return F.pmod(wind_from + 180, F.lit(360.0))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule over an array of structs (x, y), closed or not."""
    n = F.size(ring)
    def crossing(acc: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1))
        level = (a["y"] > py) != (b["y"] > py)
        return acc + F.when(level & (px < a["x"] + (py - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] == a["y"], F.lit(1e-12)).otherwise(b["y"] - a["y"])), 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), crossing) % 2 == 1
