"""Scalar geometry and map projections as column expressions: all of it stays inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid, the UTM grid, and the spheres of the two approximate projections.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0
MERCATOR_RADIUS, MEAN_RADIUS = 6378137.0, 6371000.0
KM_PER_DEGREE = 111.32

_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
# Krueger's series in the third flattening, to the fourth order.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60."""
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def utm_srid(lon: Column, lat: Column) -> Column:
    """EPSG code of the zone: 326xx north of the equator, 327xx south of it."""
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _meridian(srid: Column) -> Column:
    return F.radians((srid % 100) * 6 - 183)


def to_utm(lon: Column, lat: Column, srid: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees in the zone of an EPSG code 326xx or 327xx."""
    phi, lam = F.radians(lat), F.radians(lon) - _meridian(srid)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = UTM_SCALE * _RECTIFYING
    return F.lit(FALSE_EASTING) + k * east, F.when(srid >= 32700, FALSE_NORTHING).otherwise(0.0) + k * north


def from_utm(x: Column, y: Column, srid: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    k = UTM_SCALE * _RECTIFYING
    xi0, eta0 = (y - F.when(srid >= 32700, FALSE_NORTHING).otherwise(0.0)) / k, (x - FALSE_EASTING) / k
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - F.lit(b) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(_meridian(srid) + F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return MERCATOR_RADIUS * F.radians(lon), MERCATOR_RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def to_local_metres(lon: Column, lat: Column, mean_lon: Column, mean_lat: Column) -> tuple[Column, Column]:
    """Equirectangular metres about a mean position."""
    return MEAN_RADIUS * F.radians(lon - mean_lon) * F.cos(F.radians(mean_lat)), MEAN_RADIUS * F.radians(lat - mean_lat)


def looks_geographic(min_x: Column, max_x: Column, min_y: Column, max_y: Column) -> Column:
    """The ranges are those of degrees."""
    return (min_x >= -180) & (max_x <= 180) & (min_y >= -90) & (max_y <= 90)


def envelope(lon: Column, lat: Column, half_width_km: float = 50.0) -> tuple[Column, Column, Column, Column]:
    """(min lon, min lat, max lon, max lat) of a square about a centre."""
    dlat = F.lit(half_width_km / KM_PER_DEGREE)
    dlon = F.lit(half_width_km) / (KM_PER_DEGREE * F.cos(F.radians(lat)))
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def distance_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment: the projection clamped to it."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(0.0)
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of array<array<double>> or array<struct<x,y>>-like rings given as array<array<double>>, closed or not."""
    n = F.size(ring)
    x0, y0 = ring[0][0], ring[0][1]
    at = lambda i: ring[F.pmod(i, n).cast("int")]
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + (at(i)[0] - x0) * (at(i + 1)[1] - y0) - (at(i + 1)[0] - x0) * (at(i)[1] - y0)) / 2


def cell_gap(rows: Column, columns: Column, cell: float) -> Column:
    """Shortest distance between two grid cells whose indexes differ by rows and columns."""
    z = F.lit(0)
    return F.lit(cell) * F.hypot(F.greatest(F.abs(rows) - 1, z), F.greatest(F.abs(columns) - 1, z))


def snapped(low: Column, high: Column, cell: float) -> tuple[Column, Column]:
    """Bounds moved out to the lattice of a cell size."""
    return F.floor(low / cell) * cell, F.ceil(high / cell) * cell
