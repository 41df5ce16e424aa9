"""Coordinates as column arithmetic: UTM zones, transverse Mercator, elevation cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS 84 (fixed values): equatorial radius, flattening; UTM scale and offsets.
RADIUS, FLATTENING, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger series to third order: forward, inverse, and latitude from conformal latitude.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
METRES_A_DEGREE = 111000.0


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone: 326zz north of the equator and on it, 327zz south."""
    zone = F.floor((lon + 180.0) / 6.0) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def central_meridian(epsg: Column) -> Column:
    return (epsg % 100) * 6.0 - 183.0


def _series(coefficients, term) -> Column:
    out = term(1) * coefficients[0]
    for k, c in enumerate(coefficients[1:], 2):
        out = out + term(k) * c
    return out


def to_utm(lat: Column, lon: Column, epsg: Column) -> Column:
    """struct(x, y) in metres of a point in a UTM zone."""
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(epsg))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(t * t + 1.0))
    x = eta + _series(_ALPHA, lambda k: F.cos(xi * (2.0 * k)) * F.sinh(eta * (2.0 * k)))
    y = xi + _series(_ALPHA, lambda k: F.sin(xi * (2.0 * k)) * F.cosh(eta * (2.0 * k)))
    north = F.when(epsg >= 32700, NORTH).otherwise(0.0)
    return F.struct((x * (SCALE * _A) + EAST).alias("x"), (y * (SCALE * _A) + north).alias("y"))


def _unprojected(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    north = F.when(epsg >= 32700, NORTH).otherwise(0.0)
    xi, eta = (y - north) / (SCALE * _A), (x - EAST) / (SCALE * _A)
    xi1 = xi - _series(_BETA, lambda k: F.sin(xi * (2.0 * k)) * F.cosh(eta * (2.0 * k)))
    eta1 = eta - _series(_BETA, lambda k: F.cos(xi * (2.0 * k)) * F.sinh(eta * (2.0 * k)))
    return xi1, eta1


def _on_sphere(xi1: Column, eta1: Column) -> tuple[Column, Column]:
    return F.asin(F.sin(xi1) / F.cosh(eta1)), F.atan2(F.sinh(eta1), F.cos(xi1))


def _degrees(chi: Column, lam: Column, epsg: Column) -> Column:
    phi = chi + _series(_DELTA, lambda k: F.sin(chi * (2.0 * k)))
    return F.struct(F.degrees(phi).alias("lat"), (F.degrees(lam) + central_meridian(epsg)).alias("lon"))


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """struct(lat, lon) in degrees of a point of a UTM zone."""
    return _degrees(*_on_sphere(*_unprojected(x, y, epsg)), epsg)


def all_from_utm(points: Column, epsg: Column) -> Column:
    """``from_utm`` of each (x, y) of an array; each step is an array of its own, as functions of elements compute nothing once."""
    pair = lambda p: F.struct(p[0].alias("a"), p[1].alias("b"))
    flat = F.transform(points, lambda p: pair(_unprojected(p["x"], p["y"], epsg)))
    sphere = F.transform(flat, lambda p: pair(_on_sphere(p["a"], p["b"])))
    return F.transform(sphere, lambda p: _degrees(p["a"], p["b"], epsg))


def utm_to_utm(x: Column, y: Column, source: Column, target: Column) -> Column:
    """struct(x, y) of a point of one UTM zone in the coordinates of another."""
    place = from_utm(x, y, source)
    return to_utm(place["lat"], place["lon"], target)


def pixel_coords(pixels: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """Adds x and y in projected metres of each pixel's top left corner."""
    return pixels.withColumns({"x": F.lit(x0) + F.col("px_col") * res, "y": F.lit(y0) - F.col("px_row") * res})


def cell_name(lat: Column, lon: Column) -> Column:
    """Name of the one-degree elevation cell whose lower left corner is (lat, lon), whole degrees."""
    return F.format_string(
        "%s%02d%s%03d",
        F.when(lat < 0, "S").otherwise("N"),
        F.abs(lat).cast("int"),
        F.when(lon < 0, "W").otherwise("E"),
        F.abs(lon).cast("int"),
    )


def cell_top_left(name: Column) -> Column:
    """struct(lon, lat) of a cell's top left corner, from its file name."""
    part = lambda i: F.regexp_extract(name, r"([nsNS])(\d{2})([weWE])(\d{3})", i)
    lat = part(2).cast("double") * F.when(F.lower(part(1)) == "n", 1.0).otherwise(-1.0) + 1.0
    lon = part(4).cast("double") * F.when(F.lower(part(3)) == "e", 1.0).otherwise(-1.0)
    return F.struct(lon.alias("lon"), lat.alias("lat"))
