"""Reference systems: longitude and latitude (EPSG 4326), web mercator (3857) and the UTM zones of WGS 84 (326zz, 327zz).

Formulas take the functions they are made of from `m`: pyspark.sql.functions for Columns, numpy for arrays, so that the same formula
serves expressions and tasks. UTM is the transverse mercator series in the ellipsoid's third flattening to its fourth power, good to
less than a micrometre within a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

# The ellipsoid of WGS 84, and the scale and false origin of UTM.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0

N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(N) / (1 + N)

# Coefficients of powers 1 to 4 of the third flattening, in the terms of double, fourfold, sixfold and eightfold angles.
TO_GRID = [(1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280)]
FROM_GRID = [(1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280)]
TO_LATITUDE = [(2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630)]


def series(rows: list[tuple]) -> list[float]:
    return [sum(c * N ** (k + 1) for k, c in enumerate(row)) for row in rows]


def zone(epsg: int) -> tuple[float, float]:
    """Central meridian and false northing of a UTM system."""
    number = epsg % 100
    if epsg // 100 not in (326, 327) or not 1 <= number <= 60:
        raise ValueError(f"no such reference system here: {epsg}")
    return 6.0 * number - 183, FALSE_NORTH if epsg // 100 == 327 else 0.0


def project(epsg: int, lon, lat, m=F):
    """x and y of a longitude and latitude in degrees."""
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return m.radians(lon) * SEMI_MAJOR, m.asinh(m.tan(m.radians(lat))) * SEMI_MAJOR
    centre, north = zone(epsg)
    away, s = m.radians(lon - centre), m.sin(m.radians(lat))
    t = m.sinh(m.atanh(s) - ECCENTRICITY * m.atanh(ECCENTRICITY * s))
    up, across = m.atan2(t, m.cos(away)), m.atanh(m.sin(away) / m.sqrt(1 + t * t))
    x, y = across, up
    for j, c in enumerate(series(TO_GRID), 1):
        x = x + c * m.cos(2 * j * up) * m.sinh(2 * j * across)
        y = y + c * m.sin(2 * j * up) * m.cosh(2 * j * across)
    return FALSE_EAST + SCALE * RECTIFYING * x, north + SCALE * RECTIFYING * y


def unproject(epsg: int, x, y, m=F):
    """Longitude and latitude in degrees of x and y."""
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return m.degrees(x / SEMI_MAJOR), m.degrees(m.atan(m.sinh(y / SEMI_MAJOR)))
    centre, north = zone(epsg)
    up, across = (y - north) / (SCALE * RECTIFYING), (x - FALSE_EAST) / (SCALE * RECTIFYING)
    a, b = up, across
    for j, c in enumerate(series(FROM_GRID), 1):
        a = a - c * m.sin(2 * j * up) * m.cosh(2 * j * across)
        b = b - c * m.cos(2 * j * up) * m.sinh(2 * j * across)
    conformal = m.asin(m.sin(a) / m.cosh(b))
    lat = conformal
    for j, c in enumerate(series(TO_LATITUDE), 1):
        lat = lat + c * m.sin(2 * j * conformal)
    return centre + m.degrees(m.atan2(m.sinh(b), m.cos(a))), m.degrees(lat)


def transform(source: int, target: int, x, y, m=F):
    """x and y of one system in another."""
    return project(target, *unproject(source, x, y, m), m)
