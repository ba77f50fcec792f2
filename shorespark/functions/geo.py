"""Projection, distances and plane geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid and UTM zone 19 south.
SEMI_AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH, MERIDIAN = 0.9996, 500_000.0, 10_000_000.0, -69.0
EARTH_M = 6371008.8

_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_E = 2 * math.sqrt(_N) / (1 + _N)


def _powers(*c: tuple[float, ...]) -> list[float]:
    """Sums of coefficients times powers of n, the first coefficient of row j belonging to n^j."""
    return [sum(a * _N ** (j + i) for i, a in enumerate(row)) for j, row in enumerate(c, 1)]


_ALPHA = _powers((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
_BETA = _powers((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
_DELTA = _powers((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def fenced(df: DataFrame, given: list[str], out: dict[str, Column]) -> DataFrame:
    """df with the columns of `out` behind a generator, which keeps later conditions from being copied into them."""
    return df.select(*[F.col(c) for c in given if c not in out], F.inline(F.array(F.struct(*[e.alias(c) for c, e in out.items()]))))


def with_utm(df: DataFrame, lon: str, lat: str, x: str = "x", y: str = "y") -> DataFrame:
    """Adds easting and northing (m) of WGS84 degrees by the four-term transverse Mercator series; null for null."""
    given = df.columns
    phi = F.radians(lat)
    df = df.withColumns({"_t": F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi))), "_dl": F.radians(F.col(lon) - MERIDIAN)})
    df = df.withColumns({"_xi": F.atan2(F.col("_t"), F.cos("_dl")), "_eta": F.atanh(F.sin("_dl") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
    xi, eta = F.col("_xi"), F.col("_eta")
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return fenced(df, given, {x: F.lit(FALSE_EAST) + F.lit(SCALE * _A) * east, y: F.lit(FALSE_NORTH) + F.lit(SCALE * _A) * north})


def with_degrees(df: DataFrame, x: str, y: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds WGS84 longitude and latitude (degrees) of an easting and northing; null for null."""
    given = df.columns
    df = df.withColumns({"_xi": (F.col(y) - FALSE_NORTH) / (SCALE * _A), "_eta": (F.col(x) - FALSE_EAST) / (SCALE * _A)})
    xi, eta = F.col("_xi"), F.col("_eta")
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, 1):
        xp = xp - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    df = df.withColumns({"_xp": xp, "_ep": ep})
    df = df.withColumn("_chi", F.asin(F.sin("_xp") / F.cosh("_ep")))
    rest = F.col("_chi")
    for j, d in enumerate(_DELTA, 1):
        rest = rest + F.lit(d) * F.sin(2 * j * F.col("_chi"))
    return fenced(df, given, {lon: F.lit(MERIDIAN) + F.degrees(F.atan2(F.sinh("_ep"), F.cos("_xp"))), lat: F.degrees(rest)})


def ground_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def same_longitude(lon: Column) -> Column:
    """A longitude of any convention in [-180, 180)."""
    return F.when(lon.between(-180.0, 179.9999999999), lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment in the plane; a segment of no length is a point."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))
