"""Albers equal-area conic coordinates as column expressions (Snyder 1987)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.functions.columns import col


@dataclass(frozen=True)
class Albers:
    """Projection constants, angles in degrees.

    ``flattening = 0`` gives the spherical form.  Defaults are the common
    parameters for the conterminous United States on WGS84.
    """

    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0
    radius: float = 6378137.0
    flattening: float = 1 / 298.257223563

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    def _m2(self, phi: float) -> float:
        return math.cos(phi) ** 2 / (1 - self.e2 * math.sin(phi) ** 2)

    def _q(self, phi: float) -> float:
        s = math.sin(phi)
        if self.e2 == 0:
            return 2 * s
        e = math.sqrt(self.e2)
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def series(self) -> tuple[float, float, float]:
        """Coefficients of sin 2b, sin 4b and sin 6b from authalic to geodetic latitude."""
        e2, e4, e6 = self.e2, self.e2**2, self.e2**3
        return e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360

    def cone(self) -> tuple[float, float, float]:
        """Cone constant n, C and the radius at the origin latitude."""
        p0, p1, p2 = (math.radians(v) for v in (self.lat0, self.lat1, self.lat2))
        n = math.sin(p1) if p1 == p2 else (self._m2(p1) - self._m2(p2)) / (self._q(p2) - self._q(p1))
        c = self._m2(p1) + n * self._q(p1)
        return n, c, self.radius * math.sqrt(c - n * self._q(p0)) / n


def _q_column(sin_lat: Column, e2: float) -> Column:
    if e2 == 0:
        return 2 * sin_lat
    e = math.sqrt(e2)
    return (1 - e2) * (
        sin_lat / (1 - e2 * sin_lat * sin_lat) - F.ln((1 - e * sin_lat) / (1 + e * sin_lat)) / (2 * e)
    )


def albers_xy(lon: Column | str, lat: Column | str, crs: Albers = Albers()) -> tuple[Column, Column]:
    """Longitude and latitude in degrees -> easting and northing."""
    n, c, rho0 = crs.cone()
    lon, lat = col(lon).cast("double"), col(lat).cast("double")
    rho = crs.radius * F.sqrt(c - n * _q_column(F.sin(F.radians(lat)), crs.e2)) / n
    theta = n * F.radians(lon - crs.lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers_lonlat(x: Column | str, y: Column | str, crs: Albers = Albers()) -> tuple[Column, Column]:
    """Easting and northing -> longitude and latitude in degrees; NULL where no latitude has such a northing.

    The series from the authalic latitude is followed by one Newton step on the
    equation of areas, which brings the error from millimetres to the
    last digits of a double.
    """
    n, c, rho0 = crs.cone()
    x, y = col(x).cast("double"), col(y).cast("double")
    up = F.lit(rho0) - y
    side = 1.0 if n > 0 else -1.0
    rho2 = x * x + up * up
    q = (c - rho2 * n * n / crs.radius**2) / n
    pole = crs._q(math.pi / 2)
    sine = q / pole
    beta = F.asin(F.when(F.abs(sine) <= 1, sine))
    lon = crs.lon0 + F.degrees(F.atan2(side * x, side * up) / n)
    if crs.e2 == 0:
        return lon, F.degrees(beta)
    a, b, d = crs.series()
    first = beta + a * F.sin(2 * beta) + b * F.sin(4 * beta) + d * F.sin(6 * beta)
    s = F.sin(first)
    flat = 1 - crs.e2 * s * s
    # dq / dlat = 2 (1 - e2) cos / flat^2; at a pole there is nothing to correct
    step = (q - _q_column(s, crs.e2)) * flat * flat / (2 * (1 - crs.e2) * F.cos(first))
    return lon, F.degrees(F.when(F.abs(sine) < 1 - 1e-12, first + step).otherwise(first))
