"""Ellipsoid and sphere geometry as columns; angles in radians, lengths in metres."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Semi-major axis and flattening of GRS80, and the reference radius and GM of coefficient fields.
A, FLATTENING = 6378137.0, 1 / 298.257222101
R, GM = 6378136.3, 3.986004415e14


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def eccentricity2(f: float = FLATTENING) -> float:
    return 2 * f - f * f


def geodetic_to_cartesian(lon, lat, h=0.0, a: float = A, f: float = FLATTENING) -> tuple[Column, Column, Column]:
    lon, lat, h, e2 = _c(lon), _c(lat), _c(h), eccentricity2(f)
    normal = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (normal + h) * F.cos(lat) * F.cos(lon), (normal + h) * F.cos(lat) * F.sin(lon), (normal * (1 - e2) + h) * F.sin(lat)


def geocentric_radius(lat, a: float = A, f: float = FLATTENING) -> Column:
    x, _, z = geodetic_to_cartesian(0.0, lat, 0.0, a, f)
    return F.sqrt(x * x + z * z)


def colatitude(lat, a: float = A, f: float = FLATTENING) -> Column:
    x, _, z = geodetic_to_cartesian(0.0, lat, 0.0, a, f)
    return F.atan2(x, z)


def geodetic_to_geocentric(lat, f: float = FLATTENING) -> Column:
    return F.atan2((1 - eccentricity2(f)) * F.sin(_c(lat)), F.cos(_c(lat)))


def geocentric_to_geodetic(beta, f: float = FLATTENING) -> Column:
    return F.atan2(F.sin(_c(beta)), (1 - eccentricity2(f)) * F.cos(_c(beta)))


def spherical_to_cartesian(r, colat, lon) -> tuple[Column, Column, Column]:
    r, colat, lon = _c(r), _c(colat), _c(lon)
    return r * F.sin(colat) * F.cos(lon), r * F.sin(colat) * F.sin(lon), r * F.cos(colat)


def cartesian_to_spherical(x, y, z) -> tuple[Column, Column, Column]:
    x, y, z = _c(x), _c(y), _c(z)
    flat = F.sqrt(x * x + y * y)
    return F.sqrt(x * x + y * y + z * z), F.atan2(flat, z), F.atan2(y, x)


def spherical_distance(lon1, lat1, lon2, lat2, r: float = R) -> Column:
    """By the arctangent of sine and cosine, accurate for near and antipodal points."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    d = lon2 - lon1
    east = F.cos(lat2) * F.sin(d)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d)
    return r * F.atan2(F.sqrt(east * east + north * north), F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(d))


#: Series from authalic and conformal to geodetic latitude. Row k holds the factors of sin(2 k beta),
#: by rising powers of the squared eccentricity, the first of them the k-th.
AUTHALIC_SERIES = (
    (1 / 3, 31 / 180, 517 / 5040, 120389 / 181400, 1362254 / 29937600),
    (23 / 360, 251 / 3780, 102287 / 1814400, 450739 / 997920),
    (761 / 45360, 47561 / 1814400, 434501 / 14968800),
    (6059 / 1209600, 625511 / 59875200),
    (48017 / 29937600,),
)
CONFORMAL_SERIES = (
    (1 / 2, 5 / 24, 1 / 12, 13 / 360),
    (7 / 48, 29 / 240, 811 / 11520),
    (7 / 120, 81 / 1120),
    (4279 / 161280,),
)


def _from_series(series, beta, f: float) -> Column:
    beta, e2 = _c(beta), eccentricity2(f)
    total = beta
    for k, row in enumerate(series, 1):
        total = total + sum(c * e2 ** (k + j) for j, c in enumerate(row)) * F.sin(2 * k * beta)
    return total


def _zone(sine, e: float):
    """Area of the zone from the equator to a latitude, in units of half the squared semi-major axis times 2 pi."""
    log = F.log if isinstance(sine, Column) else math.log
    return (1 - e * e) * (sine / (1 - e * e * sine * sine) + log((1 + e * sine) / (1 - e * sine)) / (2 * e))


def authalic_radius(a: float = A, f: float = FLATTENING) -> float:
    """Radius of the sphere with the ellipsoid's surface; a for a sphere."""
    return a * math.sqrt(_zone(1.0, math.sqrt(eccentricity2(f))) / 2) if f else a


def geodetic_to_authalic(lat, f: float = FLATTENING) -> Column:
    if not f:
        return _c(lat)
    e = math.sqrt(eccentricity2(f))
    return F.asin(_zone(F.sin(_c(lat)), e) / _zone(1.0, e))


def authalic_to_geodetic(beta, f: float = FLATTENING) -> Column:
    return _from_series(AUTHALIC_SERIES, beta, f)


def geodetic_to_conformal(lat, f: float = FLATTENING) -> Column:
    lat, e = _c(lat), math.sqrt(eccentricity2(f))
    stretch = F.pow((1 - e * F.sin(lat)) / (1 + e * F.sin(lat)), F.lit(e / 2))
    return 2 * F.atan(F.tan(lat / 2 + math.pi / 4) * stretch) - math.pi / 2


def conformal_to_geodetic(beta, f: float = FLATTENING) -> Column:
    return _from_series(CONFORMAL_SERIES, beta, f)


#: Latitude on the sphere to geodetic latitude, by the name of the mapping.
LATITUDE_MAPPINGS = {"authalic": authalic_to_geodetic, "geocentric": geocentric_to_geodetic, "conformal": conformal_to_geodetic}


def mapped_latitude(lat, mapping: str, f: float = FLATTENING) -> Column:
    if mapping.lower() not in LATITUDE_MAPPINGS:
        raise ValueError(f"no latitude mapping {mapping}")
    return LATITUDE_MAPPINGS[mapping.lower()](lat, f)


def cartesian_to_geodetic(x, y, z, a: float = A, f: float = FLATTENING, steps: int = 6) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height: a fixed number of steps over the reduced latitude, each row on its own."""
    x, y, z, e2 = _c(x), _c(y), _c(z), eccentricity2(f)
    flat = F.sqrt(x * x + y * y)

    def step(lat, _):
        reduced = F.atan2((1 - f) * F.sin(lat), F.cos(lat))
        s, c = F.sin(reduced), F.cos(reduced)
        return F.atan2(z + e2 / (1 - f) * a * s * s * s, flat - e2 * a * c * c * c)

    lat = F.aggregate(F.array_repeat(F.lit(0), steps), F.atan2(z, (1 - e2) * flat), step)
    return F.atan2(y, x), lat, flat * F.cos(lat) + z * F.sin(lat) - a * F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


class ReferenceField:
    """Level ellipsoid from GM, rotation rate, semi-major axis and either flattening or J2: its zonal terms and gravity."""

    def __init__(self, gm: float, omega: float, a: float, f: float | None = None, j2: float | None = None):
        if (f is None) == (j2 is None):
            raise ValueError("give either the flattening or J2")
        self.gm, self.omega, self.a = gm, omega, a
        self._rate = 4 / 15 * omega**2 * a**3 / gm
        e2 = eccentricity2(f) if f is not None else self._squared_eccentricity(j2)
        self.f = 1 - math.sqrt(1 - e2) if f is None else f
        self.j2 = (e2 - self._rotation(e2)) / 3 if j2 is None else j2
        terms = np.arange(1, 21)
        signs, powers = np.where(terms % 2, -1.0, 1.0), e2**terms
        zonals = signs * 3 * powers / ((2 * terms + 1) * (2 * terms + 3)) * (1 - terms + 5 * terms * self.j2 / e2) / np.sqrt(4 * terms + 1)
        self.zonals = [1.0, *zonals[np.abs(zonals) > np.finfo(float).eps * abs(zonals[0])].tolist()]

    def _rotation(self, e2: float) -> float:
        """What the rotation takes from the squared eccentricity in 3 J2.

        The potential's q0 is the arctangent's remainder; as an integral over the unit interval nothing cancels.
        """
        second = math.sqrt(e2 / (1 - e2))
        t, w = (1 + _NODES) / 2, _WEIGHTS / 2
        twice_q0 = second**3 * float(np.sum(w * (3 * t * t - 1) * t * t / (1 + (second * t) ** 2)))
        return self._rate * e2**1.5 / twice_q0

    def _squared_eccentricity(self, j2: float) -> float:
        """Secant steps from the spherical approximation."""
        before, now = 3 * j2, 3 * j2 + self._rate * 15 / 4
        miss = [x - self._rotation(x) - 3 * j2 for x in (before, now)]
        for _ in range(50):  # far more than it takes
            if now == before or miss[1] == miss[0]:
                break
            before, now = now, now - miss[1] * (now - before) / (miss[1] - miss[0])
            miss = [miss[1], now - self._rotation(now) - 3 * j2]
        return now

    def coefficients(self, spark) -> DataFrame:
        """Rows (n, m, trig, value) of the even zonal terms."""
        return spark.createDataFrame([(2 * k, 0, 0, v) for k, v in enumerate(self.zonals)], "n int, m int, trig int, value double")

    def normal_gravity(self, r, colat) -> Column:
        """Attraction and centrifugal acceleration along the ellipsoid's inner normal, in m/s^2."""
        r, colat = _c(r), _c(colat)
        t, ratio = F.cos(colat), F.lit(self.a) / r
        down, south = F.lit(0.0), F.lit(0.0)
        for k, v in enumerate(self.zonals):
            n = 2 * k
            p = legendre_series([0.0] * n + [1.0])
            scale = v * math.sqrt(2 * n + 1) * F.pow(ratio, F.lit(float(n)))
            down = down + (n + 1) * scale * horner(p.coef, t)
            south = south - scale * F.sin(colat) * horner(p.deriv().coef, t)
        pull = self.gm / (r * r)
        x, z = r * F.sin(colat), r * t
        gx = pull * (south * t - down * F.sin(colat)) + self.omega**2 * x
        gz = pull * (-south * F.sin(colat) - down * t)
        _, lat, _ = cartesian_to_geodetic(x, F.lit(0.0), z, self.a, self.f)
        return -F.cos(lat) * gx - F.sin(lat) * gz


def legendre_series(coefficients) -> np.polynomial.Polynomial:
    """The power series of a sum of Legendre polynomials."""
    return np.polynomial.Legendre(coefficients).convert(kind=np.polynomial.Polynomial)


def horner(coefficients, t: Column) -> Column:
    total = F.lit(float(coefficients[-1]))
    for c in coefficients[-2::-1]:
        total = total * t + float(c)
    return total


#: The constants of the two geodetic reference systems.
GRS80 = ReferenceField(gm=3986005e8, omega=7292115e-11, a=6378137.0, j2=108263e-8)
WGS84 = ReferenceField(gm=3986004.418e8, omega=7292115e-11, a=6378137.0, f=1 / 298.257223563)
