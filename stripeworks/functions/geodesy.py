"""WGS-84 geodesy as Columns: ellipsoidal and Cartesian coordinates, local frames, UTM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linear import Mat, Vec, apply, sub, transpose

#: Fixed values of the ellipsoid.
A, INVERSE_F = 6378137.0, 298.257223563
FLATTENING = 1 / INVERSE_F
E2 = FLATTENING * (2 - FLATTENING)
INVALID = -999.0


def ell_to_xyz(lat: Column, lon: Column, h: Column) -> Vec:
    """Radians and metres to ECEF metres."""
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(lat), 2.0))
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + h) * F.sin(lat)


def geodetic_latitude(x: Column, y: Column, z: Column, steps: int = 6) -> Column:
    """Fixed-point iteration on the latitude, folded so that the expression stays one step long."""
    p = F.sqrt(x * x + y * y)
    start = F.atan2(z, p * (1 - E2))

    def step(lat: Column, _: Column) -> Column:
        s = F.sin(lat)
        return F.atan2(z + E2 * (A / F.sqrt(1 - E2 * s * s)) * s, p)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def longitude(x: Column, y: Column) -> Column:
    """In [0, 2 pi)."""
    lon = F.atan2(y, x)
    return F.when(lon < 0, lon + 2 * math.pi).otherwise(lon)


def height(x: Column, y: Column, z: Column, lat: Column) -> Column:
    """Well-conditioned everywhere: along the normal at ``lat``."""
    s = F.sin(lat)
    return F.sqrt(x * x + y * y) * F.cos(lat) + z * s - A * F.sqrt(1 - E2 * s * s)


def xyz_to_ell(x: Column, y: Column, z: Column, steps: int = 6) -> Vec:
    """ECEF to (lat, lon, h); on the polar axis all three are ``INVALID``."""
    lat = geodetic_latitude(x, y, z, steps)
    off = F.sqrt(x * x + y * y) < 1e-10
    return tuple(F.when(off, F.lit(INVALID)).otherwise(v) for v in (lat, longitude(x, y), height(x, y, z, lat)))


def enu_rotation(lat: Column, lon: Column) -> Mat:
    """Rows east, north, up: ECEF differences to the local frame."""
    sa, ca, so, co = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    return [-so, co, F.lit(0.0), -sa * co, -sa * so, ca, ca * co, ca * so, sa]


def enu_rotation_at(xyz: Vec) -> Mat:
    return enu_rotation(geodetic_latitude(*xyz), F.atan2(xyz[1], xyz[0]))


def xyz_to_enu(xyz: Vec, ref: Vec, rotation: Mat) -> Vec:
    return apply(rotation, sub(xyz, ref))


def enu_to_xyz(enu: Vec, ref: Vec, rotation: Mat) -> Vec:
    d = apply(transpose(rotation), enu)
    return tuple(r + x for r, x in zip(ref, d))


def rereference(enu: Vec, ref0: Vec, rotation0: Mat, ref1: Vec, rotation1: Mat) -> Vec:
    """A local position about one origin, taken to the local frame of another."""
    d = apply(transpose(rotation0), enu)
    return apply(rotation1, tuple(v + (a - b) for v, a, b in zip(d, ref0, ref1)))


def xyz_to_neu(xyz: Vec, ref: Vec, rotation: Mat) -> Vec:
    e, n, u = xyz_to_enu(xyz, ref, rotation)
    return n, e, u


def utm_zone(lat_deg: Column, lon_deg: Column) -> Column:
    """Zone number, with the exceptions of south-west Norway and Svalbard."""
    lon = F.pmod(lon_deg + 180, F.lit(360.0)) - 180
    plain = F.floor((lon + 180) / 6).cast("int") + 1
    svalbard = F.when((lon >= 0) & (lon < 9), 31).when((lon >= 9) & (lon < 21), 33).when((lon >= 21) & (lon < 33), 35).when((lon >= 33) & (lon < 42), 37).otherwise(plain)
    return F.when((lat_deg >= 56) & (lat_deg < 64) & (lon >= 3) & (lon < 12), 32).when((lat_deg >= 72) & (lat_deg < 84), svalbard).otherwise(plain)


def utm_letter(lat_deg: Column) -> Column:
    """Latitude band C to X, eight degrees each (X twelve); outside: Z."""
    bands = "CDEFGHJKLMNPQRSTUVWX"
    at = F.least(F.floor((lat_deg + 80) / 8).cast("int"), F.lit(19)) + 1
    return F.when((lat_deg < -80) | (lat_deg > 84), F.lit("Z")).otherwise(F.substring(F.lit(bands), at, F.lit(1)))


_K0 = 0.9996
_EP2 = E2 / (1 - E2)
_M = (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024, 15 * E2**2 / 256 + 45 * E2**3 / 1024, 35 * E2**3 / 3072)


def utm_forward(lat_deg: Column, lon_deg: Column) -> tuple[Column, Column, Column]:
    """(easting, northing, zone), by the usual series; 10 000 km are added in the south."""
    zone = utm_zone(lat_deg, lon_deg)
    lat = F.radians(lat_deg)
    lon = F.radians(F.pmod(lon_deg + 180, F.lit(360.0)) - 180 - ((zone - 1) * 6 - 177))
    s, c, t = F.sin(lat), F.cos(lat), F.pow(F.tan(lat), 2.0)
    n, k, a = A / F.sqrt(1 - E2 * s * s), _EP2 * c * c, c * lon
    m = A * (_M[0] * lat - _M[1] * F.sin(2 * lat) + _M[2] * F.sin(4 * lat) - _M[3] * F.sin(6 * lat))
    east = _K0 * n * (a + (1 - t + k) * F.pow(a, 3.0) / 6 + (5 - 18 * t + t * t + 72 * k - 58 * _EP2) * F.pow(a, 5.0) / 120) + 500000
    north = _K0 * (m + n * F.tan(lat) * (a * a / 2 + (5 - t + 9 * k + 4 * k * k) * F.pow(a, 4.0) / 24 + (61 - 58 * t + t * t + 600 * k - 330 * _EP2) * F.pow(a, 6.0) / 720))
    return east, F.when(lat_deg < 0, north + 10000000).otherwise(north), zone


def utm_inverse(east: Column, north: Column, zone: Column, southern: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    x, y = east - 500000, F.when(southern, north - 10000000).otherwise(north)
    mu = y / _K0 / (A * _M[0])
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu)
    s, c, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n, t, k = A / F.sqrt(1 - E2 * s * s), tan * tan, _EP2 * c * c
    r, d = A * (1 - E2) / F.pow(1 - E2 * s * s, 1.5), x / (n * _K0)
    lat = phi - n * tan / r * (d * d / 2 - (5 + 3 * t + 10 * k - 4 * k * k - 9 * _EP2) * F.pow(d, 4.0) / 24 + (61 + 90 * t + 298 * k + 45 * t * t - 252 * _EP2 - 3 * k * k) * F.pow(d, 6.0) / 720)
    lon = (d - (1 + 2 * t + k) * F.pow(d, 3.0) / 6 + (5 - 2 * k + 28 * t - 3 * k * k + 8 * _EP2 + 24 * t * t) * F.pow(d, 5.0) / 120) / c
    return F.degrees(lat), F.degrees(lon) + (zone - 1) * 6 - 177
