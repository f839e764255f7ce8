"""Sun position, in degrees, from UTC time and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_RAD, _DEG = math.pi / 180, 180 / math.pi


def _mod(x: Column, m: float = 360.0) -> Column:
    return F.pmod(x, F.lit(m))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp, with or without zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def sun_angles(ts: Column, longitude: Column) -> tuple[Column, Column]:
    """(declination, hour angle) in radians."""
    n = seconds(ts) / 86400.0 + 2440587.5 - 2451545
    zulu = F.hour(ts) + F.minute(ts) / 60
    anomaly = _mod(357.528 + 0.9856003 * n) * _RAD
    ecliptic = _mod(_mod(280.460 + 0.9856474 * n) + 1.915 * F.sin(anomaly) + 0.02 * F.sin(2 * anomaly)) * _RAD
    obliquity = (23.439 - 0.0000004 * n) * _RAD
    ascension = F.atan2(F.cos(obliquity) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(obliquity) * F.sin(ecliptic))
    sidereal = (6.697375 + 0.06570982441908 * n + 1.00273790935 * zulu) * 15
    angle = _mod(sidereal + longitude) * _RAD - ascension
    angle = F.when(angle < -math.pi, angle + 2 * math.pi).when(angle > math.pi, angle - 2 * math.pi).otherwise(angle)
    return declination, angle


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def elevation_radians(declination: Column, angle: Column, latitude: Column) -> Column:
    lat = latitude * _RAD
    return F.asin(_unit(F.sin(declination) * F.sin(lat) + F.cos(declination) * F.cos(lat) * F.cos(angle)))


def elevation(ts: Column, latitude: Column, longitude: Column) -> Column:
    return elevation_radians(*sun_angles(ts, longitude), latitude) * _DEG


def apparent_elevation(ts: Column, latitude: Column, longitude: Column) -> Column:
    """Elevation with atmospheric refraction, at most 90."""
    e = elevation(ts, latitude, longitude)
    bend = 3.51561 * (0.1594 + 0.0196 * e + 0.00002 * e * e) / (1 + 0.505 * e + 0.0845 * e * e)
    return F.least(e + F.when(e < -0.56, 0.56).otherwise(bend), F.lit(90.0))


def zenith(ts: Column, latitude: Column, longitude: Column) -> Column:
    return 90.0 - apparent_elevation(ts, latitude, longitude)


def azimuth(ts: Column, latitude: Column, longitude: Column) -> Column:
    """180 straight above or below; 0 and 180 where rounding leaves the range of the arc cosine."""
    declination, angle = sun_angles(ts, longitude)
    e, lat = elevation_radians(declination, angle, latitude), latitude * _RAD
    below = F.cos(e) * F.cos(lat)
    x = F.try_divide(F.sin(e) * F.sin(lat) - F.sin(declination), below)
    return F.when(x > 1, 0.0).when(x < -1, 180.0).when((F.cos(e) == 0) | x.isNull(), 180.0).otherwise(F.acos(_unit(x)) * _DEG)


def sun_position(ts: Column, latitude: Column, longitude: Column) -> Column:
    """All four outputs as one struct."""
    return F.struct(
        azimuth(ts, latitude, longitude).alias("azimuth"),
        elevation(ts, latitude, longitude).alias("elevation"),
        apparent_elevation(ts, latitude, longitude).alias("apparent_elevation"),
        zenith(ts, latitude, longitude).alias("zenith"),
    )
