"""The sun over a place, by the low-precision formulas of astronomical almanacs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The campus, and the elevations between which light counts as golden.
LATITUDE, LONGITUDE = 33.9737, -117.3281
GOLDEN = (-4.0, 6.0)

# Degrees (sidereal time: hours) at noon of 2000-01-01 UTC, and per day since.
MEAN_ANOMALY = (357.529, 0.98560028)
MEAN_LONGITUDE = (280.459, 0.98564736)
TILT = (23.439, -0.00000036)
SIDEREAL_HOURS = (18.697374558, 24.06570982441908)
CENTRE = (1.915, 0.02)
_NOON_2000 = 946_728_000


def solar_elevation(ts: Column, latitude: float = LATITUDE, longitude: float = LONGITUDE) -> Column:
    """Degrees of the sun above the horizon at a UTC timestamp_ntz; null stays null."""
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    days = (F.timestamp_diff("MICROSECOND", epoch, ts) / F.lit(1e6) - F.lit(float(_NOON_2000))) / F.lit(86400.0)
    after = lambda start_rate: F.lit(start_rate[0]) + F.lit(start_rate[1]) * days
    anomaly = F.radians(after(MEAN_ANOMALY))
    ecliptic = F.radians(after(MEAN_LONGITUDE) + F.lit(CENTRE[0]) * F.sin(anomaly) + F.lit(CENTRE[1]) * F.sin(2 * anomaly))
    tilt = F.radians(after(TILT))
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    hour_angle = F.radians(after(SIDEREAL_HOURS) * F.lit(15.0) + F.lit(longitude)) - ascension
    north = F.radians(F.lit(latitude))
    return F.degrees(F.asin(F.sin(north) * F.sin(declination) + F.cos(north) * F.cos(declination) * F.cos(hour_angle)))


def daypart(elevation: Column) -> Column:
    """day, golden or night."""
    return F.when(elevation > GOLDEN[1], "day").when(elevation > GOLDEN[0], "golden").when(elevation.isNotNull(), "night")
