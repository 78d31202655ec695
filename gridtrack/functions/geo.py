"""Geographic and physical column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0
GRAVITY = 9.81
OMEGA = 7.292115e-5


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres between two points in degrees."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def to_pm180(lon) -> Column:
    """lon in [-180, 180); what lies there stays as it is, to the last digit."""
    x = _col(lon)
    return F.when((x >= -180.0) & (x < 180.0), x.cast("double")).otherwise(F.pmod(x + 180.0, F.lit(360.0)) - 180.0)


def to_360(lon) -> Column:
    return F.pmod(_col(lon), F.lit(360.0))


def coriolis(lat) -> Column:
    return 2 * OMEGA * F.sin(F.radians(_col(lat)))


def magnitude(u, v) -> Column:
    return F.sqrt(_col(u) * _col(u) + _col(v) * _col(v))


def flux_magnitude(u, v, q) -> Column:
    return magnitude(_col(u) * _col(q), _col(v) * _col(q))


def geopotential_height(z) -> Column:
    return _col(z) / GRAVITY


def to_hpa(pa) -> Column:
    return _col(pa) / 100.0


def steps(hours: float, dt: float) -> int:
    """Whole steps in so many hours, cut off."""
    return int(hours / dt)
