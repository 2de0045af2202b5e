"""Scalar expressions: geodesy, angles, times, names. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
MERCATOR_M = 6378137.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def heading_change(now, before) -> Column:
    """min(|d|, 360 - |d|), not modulo; null if either is."""
    d = F.abs(_c(now) - _c(before))
    return F.when(d.isNotNull(), F.least(d, 360 - d))


def circular_variance(heading) -> Column:
    """1 - mean resultant length of headings modulo 360, an aggregate."""
    angle = F.radians(F.pmod(_c(heading), F.lit(360.0)))
    return 1 - F.sqrt(F.pow(F.avg(F.sin(angle)), 2) + F.pow(F.avg(F.cos(angle)), 2))


def mercator_x(lon) -> Column:
    return MERCATOR_M * F.radians(_c(lon))


def mercator_y(lat) -> Column:
    return MERCATOR_M * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(_c(lat)) / 2))


def clip(x, low: float | None = None, high: float | None = None) -> Column:
    """x kept in [low, high]; null stays null."""
    x = _c(x)
    if low is not None:
        x = F.when(x < low, F.lit(low)).otherwise(x)
    if high is not None:
        x = F.when(x > high, F.lit(high)).otherwise(x)
    return x


def micros(ts) -> Column:
    return F.unix_micros(_c(ts))


def seconds_between(end, start) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def minutes_between(end, start) -> Column:
    return (micros(end) - micros(start)) / F.lit(6e7)


def hours_between(end, start) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def overlap_minutes(start1, end1, start2, end2) -> Column:
    """Minutes that two intervals share; 0 if they only touch or not at all."""
    shared = F.least(micros(end1), micros(end2)) - F.greatest(micros(start1), micros(start2))
    return F.greatest(shared, F.lit(0)) / F.lit(6e7)


def overlaps(start1, end1, start2, end2) -> Column:
    """Whether two closed intervals meet."""
    return (_c(start1) <= _c(end2)) & (_c(start2) <= _c(end1))


def segment_id(mmsi, origin, window_minutes, index, start) -> Column:
    """{mmsi}_{yyyymmdd}_{w}min_{index:06d}_{yyyymmddTHHMMSSZ}"""
    return F.format_string("%d_%s_%dmin_%06d_%s", _c(mmsi), F.date_format(_c(origin), "yyyyMMdd"), _c(window_minutes), _c(index), F.date_format(_c(start), "yyyyMMdd'T'HHmmss'Z'"))


def iso(ts) -> Column:
    """ISO 8601 with +00:00, and a fraction only if there is one."""
    ts = _c(ts)
    return F.when(micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def human(n) -> Column:
    """1234567 as 1.2M, 1234 as 1.2K."""
    n = _c(n).cast("double")
    return F.when(n >= 1e6, F.format_string("%.1fM", n / 1e6)).when(n >= 1e3, F.format_string("%.1fK", n / 1e3)).otherwise(F.format_string("%.0f", n))


def ratio(a, b) -> Column:
    """a / b, or 0 where b is 0."""
    a, b = _c(a), _c(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def settled(x) -> Column:
    """A mean or sum to nine digits, for thresholds: one that meets them exactly does so in whatever order its parts were added."""
    return F.round(_c(x), 9)
