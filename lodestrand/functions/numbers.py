"""Numbers, distances and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth, metres. What counts as near, as simultaneous and as impossibly fast.
EARTH_M, NEAR_M, WINDOW_S, MAX_SPEED_MPS = 6_371_008.8, 1_000, 1_800, 55.0


def half_up(x: Column, places: int = 0) -> Column:
    """Rounded, halves towards positive infinity (``round`` takes them away from zero)."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5).cast("double") / scale if places else F.floor(x + 0.5).cast("long")


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in whole metres."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return half_up(2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds between two timestamps, halves up."""
    return half_up(F.abs(F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp"))) / 1000.0)


def implied_speed(metres: Column, seconds: Column) -> Column:
    """Metres a second; infinite if a distance takes no time, 0 if there is neither."""
    return F.when(seconds > 0, metres / seconds).when(metres > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """``part / whole``, or ``empty`` if there is no whole."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(part / whole)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
