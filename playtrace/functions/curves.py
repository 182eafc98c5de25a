"""Scoring curves as column expressions; none can divide by zero or leave [0, 1] unless it says so."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def log_scale(x: Column, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``, logarithmic between; 0 everywhere if the bounds are not in order."""
    if high <= low:
        return F.lit(0.0)
    return clamp01((F.log1p(F.greatest(x.cast("double"), F.lit(0.0))) - math.log1p(low)) / (math.log1p(high) - math.log1p(low)))


def dormancy(days: Column, full: float = 2920.0) -> Column:
    """0 up to day 0, 1 from eight years on."""
    return F.when(days <= 0, 0.0).otherwise(clamp01(F.log1p(days / 30.0) / math.log1p(full / 30.0)))


def tenths(x: Column) -> Column:
    """Rounded half up to one decimal."""
    return F.floor(x * 10 + 0.5) / 10


def rounded(x: Column, digits: int = 6) -> Column:
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def intensity(window_plays: Column, lifetime_plays: Column, window_days: int) -> Column:
    share = clamp01(ratio(window_plays, lifetime_plays))
    density = clamp01(window_plays / max(1, window_days) / 6)
    return tenths(100 * (0.42 * share + 0.36 * log_scale(window_plays, 5, 150) + 0.22 * density))


def graveyard(plays: Column, days_missing: Column, rank: Column, floor: int) -> Column:
    prominence = F.when(rank.isNull(), 0.35).otherwise(clamp01(1 - F.log1p(rank.cast("double") - 1) / math.log1p(50)))
    return tenths(100 * (0.46 * log_scale(plays, floor, floor * 12) + 0.36 * dormancy(days_missing) + 0.18 * prominence))
