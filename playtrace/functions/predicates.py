"""Flags of single events, shared by all rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.config import DAY_MS, DEFAULTS, Settings


def qualifying(s: Settings = DEFAULTS) -> Column:
    return F.col("ms_played") >= max(0, int(s.qualifying_ms))


def skip(s: Settings = DEFAULTS) -> Column:
    """1 or 0: flagged as skipped, or short and ended by hand; unknown counts as 0."""
    by_hand = (F.col("ms_played") < s.skip_ms) & F.col("reason_end").isin(*s.skip_reasons)
    return F.when(F.col("skipped") | by_hand, 1).otherwise(0)


def night() -> Column:
    return (F.col("hour") >= 22) | (F.col("hour") < 5)


def recent(now: int, s: Settings = DEFAULTS) -> Column:
    return (F.col("ts_ms") >= now - s.recent_days * DAY_MS) & qualifying(s)


def visible(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The events that rollups see: all, or those outside private sessions."""
    return events if s.include_private else events.filter(~F.col("incognito"))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")
