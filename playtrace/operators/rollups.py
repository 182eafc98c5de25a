"""Rollups of the event table: one hash aggregation each, on visible events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.config import DEFAULTS, Settings
from playtrace.functions import predicates as p
from playtrace.functions.curves import ratio

#: The column that names an entity of each kind.
KEYS = {"track": "track_id", "artist": "artist_id", "album": "album_id"}

#: Rows that a task groups or sorts, about: what it holds stays the same on any input and with any number of shuffle partitions.
TASK_ROWS = 1 << 18


def tasks_of(rows: DataFrame, most: int | None = None) -> int:
    return max(1, -(-rows.count() // (most or TASK_ROWS)))


def _q(s: Settings):
    return p.count_if(p.qualifying(s)).alias("q_plays")


def _plays():
    return F.count(F.lit(1)).alias("plays")


def _ms():
    return F.sum("ms_played").alias("ms_played")


def track_stats(events: DataFrame, now: int, s: Settings = DEFAULTS) -> DataFrame:
    """Folded to a track's dates first, so that days are counted as rows and only one distinct count remains."""
    dates = p.visible(events, s).groupBy("track_id", "local_date", "ym").agg(
        _plays(), _q(s), p.count_if(~p.qualifying(s)).alias("short_plays"), F.sum(p.skip(s)).alias("skips"), _ms(), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), p.count_if(p.recent(now, s)).alias("recent_plays"),
    )
    return dates.groupBy("track_id").agg(
        *[F.sum(c).alias(c) for c in ("plays", "q_plays", "short_plays", "skips", "ms_played")], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.count("local_date").alias("distinct_days"), F.countDistinct("ym").alias("active_months"), F.sum("recent_plays").alias("recent_plays"),
    )


def artist_stats(events: DataFrame, now: int, s: Settings = DEFAULTS) -> DataFrame:
    return p.visible(events, s).groupBy("artist_id").agg(
        _plays(), _q(s), F.sum(p.skip(s)).alias("skips"), _ms(), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.countDistinct("track_id").alias("tracks"),
        F.countDistinct("album_id").alias("albums"), F.countDistinct("local_date").alias("distinct_days"), p.count_if(p.recent(now, s)).alias("recent_plays"), p.count_if(p.night()).alias("night_plays"),
    )


def album_stats(events: DataFrame, now: int, s: Settings = DEFAULTS) -> DataFrame:
    return p.visible(events, s).filter(F.col("album_id").isNotNull()).groupBy("album_id").agg(
        _plays(), _q(s), F.sum(p.skip(s)).alias("skips"), _ms(), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.countDistinct("track_id").alias("tracks"), p.count_if(p.recent(now, s)).alias("recent_plays"),
    )


def stats(events: DataFrame, kind: str, now: int, s: Settings = DEFAULTS) -> DataFrame:
    return {"track": track_stats, "artist": artist_stats, "album": album_stats}[kind](events, now, s)


def monthly(events: DataFrame, kind: str, s: Settings = DEFAULTS) -> DataFrame:
    return p.visible(events, s).filter(F.col(KEYS[kind]).isNotNull()).groupBy(KEYS[kind], "ym").agg(_plays(), _q(s), _ms())


def daily(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return p.visible(events, s).groupBy("local_date").agg(
        _plays(), _q(s), _ms(), F.countDistinct("track_id").alias("tracks"), F.countDistinct("artist_id").alias("artists"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts")
    )


def hourly(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return p.visible(events, s).groupBy("hour", "dow").agg(_plays(), _ms())


def yearly(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return p.visible(events, s).groupBy("year").agg(
        _plays(), _q(s), _ms(), F.countDistinct("track_id").alias("tracks"), F.countDistinct("artist_id").alias("artists"), F.countDistinct("album_id").alias("albums"), F.countDistinct("local_date").alias("distinct_days")
    )


def album_breadth(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Share of an album's tracks with three qualifying plays, and the three most played tracks' share of its plays."""
    per_track = p.visible(events, s).filter(F.col("album_id").isNotNull()).groupBy("album_id", "track_id").agg(_q(s))
    ranked = per_track.withColumn("rn", F.row_number().over(Window.partitionBy("album_id").orderBy(F.desc("q_plays"), "track_id")))
    return ranked.groupBy("album_id").agg(
        (p.count_if(F.col("q_plays") >= 3) / F.count(F.lit(1))).alias("breadth"),
        (F.sum(F.when(F.col("rn") <= 3, F.col("q_plays")).otherwise(0)) / F.greatest(F.sum("q_plays"), F.lit(1))).alias("top3_share"),
    )


def yearly_from_monthly(months: DataFrame) -> DataFrame:
    """Yearly totals from a monthly rollup, without another scan of the events."""
    return months.groupBy(F.substring("ym", 1, 4).cast("int").alias("year")).agg(F.sum("plays").alias("plays"), F.sum("q_plays").alias("q_plays"), F.sum("ms_played").alias("ms_played"))


def dense_hours(events: DataFrame) -> DataFrame:
    """24 rows, hours without plays included; private plays count, as in every point query."""
    seen = events.groupBy("hour").agg(_plays(), _ms())
    return events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(F.broadcast(seen), "hour", "left").select("hour", F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("ms_played", F.lit(0)).alias("ms_played"))


def lifetime(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row. Streams counts all events, also private ones, and is what skips are divided by."""
    seen = s.include_private | ~F.col("incognito") if not s.include_private else F.lit(True)

    def visible(x):
        return F.when(seen, x)

    return events.agg(
        F.count(F.lit(1)).alias("streams"), p.count_if(seen & p.qualifying(s)).alias("q_plays"), F.sum(visible(F.col("ms_played"))).alias("ms_played"), F.countDistinct(visible(F.col("track_id"))).alias("tracks"),
        F.countDistinct(visible(F.col("artist_id"))).alias("artists"), F.countDistinct(visible(F.col("album_id"))).alias("albums"), F.countDistinct(visible(F.col("local_date"))).alias("active_days"),
        F.min(visible(F.col("ts_ms"))).alias("first_ts"), F.max(visible(F.col("ts_ms"))).alias("last_ts"), F.sum(visible(p.skip(s))).alias("skips"),
    ).withColumn("skip_rate", ratio(F.col("skips"), F.col("streams")))


def dayparts(hours: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Plays and share of each part of the day, from the hourly rollup."""
    name = None
    for part, low, high in s.dayparts:
        hit = (F.col("hour") >= low) & (F.col("hour") < high)
        name = F.when(hit, part) if name is None else name.when(hit, part)
    parts = hours.groupBy(name.alias("part")).agg(F.sum("plays").alias("plays"), F.sum("ms_played").alias("ms_played"))
    total = F.sum("plays").over(Window.partitionBy())
    return parts.withColumn("share", ratio(F.col("plays"), total))


def clock(hours: DataFrame) -> DataFrame:
    """One row: weekday and weekend plays, the first of the busiest hours, the share after midnight."""
    by_hour = hours.groupBy("hour").agg(F.sum("plays").alias("plays"), F.sum(F.when(F.col("dow").isin(0, 6), F.col("plays")).otherwise(0)).alias("weekend"))
    return by_hour.agg(
        F.sum("plays").alias("plays"), F.sum("weekend").alias("weekend_plays"), (F.sum("plays") - F.sum("weekend")).alias("weekday_plays"), F.max_by("hour", F.struct("plays", -F.col("hour"))).alias("peak_hour"),
        ratio(F.sum(F.when(F.col("hour") < 5, F.col("plays")).otherwise(0)), F.sum("plays")).alias("after_midnight_share"),
    )


def month_totals(events: DataFrame, ym: str, s: Settings = DEFAULTS) -> DataFrame:
    return events.filter(F.col("ym") == ym).agg(_plays(), _q(s), _ms(), F.countDistinct("track_id").alias("tracks"), F.countDistinct("artist_id").alias("artists"))


def joined_names(df: DataFrame, key: str, name: str, separator: str = " | ") -> DataFrame:
    """The names of each key in order, joined by a separator."""
    return df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(name)), separator).alias("names"))
