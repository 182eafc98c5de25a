"""Sessions: maximal runs of events whose starts are at most a gap apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.config import DEFAULTS, Settings
from playtrace.functions import predicates as p

#: Event order within a listener: time, then the event's own number.
ORDER = ["ts_ms", "event_id"]


def sessionised(events: DataFrame, gap_minutes: int | None = None, by: str = "listener", s: Settings = DEFAULTS) -> DataFrame:
    """Events with ``session`` (from 0 for each listener): a new one starts after a silence longer than the gap."""
    gap = max(1, s.session_gap_minutes if gap_minutes is None else gap_minutes) * 60_000
    line = Window.partitionBy(by).orderBy(*ORDER)
    seen = p.visible(events, s)
    fresh = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(line) > gap).cast("int"), F.lit(0))
    return seen.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(line)).drop("fresh")


def by_session_window(events: DataFrame, gap_minutes: int, by: str = "listener") -> DataFrame:
    """The same sessions by Spark's own session windows, which don't sort a listener's events in one window."""
    ts = F.timestamp_millis("ts_ms")
    return events.groupBy(by, F.session_window(ts, f"{gap_minutes} minutes").alias("w")).agg(F.min("ts_ms").alias("start_ts"), F.max("ts_ms").alias("end_ts"), F.count(F.lit(1)).alias("events")).drop("w")


def across_listeners(events: DataFrame, gap_minutes: int | None = None, s: Settings = DEFAULTS, block_ms: int = 3_600_000) -> DataFrame:
    """(session, start_ts, end_ts, events, ms_played) of one stream of all events, sessions numbered from 0.

    Events are folded to their instants and joined to pieces within blocks of time, blocks side by side. The last window
    runs over pieces, whose number is bounded by the calendar (one for each gap or block of the time covered), not by events.
    """
    gap = max(1, s.session_gap_minutes if gap_minutes is None else gap_minutes) * 60_000
    instants = p.visible(events, s).groupBy("ts_ms").agg(F.count(F.lit(1)).alias("events"), F.sum("ms_played").alias("ms_played"))
    instants = instants.withColumn("block", F.floor(F.col("ts_ms") / block_ms))
    line = Window.partitionBy("block").orderBy("ts_ms")
    fresh = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(line) > gap).cast("int"), F.lit(0))
    parts = [F.min("ts_ms").alias("start_ts"), F.max("ts_ms").alias("end_ts"), F.sum("events").alias("events"), F.sum("ms_played").alias("ms_played")]
    pieces = instants.withColumn("fresh", fresh).withColumn("piece", F.sum("fresh").over(line)).groupBy("block", "piece").agg(*parts)
    order = Window.orderBy("start_ts")
    opens = F.coalesce((F.col("start_ts") - F.lag("end_ts").over(order) > gap).cast("int"), F.lit(0))
    numbered = pieces.withColumn("opens", opens).withColumn("session", F.sum("opens").over(order))
    return numbered.groupBy("session").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("events").alias("events"), F.sum("ms_played").alias("ms_played"))


def favourite(events: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value of each session, the one that came first among equals, with its count and the entropy."""
    counts = events.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("first"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    share = F.col("n") / total
    ranked = counts.withColumn("e", -share * F.log(share))
    best = F.min_by(column, F.struct((-F.col("n")).alias("n"), "first", column))
    entropy = F.when(F.count(F.lit(1)) > 1, F.least(F.greatest(F.sum("e") / F.log(F.count(F.lit(1)).cast("double")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return ranked.groupBy(*keys).agg(best.alias("top"), F.max("n").alias("repeats"), F.count(F.lit(1)).alias("kinds"), entropy.alias("diversity"))


def session_stats(events: DataFrame, gap_minutes: int | None = None, by: str = "listener", s: Settings = DEFAULTS) -> DataFrame:
    """One row per session. The duration is the span or the time played, whichever is longer."""
    rows, keys = sessionised(events, gap_minutes, by, s), [by, "session"]
    base = rows.groupBy(*keys).agg(
        F.min("ts_ms").alias("start_ts"), F.max("ts_ms").alias("end_ts"), F.sum("ms_played").alias("ms_played"), F.count(F.lit(1)).alias("events"), p.count_if(p.qualifying(s)).alias("q_plays"), F.min_by("local_date", F.struct(*ORDER)).alias("local_date"),
    )
    tracks = favourite(rows, keys, "track_id").select(*keys, F.col("top").alias("top_track"), F.col("repeats").alias("max_repeats"), F.col("kinds").alias("tracks"), "diversity")
    artists = favourite(rows, keys, "artist_id").select(*keys, F.col("top").alias("top_artist"), F.col("kinds").alias("artists"))
    return base.join(tracks, keys).join(artists, keys).withColumn("duration_ms", F.greatest(F.col("end_ts") - F.col("start_ts"), F.col("ms_played")))


def session_averages(sessions: DataFrame) -> DataFrame:
    """One row, zeros without a session."""
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.avg("events"), F.lit(0.0)).alias("mean_events"), F.coalesce(F.avg("ms_played"), F.lit(0.0)).alias("mean_ms"))


#: Orders of the session list, all descending; the session's start and number settle what is left.
SORTS = {
    "recent": ("start_ts",), "longest": ("ms_played",), "most": ("events",), "diverse": ("diversity", "artists"), "repetitive": ("max_repeats", "events"),
}


def session_list(sessions: DataFrame, sort: str, limit: int, offset: int = 0, by: str | None = "listener") -> DataFrame:
    """A page of sessions; ``by`` names the column within which sessions are numbered, and settles ties."""
    least = 6 if sort in ("diverse", "repetitive") else 2
    order = [F.desc(c) for c in SORTS[sort]]
    return sessions.filter(F.col("events") >= least).orderBy(*order, "start_ts", "session", *([by] if by else [])).offset(offset).limit(limit)
