"""The personal layer: small tables of tags, flags, notes and settings. Each change is a function from the old table to the new."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.curves import ratio
from playtrace.operators.rules import STARTERS

#: Tags that a new archive starts with: (name, icon, colour). Fixed values.
DEFAULT_TAGS = (
    ("Love", "Heart", "#B4685E"), ("All-Time Favourite", "Star", "#D6B06A"), ("Nostalgia", "Hourglass", "#96768F"), ("Night", "Moon", "#7C8BA3"),
    ("Workout", "Flame", "#C08F72"), ("Driving", "Car", "#8CA595"), ("Production Reference", "SlidersHorizontal", "#7E9384"), ("Retired", "Archive", "#6E6961"),
)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in the place of those with equal keys. Both are small."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def removed(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def seeded(old: DataFrame) -> DataFrame:
    """The starting tags, if there are none."""
    return old if not old.isEmpty() else old.sparkSession.createDataFrame([(i + 1, *t) for i, t in enumerate(DEFAULT_TAGS)], old.schema)


def seeded_collections(old: DataFrame) -> DataFrame:
    """The starting collections as (name, description, match, rules), if there are none; ``rules`` is JSON."""
    if not old.isEmpty():
        return old
    rows = [(name, about, match, json.dumps([vars(r) for r in held])) for name, about, match, held in STARTERS]
    return old.sparkSession.createDataFrame(rows, old.schema)


def tag_usage(tags: DataFrame, track_tags: DataFrame) -> DataFrame:
    used = track_tags.groupBy("tag_id").agg(F.countDistinct("track_id").alias("uses"))
    return tags.join(used, "tag_id", "left").fillna(0, ["uses"])


def track_summaries(tracks: DataFrame, artists: DataFrame, albums: DataFrame, stats: DataFrame) -> DataFrame:
    """Tracks with their artist, their album if known and their numbers, zero for tracks without plays."""
    rows = tracks.join(artists.select("artist_id", F.col("name").alias("artist")), "artist_id").join(albums.select("album_id", F.col("name").alias("album")), "album_id", "left").join(stats, "track_id", "left")
    return rows.fillna(0, ["plays", "q_plays", "skips", "ms_played"]).withColumn("skip_rate", ratio(F.col("skips"), F.col("plays")))


def with_fallback_uri(parents: DataFrame, key: str, tracks: DataFrame) -> DataFrame:
    """Artists or albums whose missing URI is that of their most played track."""
    best = tracks.filter("uri IS NOT NULL").groupBy(key).agg(F.max_by("uri", F.struct("q_plays", -F.col("track_id"))).alias("track_uri"))
    return parents.join(best, key, "left").withColumn("uri", F.coalesce("uri", "track_uri")).drop("track_uri")


def entities(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """(kind, id, name, secondary, uri) of all kinds, for notes and pages that refer to any."""
    parts = []
    for kind, df in kinds:
        has = set(df.columns)
        parts.append(df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name", *[(F.col(c) if c in has else F.lit(None)).cast("string").alias(c) for c in ("secondary", "uri")]))
    return reduce(DataFrame.unionByName, parts)


def notes_with_subjects(notes: DataFrame, subjects: DataFrame) -> DataFrame:
    return notes.join(subjects, ["kind", "id"], "left").orderBy(F.desc("updated_ts"), "kind", "id")


STATUSES = ("any", "favorite", "retired", "tagged", "untagged")


def listed(tracks: DataFrame, flags: DataFrame, track_tags: DataFrame, text: str = "", status: str = "any", tag: int | None = None, sort: str = "name", descending: bool = False) -> DataFrame:
    """The library page: filters by text, status and tag; names sort without regard to case, ids break ties."""
    rows = tracks.join(flags, "track_id", "left")
    if text:
        rows = rows.filter(F.col("name").ilike(f"%{text}%") | F.col("artist").ilike(f"%{text}%"))
    if status in ("favorite", "retired"):
        rows = rows.filter(F.coalesce(F.col(status).cast("int"), F.lit(0)) == 1)
    if status in ("tagged", "untagged"):
        rows = rows.join(track_tags.select("track_id"), "track_id", "left_semi" if status == "tagged" else "left_anti")
    if tag is not None:
        rows = rows.join(track_tags.filter(F.col("tag_id") == tag).select("track_id"), "track_id", "left_semi")
    key = F.lower(F.col(sort)) if sort in ("name", "artist", "album") else F.col(sort)
    return rows.orderBy(key.desc() if descending else key.asc(), "track_id")


def orphans(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Events whose track isn't there: none in a sound archive."""
    return events.join(tracks.select("track_id"), "track_id", "left_anti")
