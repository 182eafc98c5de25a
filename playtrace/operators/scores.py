"""Obsessions, lost favourites and the graveyard: marts that score entities by their history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.config import DAY_MS, DEFAULTS, Settings
from playtrace.functions import curves as c
from playtrace.operators import peaks, rollups, sequences


#: Windows and counts of the sequence fold that scores read.
FOLD_DAYS, FOLD_COUNTS = (7, 30, 90), (50, 100)


def folds(events: DataFrame, kind: str, s: Settings = DEFAULTS, totals: DataFrame | None = None) -> DataFrame:
    """The sequence fold of all entities of a kind, for obsessions, lost favourites, gaps and comebacks."""
    return sequences.folded(sequences.qualifying_plays(events, kind, s), FOLD_DAYS, FOLD_COUNTS, totals)


def obsessions(events: DataFrame, kind: str, s: Settings = DEFAULTS, least_plays: int | None = None, fold: DataFrame | None = None, months: DataFrame | None = None) -> DataFrame:
    """Entities with enough plays and a dense month. ``fold`` and ``months`` are the sequence fold and monthly counts (id, ym, n), where at hand."""
    days = s.obsession_window_days
    plays = sequences.qualifying_plays(events, kind, s)
    fold = sequences.folded(plays, (7, days), FOLD_COUNTS) if fold is None else fold
    months = plays.groupBy("id", "ym").agg(F.count(F.lit(1)).alias("n")) if months is None else months
    least = s.obsession_least_plays[kind] if least_plays is None else least_plays
    dense = fold.filter((F.col("n") >= least) & (F.col(f"d{days}_in") >= s.obsession_least_window_plays))
    joined = dense.join(sequences.longest_monthly_run(months), "id", "left")
    n, inside, start, end, after = F.col("n"), F.col(f"d{days}_in"), F.col(f"d{days}_from"), F.col(f"d{days}_to"), F.col(f"d{days}_after")
    span = F.greatest(F.lit(1.0), (end - start) / DAY_MS)
    return joined.select(
        F.lit(kind).alias("kind"), "id", start.alias("window_start"), end.alias("window_end"), inside.alias("window_plays"), n.alias("lifetime_plays"),
        (inside / n).alias("share"), (inside / span).alias("plays_per_day"), after.alias("plays_after"), (after / n).alias("after_share"),
        c.intensity(inside, n, days).alias("intensity"), *sequences.days_to(fold, FOLD_COUNTS), F.coalesce("longest_run", F.lit(0)).alias("longest_run"), F.col("d7_in").alias("peak_week"),
    )


def sections(found: DataFrame, limit: int, of: str = "track", artists: str = "artist", albums: str = "album") -> DataFrame:
    """The seven lists of the obsession page as (section, position, id, value)."""
    kinds = F.col("kind")
    lists = [
        ("destroyed", kinds == of, [F.desc("window_plays"), F.desc("intensity")], "window_plays"),
        ("artistBinges", (kinds == artists) & (F.col("share") >= 0.30), [F.desc("intensity")], "intensity"),
        ("albumAddictions", kinds == albums, [F.desc("intensity")], "intensity"),
        ("oneHit", (kinds == of) & (F.col("share") >= 0.6) & (F.col("after_share") <= 0.12), [F.desc("share"), F.desc("window_plays")], "share"),
        ("fastestHundred", (kinds == of) & F.col("days_to_100").isNotNull(), [F.asc("days_to_100")], "days_to_100"),
        ("mostIntenseWeek", kinds == of, [F.desc("peak_week")], "peak_week"),
        ("longest", (kinds == of) & (F.col("longest_run") >= 3), [F.desc("longest_run"), F.desc("lifetime_plays")], "longest_run"),
    ]
    parts = []
    for name, where, order, value in lists:
        top = found.filter(where).orderBy(*order, F.asc("id")).limit(limit)
        parts.append(top.select(F.lit(name).alias("section"), F.col("id").cast("string").alias("id"), F.col(value).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def lost_favourites(events: DataFrame, now: int, s: Settings = DEFAULTS, stats: DataFrame | None = None, fold: DataFrame | None = None) -> DataFrame:
    """Every track with its five dimensions, score and, where it is gated out, the first gate that did so.

    ``stats`` and ``fold`` are the marts of track_stats and of the sequence fold, where they are at hand.
    """
    stats = (rollups.track_stats(events, now, s) if stats is None else stats).withColumnRenamed("track_id", "id")
    fold = sequences.folded(sequences.qualifying_plays(events, "track", s), (90,)) if fold is None else fold
    peak = fold.select("id", F.col("d90_in").alias("peak_plays"), F.floor(F.col("gap_ms") / DAY_MS).alias("longest_gap_days"))
    rows = stats.join(peak, "id", "left").fillna({"peak_plays": 0, "longest_gap_days": 0})
    q, n = F.col("q_plays"), F.col("plays")
    rows = rows.withColumn("days_since", F.floor((F.lit(now) - F.col("last_ts")) / DAY_MS))
    rejected = (
        F.when(F.col("last_ts").isNull(), "never-played").when(q < s.lost_least_plays, "too-few-plays").when(F.col("ms_played") < s.lost_least_ms, "too-little-time")
        .when(F.col("days_since") < s.dormancy_days, "not-dormant").when(c.ratio(F.col("recent_plays"), q) > s.lost_most_recent_share, "already-returned")
    )
    affinity = c.clamp01(0.6 * c.log_scale(q, 5, 400) + 0.4 * c.log_scale(F.col("ms_played") / 60_000, 15, 1200))
    dormancy = c.dormancy(F.col("days_since"))
    peak_dim = c.clamp01(0.55 * c.log_scale(F.col("peak_plays"), 3, 120) + 0.45 * c.clamp01(c.ratio(F.col("peak_plays"), q)))
    engagement = c.clamp01(0.6 * (1 - c.clamp01(c.ratio(F.col("skips"), n))) + 0.4 * c.clamp01(c.ratio(q, n)))
    consistency = c.clamp01(0.5 * c.log_scale(F.col("active_months"), 1, 36) + 0.5 * c.log_scale(F.col("distinct_days"), 2, 150))
    dims = dict(zip(("affinity", "dormancy", "peak", "engagement", "consistency"), (affinity, dormancy, peak_dim, engagement, consistency), strict=True))
    open_ = F.col("rejected_by").isNull()
    rows = rows.withColumn("rejected_by", rejected)
    rows = rows.withColumns({k: F.when(open_, v).otherwise(0.0) for k, v in dims.items()})
    total = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in zip(dims, s.lost_weights, strict=True)])
    return rows.withColumn("score", F.when(open_, c.tenths(100 * total)).otherwise(0.0))


def graveyard_of(stats: DataFrame, yearly: DataFrame, kind: str, now: int, s: Settings = DEFAULTS, album_months: DataFrame | None = None) -> DataFrame:
    """Entities once played a lot and not for years, with their rank in their best year.

    ``stats`` has each entity's numbers, ``yearly`` its qualifying plays n by year, ``album_months`` those of albums by month.
    """
    key, least = rollups.KEYS[kind], s.graveyard_least_plays[kind]
    rows = stats.filter((F.col("q_plays") >= least) & (F.col("last_ts") <= now - s.graveyard_days * DAY_MS) & (F.col("recent_plays") <= s.graveyard_most_recent))
    if album_months is None:
        best = peaks.first_of(yearly, key, F.desc("n"), "year").select(key, F.col("year").alias("peak_year"))
    else:
        # an album's best year is that of its best month
        best = peaks.first_of(album_months, key, F.desc("q_plays"), "ym").select(key, F.substring("ym", 1, 4).cast("int").alias("peak_year"))
    ranks = peaks.ranks_of(yearly).select(key, F.col("year").alias("peak_year"), F.col("rank_in_year").alias("rank_at_peak"))
    rows = rows.join(best, key, "left").join(ranks, [key, "peak_year"], "left")
    days = F.floor((F.lit(now) - F.col("last_ts")) / DAY_MS)
    return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "q_plays", "last_ts", days.alias("days_missing"), "peak_year", F.col("rank_at_peak").cast("long").alias("rank_at_peak"), c.graveyard(F.col("q_plays"), days, F.col("rank_at_peak"), least).alias("score"))


def graveyard(events: DataFrame, kind: str, now: int, s: Settings = DEFAULTS) -> DataFrame:
    """The same from events."""
    months = rollups.monthly(events, "album", s) if kind == "album" else None
    return graveyard_of(rollups.stats(events, kind, now, s), peaks.plays_by_year(events, kind, s), kind, now, s, months)
