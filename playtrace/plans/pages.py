"""Pages over the marts of an archive. Every order ends in a unique key; an empty archive gives empty pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.config import DAY_MS, DEFAULTS, Settings
from playtrace.functions import predicates as p
from playtrace.operators import peaks, sequences
from playtrace.operators.rollups import KEYS
from playtrace.plans.marts import Archive


def text_id(column: str) -> Column:
    return F.col(column).cast("string").alias("id")


def overview(a: Archive, limit: int = 5) -> DataFrame:
    """(section, id, value): numbers of tracks, artists and albums, lifetime totals, each year's time and the most played tracks."""
    counts = [a.table(f"{k}s").agg(F.count(F.lit(1)).alias("value")).select(F.lit("count").alias("section"), F.lit(k).alias("id"), "value") for k in KEYS]
    years = a.table("years").select(F.lit("year").alias("section"), text_id("year"), F.col("ms_played").alias("value"))
    top = a.table("tracks").orderBy(F.desc("q_plays"), F.desc("ms_played"), "track_id").limit(limit)
    life = a.table("years").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("plays", "q_plays", "ms_played", "distinct_days")])
    lifetime = [life.select(F.lit("lifetime").alias("section"), F.lit(c).alias("id"), F.col(c).alias("value")) for c in life.columns]
    streams = a.by_month("by_day").agg(F.coalesce(F.sum("plays"), F.lit(0)).alias("value")).select(F.lit("lifetime").alias("section"), F.lit("streams").alias("id"), "value")
    return reduce(DataFrame.unionByName, [*counts, *lifetime, streams, years, top.select(F.lit("track").alias("section"), text_id("track_id"), F.col("q_plays").alias("value"))])


def on_this_day(a: Archive, month_day: str, today: str | None = None) -> DataFrame:
    """Dates of other years with this month and day, with the artist and the track of most plays, private ones too.

    Of the months' folds only those of that month are read.
    """
    days = a.table("days").filter(F.col("local_date").endswith(f"-{month_day}") & (F.col("local_date") != (today or "")))
    folds = a.by_month("by_day", {ym for ym in a.manifest.months if ym.endswith(f"-{month_day[:2]}")}).filter(F.col("local_date").endswith(f"-{month_day}"))
    out = days.select("local_date", "plays", "q_plays", "ms_played")
    for kind in ("artist", "track"):
        counts = folds.groupBy("local_date", KEYS[kind]).agg(F.sum("plays").alias("n"))
        best = peaks.first_of(counts, "local_date", F.desc("n"), KEYS[kind]).select("local_date", F.col(KEYS[kind]).alias(f"top_{kind}"), F.col("n").alias(f"top_{kind}_plays"))
        out = out.join(best, "local_date", "left")
    return out


def heatmap(a: Archive, low: str, high: str, metric: str) -> DataFrame:
    """(local_date, value) of the days between two dates; ``metric`` is ms_played, plays or tracks."""
    if metric not in ("ms_played", "plays", "tracks"):
        raise ValueError(f"no such metric: {metric}")
    return a.table("days").filter(F.col("local_date").between(low, high)).select("local_date", F.col(metric).alias("value"))


def year_months(a: Archive, year: int) -> DataFrame:
    """The months of a year that have plays."""
    return a.table("monthly_artist").filter(F.col("ym").startswith(f"{year}-")).groupBy("ym").agg(*[F.sum(c).alias(c) for c in ("plays", "q_plays", "ms_played")])


def year_hours(a: Archive, year: int) -> DataFrame:
    """24 rows: plays by hour of the day in a year, private ones too."""
    folds = a.by_month("by_hour", {ym for ym in a.manifest.months if ym.startswith(f"{year}-")})
    seen = folds.groupBy("hour").agg(F.sum("plays").alias("plays"), F.sum("ms_played").alias("ms_played"))
    hours = a.spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(seen), "hour", "left").fillna(0)  # 24 rows at most


def new_artists(a: Archive, low: int, high: int, limit: int = 10) -> DataFrame:
    """The most played of the artists first heard in low <= ts < high."""
    return a.table("artists").filter((F.col("first_ts") >= low) & (F.col("first_ts") < high)).orderBy(F.desc("q_plays"), "artist_id").limit(limit).select("artist_id", "q_plays")


def session_cards(sessions: DataFrame) -> DataFrame:
    """(card, listener, session, value): the longest, the most diverse and the most repetitive session."""
    cards = (("longest", 2, ("ms_played",)), ("mostDiverse", 6, ("diversity", "artists")), ("mostRepetitive", 6, ("max_repeats", "events")))
    parts = [sessions.filter(F.col("events") >= least).orderBy(*[F.desc(c) for c in order], "start_ts", "listener", "session").limit(1).select(F.lit(name).alias("card"), "listener", "session", F.col(order[0]).cast("double").alias("value")) for name, least, order in cards]
    return reduce(DataFrame.unionByName, parts)


def highlights(a: Archive, now: int, eras: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(card, a, b): years covered, the year of most time, lost favourites, all time in hours and days, the number of eras.

    A card that nothing stands behind is left out.
    """

    def card(df: DataFrame, name: str, first: Column, second: Column) -> DataFrame:
        return df.select(F.lit(name).alias("card"), first.cast("long").alias("a"), second.cast("long").alias("b"))

    years = a.table("years")
    bounds = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).filter("lo IS NOT NULL")
    lost = a.table("lost").filter("score > 0").agg(F.sum((F.col("score") >= s.lost_least_score).cast("long")).alias("n"), F.min("last_ts").alias("oldest")).filter("n > 0")
    total = a.table("tracks").agg(F.coalesce(F.sum("ms_played"), F.lit(0)).alias("ms"))
    return reduce(DataFrame.unionByName, [
        card(bounds, "years", F.col("hi") - F.col("lo") + 1, F.col("lo")), card(years.orderBy(F.desc("ms_played"), "year").limit(1), "biggestYear", F.col("year"), F.floor(F.col("ms_played") / 3_600_000 + 0.5)),
        card(lost, "lostFavorites", F.col("n"), F.greatest(F.lit(1), F.floor((F.lit(now) - F.col("oldest")) / (365 * DAY_MS)))), card(total, "totalTime", F.floor(F.col("ms") / 3_600_000 + 0.5), F.floor(F.col("ms") / DAY_MS + 0.5)),
        card(eras.agg(F.count(F.lit(1)).alias("n")).filter("n > 0"), "eras", F.col("n"), F.lit(None)),
    ])


def top_of_year(a: Archive, kind: str, year: int, limit: int = 50) -> DataFrame:
    """The artists or albums with most time in a year. Artists from the monthly mart, albums from that year's events, private ones too."""
    rows = a.table("monthly_artist").filter(F.col("ym").startswith(f"{year}-")) if kind == "artist" else a.events.filter((F.col("year") == year) & F.col(KEYS[kind]).isNotNull())
    return rows.groupBy(KEYS[kind]).agg(F.sum("ms_played").alias("ms_played")).orderBy(F.desc("ms_played"), KEYS[kind]).limit(limit)


def first_heard(a: Archive, low: int, high: int, limit: int = 12) -> DataFrame:
    """(kind, id, first_ts, q_plays) of the most played artists and tracks whose first play lies in low <= ts < high."""
    parts = []
    for kind in ("artist", "track"):
        new = a.table(f"{kind}s").filter((F.col("first_ts") >= low) & (F.col("first_ts") < high)).orderBy(F.desc("q_plays"), KEYS[kind]).limit(limit)
        parts.append(new.select(F.lit(kind).alias("kind"), text_id(KEYS[kind]), "first_ts", "q_plays"))
    return reduce(DataFrame.unionByName, parts)


def obsession_between(a: Archive, low: int, high: int) -> DataFrame:
    """The strongest obsession with a track whose window began in low <= ts < high."""
    inside = a.table("obsessions_track").filter((F.col("window_start") >= low) & (F.col("window_start") < high))
    return inside.orderBy(F.desc("intensity"), "id").limit(1).select("id", "window_start", "window_plays", "intensity")


def month_artists(a: Archive, ym: str, limit: int = 12) -> DataFrame:
    return a.table("monthly_artist").filter(F.col("ym") == ym).orderBy(F.desc("ms_played"), "artist_id").limit(limit).select("artist_id", "plays", "q_plays", "ms_played")


def month_days(a: Archive, ym: str) -> DataFrame:
    return a.table("days").filter(F.col("local_date").startswith(f"{ym}-")).select("local_date", "plays", "q_plays", "ms_played", "tracks")


def day_artist(events: DataFrame, date: str) -> DataFrame:
    """The artist with most plays of a date, private ones too."""
    counts = events.filter(F.col("local_date") == date).groupBy("artist_id").agg(F.count(F.lit(1)).alias("plays"))
    return counts.orderBy(F.desc("plays"), "artist_id").limit(1)


def day_sessions(sessions: DataFrame, date: str) -> DataFrame:
    """Sessions that began on a date."""
    return sessions.filter(F.col("local_date") == date).orderBy("start_ts", "listener", "session")


def track_points(a: Archive, track: int) -> DataFrame:
    """(unit, at, plays, q_plays, ms_played) of a track by month, by year and by hour of the day; hours count private plays too."""
    months = a.table("monthly_track").filter(F.col("track_id") == track)
    hours = a.table("track_hours").filter(F.col("track_id") == track).select(F.lit("hour").alias("unit"), F.format_string("%02d", "hour").alias("at"), "plays", "q_plays", "ms_played")
    points = [months.select(F.lit(unit).alias("unit"), F.substring("ym", 1, size).alias("at"), "plays", "q_plays", "ms_played") for unit, size in (("month", 7), ("year", 4))]
    return reduce(DataFrame.unionByName, [*points, hours]).groupBy("unit", "at").agg(*[F.sum(c).alias(c) for c in ("plays", "q_plays", "ms_played")])


def milestones(a: Archive, tracks: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """(track_id, kind, ts_ms, n, days): each track's timeline, from detectors that look at different marts.

    first-heard; play-count (the n-th qualifying play, ``days`` after the first); peak-month (at its first instant in UTC, with
    its plays); longest-absence (90 days or more, at its begin); comeback (with plays after it); last-heard. ``tracks`` has the
    track_ids to look at, by default all. Nth plays are read from all events, private ones too; their number is bounded by the
    track's visible plays.
    """
    none = F.lit(None).cast("long")

    def only(df: DataFrame) -> DataFrame:
        return df if tracks is None else df.join(tracks.select("track_id"), "track_id", "left_semi")

    def row(kind: str, ts: Column, n: Column = none, days: Column = none) -> list[Column]:
        return [F.lit(kind).alias("kind"), ts.cast("long").alias("ts_ms"), n.cast("long").alias("n"), days.cast("long").alias("days")]

    stats = only(a.table("tracks"))
    gaps = only(sequences.gaps_of(a.table("sequence_track")).withColumnRenamed("id", "track_id"))
    plays = only(a.events.filter(p.qualifying(s)).select("track_id", "ts_ms"))
    nth = sequences.milestones(plays.withColumnRenamed("track_id", "id"), tuple(n for n in s.milestones if n > 1)).withColumnRenamed("id", "track_id")
    nth = nth.join(stats.select("track_id", "q_plays", "first_ts"), "track_id").filter("n <= q_plays")
    peak = only(a.table("track_peak_month"))
    came = sequences.comebacks_after(plays.withColumnRenamed("track_id", "id"), gaps.withColumnRenamed("track_id", "id"), s).withColumnRenamed("id", "track_id")
    first_day = F.unix_date(F.to_date(F.concat("peak_ym", F.lit("-01")))).cast("long") * DAY_MS
    parts = [
        stats.select("track_id", *row("first-heard", F.col("first_ts"))),
        nth.select("track_id", *row("play-count", F.col("ts_ms"), F.col("n"), F.floor((F.col("ts_ms") - F.col("first_ts")) / DAY_MS))),
        peak.select("track_id", *row("peak-month", first_day, F.col("peak_ym_plays"))),
        gaps.filter("gap_days >= 90").select("track_id", *row("longest-absence", F.col("gap_from"), days=F.col("gap_days"))),
        came.select("track_id", *row("comeback", F.col("gap_to"), F.col("plays_after"), F.col("gap_days"))),
        stats.select("track_id", *row("last-heard", F.col("last_ts"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def artist_insights(a: Archive, s: Settings = DEFAULTS) -> DataFrame:
    """What stands out about each artist, one row each; nulls where there is no such silence or span.

    A silence of 180 days, with the plays since it ended (a return from five on; private plays count); the shortest span of years
    with 70 percent of the plays, in percent; whether 40 percent of 40 plays or more are at night; whether one track has 30
    percent of the plays.
    """
    gaps = sequences.gaps_of(a.table("sequence_artist")).filter("gap_days >= 180").select(F.col("id").alias("artist_id"), "gap_days", "gap_to")
    since = a.events.select("artist_id", "ts_ms").join(gaps.select("artist_id", "gap_to"), "artist_id").filter("ts_ms >= gap_to").groupBy("artist_id").agg(F.count(F.lit(1)).alias("plays_since"))
    years = a.table("monthly_artist").groupBy("artist_id", F.substring("ym", 1, 4).cast("int").alias("year")).agg(F.sum("plays").alias("n"))
    spans = peaks.tight_span(years.join(years.groupBy("artist_id").count().filter("count >= 2"), "artist_id", "left_semi"), "artist_id")
    spans = spans.select("artist_id", "from_year", "to_year", F.floor(100 * F.col("plays") / F.col("total") + 0.5).alias("percent"))
    best = a.table("owned").groupBy("artist_id").agg(F.max("plays").alias("best"), F.sum("plays").alias("total"))
    rows = a.table("artists").join(best, "artist_id", "left").join(gaps, "artist_id", "left").join(since, "artist_id", "left").join(spans, "artist_id", "left")
    return rows.select(
        "artist_id", "gap_days", "plays_since", F.when(F.col("gap_days").isNotNull(), F.coalesce("plays_since", F.lit(0)) >= 5).alias("returned"), "from_year", "to_year", "percent",
        ((F.col("plays") >= 40) & (F.col("night_plays") >= 0.4 * F.col("plays"))).alias("nocturnal"), (F.col("best") >= 0.3 * F.col("total")).alias("one_track"), "night_plays", "best",
    )


def artist_lists(a: Archive, artist: int, tracks: int = 12, albums: int = 8) -> DataFrame:
    """(kind, id, value): an artist's tracks by qualifying plays and the albums of those tracks by time."""
    owned = a.table("owned").filter(F.col("artist_id") == artist).select("track_id")
    top = a.table("tracks").join(owned, "track_id", "left_semi").orderBy(F.desc("q_plays"), F.desc("ms_played"), "track_id").limit(tracks)
    held = a.table("track_album").join(owned, "track_id", "left_semi").select("album_id")
    best = a.table("albums").join(held, "album_id", "left_semi").orderBy(F.desc("ms_played"), "album_id").limit(albums)
    return top.select(F.lit("track").alias("kind"), text_id("track_id"), F.col("q_plays").alias("value")).unionByName(best.select(F.lit("album").alias("kind"), text_id("album_id"), F.col("ms_played").alias("value")))


def album_months(a: Archive, album: str) -> DataFrame:
    """An album's months, private plays included, as all pages of one album count them."""
    return a.table("album_months").filter(F.col("album_id") == album).select("ym", "plays", "q_plays", "ms_played")


def lost_page(a: Archive, names: DataFrame, which: str, now: int, text: str = "", limit: int = 50, offset: int = 0, s: Settings = DEFAULTS) -> DataFrame:
    """(id, q_plays, score) of a page of lost favourites, best first.

    ``which`` is one of all, deepCuts, oldFavorites, forgottenArtists, forgottenAlbums, years3, years5 and years10; ``text``
    is looked for in names of tracks and artists in any case. ``names`` has (track_id, name, artist_id, artist).
    """
    rows = a.table("lost").filter(F.col("score") >= s.lost_least_score)
    known = names.withColumnRenamed("track_id", "id")
    if text.strip() or which in ("deepCuts", "forgottenArtists"):
        rows = rows.join(known, "id")
    if text.strip():
        rows = rows.filter(F.col("name").ilike(f"%{text.strip()}%") | F.col("artist").ilike(f"%{text.strip()}%"))
    if which == "deepCuts":
        best = a.table("owned").groupBy("artist_id").agg(F.max("q_plays").alias("best"))
        rows = rows.join(best, "artist_id").filter(F.col("q_plays") < 0.6 * F.col("best"))
    elif which == "oldFavorites":
        rows = rows.filter("q_plays >= 40")
    elif which == "forgottenArtists":
        rows = rows.join(a.table("graveyard_artist").select(F.col("id").alias("artist_id")), "artist_id", "left_semi")
    elif which == "forgottenAlbums":
        gone = a.table("track_album").join(a.table("graveyard_album").select(F.col("id").alias("album_id")), "album_id", "left_semi")
        rows = rows.join(gone.select(F.col("track_id").alias("id")), "id", "left_semi")
    elif which in ("years3", "years5", "years10"):
        rows = rows.filter(F.col("last_ts") <= now - int(which[5:]) * 365 * DAY_MS)
    elif which != "all":
        raise ValueError(f"no such filter: {which}")
    return rows.orderBy(F.desc("score"), F.desc("q_plays"), "id").offset(offset).limit(limit).select("id", "q_plays", "score")
