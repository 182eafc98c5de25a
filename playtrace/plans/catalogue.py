"""Every query of the engine's own operators, by key. ``statements`` has the SQL that states each result."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtrace.config import DAY_MS, GRAVEYARD_NOW, LOST_NOW
from playtrace.functions import predicates as p
from playtrace.functions.curves import rounded
from playtrace.operators import eras, library, peaks, rollups, rules, scores, search, sequences, sessions
from playtrace.plans import era_statements, marts, pages, statements
from playtrace.sources import history
from playtrace.shared import shared_folder, written
from playtrace.sources.testbed import calendar, long_plays, long_view, short_view, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return put


def on_long(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(long_view(spark, sf_dir))


def on_short(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(short_view(spark, sf_dir))


_ARCHIVES: dict[tuple[str, str], marts.Archive] = {}


def archive(spark: SparkSession, sf_dir: str, fresh: bool = False) -> marts.Archive:
    """The archive of the long view: the one in the shared folder if its code, settings and tables are the present ones, else rebuilt.

    Its marts are derived when a page first reads them. ``fresh`` rebuilds it with all marts in any case.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if fresh or key not in _ARCHIVES:
        source = repr(sorted((f.path.rsplit("/", 1)[-1], f.length, str(f.modificationTime)) for n in ("lineitem", "part") for f in spark.read.format("binaryFile").load(f"{sf_dir}/{n}.parquet").select("path", "length", "modificationTime").collect()))
        folder = f"{shared_folder(spark)}/archives/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
        held = marts.opened(spark, folder)
        if fresh or marts.stale(held, source, LOST_NOW, GRAVEYARD_NOW):
            held = marts.rebuild(long_plays(spark, sf_dir), folder, LOST_NOW, GRAVEYARD_NOW, source=source, parts=calendar, on_demand=not fresh)
        _ARCHIVES[key] = held
    return _ARCHIVES[key]


def on_archive(name: str, f: Callable[[marts.Archive], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(archive(spark, sf_dir))


def rounds(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# rollups
on_long("g01_track_stats", lambda e: rollups.track_stats(e, LOST_NOW))
on_long("g02_artist_stats", lambda e: rollups.artist_stats(e, LOST_NOW))
on_long("g03_album_stats", lambda e: rollups.album_stats(e, LOST_NOW))
on_long("g04_monthly_tracks", lambda e: rollups.monthly(e, "track"))
on_long("g05_monthly_artists", lambda e: rollups.monthly(e, "artist"))
on_long("g06_daily", rollups.daily)
on_short("g07_hourly", rollups.hourly)
on_long("g08_yearly", rollups.yearly)
on_long("g09_album_breadth", lambda e: rounds(rollups.album_breadth(e), "breadth", "top3_share"))
on_long("g10_year_from_month", lambda e: rollups.yearly_from_monthly(rollups.monthly(e, "track")))
on_short("g11_hours_dense", lambda e: rollups.dense_hours(e.filter("local_date = '2024-01-03'")))
on_long("g12_lifetime", lambda e: rounds(rollups.lifetime(e), "skip_rate"))
on_short("g13_dayparts", lambda e: rounds(rollups.dayparts(rollups.hourly(e)), "share"))
on_short("g13_clock", lambda e: rounds(rollups.clock(rollups.hourly(e)), "after_midnight_share"))
on_long("g18_month_totals", lambda e: rollups.month_totals(e, "1998-05"))


@query("g14_facets")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = archive(spark, sf_dir)
    years = built.table("years").select(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value"), F.lit(0).cast("long").alias("n"))
    top = built.table("artists").orderBy(F.desc("q_plays"), "artist_id").limit(200)
    return years.unionByName(top.select(F.lit("artist").alias("facet"), F.col("artist_id").cast("string").alias("value"), F.col("q_plays").alias("n"))).unionByName(_tag_facet(spark, sf_dir))


def _tag_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sizes of parts as tags, with the number of parts that bear each."""
    tags = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("tag_id"), F.col("n_name").alias("name"))
    return library.tag_usage(tags, _part_tags(spark, sf_dir)).select(F.lit("tag").alias("facet"), F.col("name").alias("value"), F.col("uses").alias("n"))


def _part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("track_id"), (F.col("p_size") % 40).cast("int").alias("tag_id"))


@query("g15_usage_counts")
def usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    used = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("uses"))
    return nations.join(used, nations["n_nationkey"] == used["s_nationkey"], "left").select("n_name", F.coalesce("uses", F.lit(0)).alias("uses"))


@query("g16_joined_names")
def joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.joined_names(table(spark, sf_dir, "nation"), "n_regionkey", "n_name")


# rankings
on_long("w01_track_peak_month", lambda e: peaks.peak_month(e, "track"))
on_long("w02_artist_peak_month", lambda e: peaks.peak_month(e, "artist"))
on_long("w03_track_peak_year", lambda e: peaks.peak_year(e, "track"))
on_long("w04_artist_peak_year", lambda e: peaks.peak_year(e, "artist"))
on_long("w05_album_peak", peaks.album_peak)
on_long("w06_canonical_album", lambda e: peaks.canonical_album(e, "supplier_id"))
on_long("w07_rank_in_year", lambda e: longs(peaks.rank_in_year(e, "track"), "rank_in_year"))
for _kind, _days in (("artist", 7), ("album", 30), ("track", 90)):
    on_long(f"w08_densest_{_kind}_{_days}d", lambda e, k=_kind, d=_days: sequences.densest(sequences.qualifying_plays(e, k), d))
on_long("w09_longest_gap", lambda e: sequences.longest_gap(sequences.qualifying_plays(e, "track")))
on_long("w10_days_to_nth", lambda e: sequences.days_to_nth(sequences.qualifying_plays(e, "album"), (5, 50)))
on_long("w11_plays_after", lambda e: sequences.densest(sequences.qualifying_plays(e, "artist"), 30).select("id", "to_ts", "plays_after"))
on_long("w12_monthly_run", lambda e: sequences.monthly_run(sequences.qualifying_plays(e, "album")))
on_long("w13_streak", lambda e: sequences.daily_streak(rollups.daily(e)))
on_long("w14_milestones", lambda e: sequences.milestones(sequences.qualifying_plays(e, "track"), (10, 25, 50)))
on_short("w15_top_per_day", lambda e: peaks.top_per_day(e, "artist"))
on_long("w17_year_span", lambda e: peaks.tight_span(peaks.all_plays_by_year(e, "track_id"), "track_id"))
on_long("w18_previous_year", lambda e: peaks.versus_previous_year(rollups.yearly(e)))


@query("w16_diversified")
def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = archive(spark, sf_dir)
    owner = built.table("owned").select("track_id", "artist_id")
    order = [F.desc("score"), F.desc("q_plays"), F.asc("id")]
    page = built.table("lost").filter("score >= 30").orderBy(*order).limit(200)
    out = peaks.diversified(page.join(owner, page["id"] == owner["track_id"]), "artist_id", order, 2)
    return longs(out.select("position", "id", "artist_id", "score"), "position")


# sessions
on_short("q03_sessions_global", lambda e: sessions.across_listeners(e, 10).drop("ms_played"))
on_short("q03_sessions_by_listener", lambda e: sessions.by_session_window(e, 360))
on_short("q04_session_stats", lambda e: rounds(sessions.session_stats(e, 360), "diversity"))
on_short("g17_session_averages", lambda e: rounds(sessions.session_averages(sessions.session_stats(e, 360)), "mean_events", "mean_ms"))
on_short("l07_session_list", lambda e: sessions.session_list(sessions.session_stats(e, 360), "longest", 50, 10).select("listener", "session", "start_ts", "ms_played", "events"))
for _sort in ("diverse", "repetitive"):
    on_short(f"l07_sessions_{_sort}", lambda e, k=_sort: rounds(sessions.session_list(sessions.session_stats(e, 360), k, 40).select("listener", "session", "diversity", "artists", "max_repeats", "events"), "diversity"))

# scores
on_long("q06_obsessions_artist", lambda e: rounds(scores.obsessions(e, "artist"), "share", "plays_per_day", "after_share"))
on_long("q06_obsessions_album", lambda e: rounds(scores.obsessions(e, "album"), "share", "plays_per_day", "after_share"))
_LOST = ["id", "q_plays", "peak_plays", "longest_gap_days", "days_since", "rejected_by", "affinity", "dormancy", "peak", "engagement", "consistency", "score"]
on_long("q08_lost_favourites", lambda e: rounds(scores.lost_favourites(e, LOST_NOW).select(*_LOST), "affinity", "dormancy", "peak", "engagement", "consistency"))
on_archive("r06_lost_count", lambda a: a.table("lost").filter("score >= 30").agg(F.count(F.lit(1)).alias("n")))
for _kind in ("track", "artist", "album"):
    on_long(f"q10_graveyard_{_kind}", lambda e, k=_kind: scores.graveyard(e, k, GRAVEYARD_NOW))
on_archive("l06_graveyard_page", lambda a: reduce(DataFrame.unionByName, [a.table(f"graveyard_{k}").withColumn("id", F.col("id").cast("string")) for k in ("track", "album", "artist")]).filter("days_missing >= 800").orderBy(F.desc("score"), F.desc("q_plays"), "kind", "id").limit(100).select("kind", "id", "q_plays", "days_missing", "score"))
on_long("q20_comebacks", lambda e: sequences.comebacks(sequences.qualifying_plays(e, "track")))


@query("l05_obsession_sections")
def obsession_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = archive(spark, sf_dir)
    found = reduce(DataFrame.unionByName, [built.table(f"obsessions_{k}").withColumn("id", F.col("id").cast("string")) for k in ("album", "artist")])
    return rounds(scores.sections(found, 10, of="album"), "value")


@query("r05_deep_cuts")
def deep_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost favourites well below their artist's most played track."""
    built = archive(spark, sf_dir)
    owner = built.table("owned").select(F.col("track_id").alias("id"), "artist_id")
    rows = built.table("lost").select("id", "q_plays", "score").join(owner, "id")
    return rows.withColumn("best", F.max("q_plays").over(Window.partitionBy("artist_id"))).filter((F.col("score") >= 30) & (F.col("q_plays") < 0.6 * F.col("best")))


# eras, over track vectors
def _era_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    months = archive(spark, sf_dir).table("monthly_track").withColumn("listener", F.lit(1))
    vectors, every = eras.month_vectors(months, "track_id"), eras.calendar_months(months)
    return vectors, eras.boundaries(vectors, every)


QUERIES["q11_month_vectors"] = lambda spark, sf_dir: rounds(_era_parts(spark, sf_dir)[0], "w", digits=4).drop("listener")
QUERIES["q12_boundaries"] = lambda spark, sf_dir: rounds(_era_parts(spark, sf_dir)[1], "distance").drop("listener")
QUERIES["q13_change_points"] = lambda spark, sf_dir: rounds(eras.change_points(_era_parts(spark, sf_dir)[1]), "distance").drop("listener")


def _by_listener(e: DataFrame, key: str) -> DataFrame:
    e = p.visible(e).select("listener", key, "ym", "ms_played")
    if key == "track_id":  # hardly two plays share a track and month, so that they are dealt to bounded tasks before any is summed
        e = e.repartition(rollups.tasks_of(e), "listener", key)
    return e.groupBy("listener", key, "ym").agg(F.count(F.lit(1)).alias("plays"), p.count_if(p.qualifying()).alias("q_plays"), F.sum("ms_played").alias("ms_played"))


@query("q19_eras")
def era_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eras of four listeners, to whom suppliers are dealt."""
    e = archive(spark, sf_dir).events.withColumn("listener", F.col("supplier_id") % 4)
    tracks = written(_by_listener(e, "track_id"), "months")
    vectors, every = written(eras.month_vectors(tracks, "track_id"), "vectors"), eras.calendar_months(tracks)
    distances = written(eras.boundaries(vectors, every), "distances")
    found = written(eras.segments(vectors, every, distances, eras.change_points(distances)), "eras")
    return eras.era_measures(found, written(_by_listener(e, "artist_id"), "artists"), tracks)


@query("r18_eras_named")
def eras_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of eras where those that begin in January bear the name of a nation."""
    found = written(QUERIES["q19_eras"](spark, sf_dir), "era-list")
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 4).cast("long").alias("listener"), (F.floor(F.col("n_nationkey") / 4) + 1992).cast("string").alias("year"), "n_name")
    names = nations.select("listener", F.concat("year", F.lit("-01")).alias("start_ym"), F.when(F.col("year") != "1996", F.col("n_name")).alias("custom_title"))
    return eras.with_names(found, names).select("listener", "era", "start_ym", "end_ym", "title", "auto_title")


@query("r18_eras_at")
def eras_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The era in which each month of orders lies, three years later; the last lie outside all."""
    months = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("listener"), F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 36), "yyyy-MM").alias("ym")).distinct()
    return eras.at(written(QUERIES["q19_eras"](spark, sf_dir), "era-list"), months)


#: Most vectors and most queries of one cell of ``cosine_pairs``, on average.
CELL = 2048


@query("f04_cosine_pairs")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with an id divisible by 50 against all: similarity of 0.25 or more."""
    return rounds(similar(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.25, CELL), "cosine")


def similar(vectors: DataFrame, least: float, cell: int) -> DataFrame:
    """(query_id, vec_id, cosine) of vectors (vec_id, embedding) and those with an id divisible by 50.

    Vectors and queries are dealt to chunks of a bounded size, and each pair of chunks is a cell that one task multiplies.
    """
    v = vectors.filter("embedding IS NOT NULL AND vec_id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    size = v.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % 50 == 0, 1)).alias("q")).first()
    chunks, blocks = (max(1, -(-x // cell)) for x in (size.n, size.q))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other)).groupBy("chunk", "block")

    def multiplied(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
        # a side without rows comes without columns
        held = _units(right) if right.num_rows else {}
        for length, (ids, x) in (_units(left) if left.num_rows else {}).items():
            queries, q = held.get(length, (None, None))
            for i in range(0, len(ids) if queries is not None else 0, 256):
                cosine = x[i : i + 256] @ q.T
                a, b = np.nonzero(~(cosine < least) & (ids[i : i + 256, None] != queries[None]))  # not a number counts as large, as in SQL
                out.append((queries[b], ids[i : i + 256][a], cosine[a, b]))
        return pa.table(dict(zip(("query_id", "vec_id", "cosine"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    cells = dealt(v, "chunk", chunks, "block", blocks).cogroup(dealt(v.filter("vec_id % 50 = 0"), "block", blocks, "chunk", chunks))
    return cells.applyInArrow(multiplied, "query_id long, vec_id long, cosine double")


def _units(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ids and unit vectors of each length; vectors of zeros are left out."""
    vectors = rows["x"].combine_chunks()
    ids, lengths, flat = rows["id"].to_numpy(), vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
    ends, out = np.cumsum(lengths), {}
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        x = flat[(ends[at] - length)[:, None] + np.arange(length)]
        norm = np.sqrt((x * x).sum(axis=1))
        kept = norm != 0
        out[int(length)] = ids[at][kept], x[kept] / norm[kept, None]
    return out


# joins
@query("j01_inner_dims")
def inner_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    named = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return named.groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("j02_left_join")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return c.join(spent, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("j03_semi")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("j04_anti")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("j05_share_of_best")
def share_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's plays beside its artist's most played track."""
    per = marts.owned(long_view(spark, sf_dir))
    return per.withColumn("best", F.max("q_plays").over(Window.partitionBy("artist_id")))


@query("j06_top_track_of_artist")
def top_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = archive(spark, sf_dir).table("owned")
    return per.groupBy("artist_id").agg(F.max_by("track_id", F.struct("q_plays", -F.col("track_id"))).alias("top_track"))


@query("j08_events_in_sessions")
def events_in_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all listeners inside each of the 20 longest sessions, by a range join with a small side."""
    e = short_view(spark, sf_dir)
    long_ones = sessions.session_list(sessions.session_stats(e, 360), "longest", 20).select(F.col("listener").alias("owner"), "session", "start_ts", "end_ts")
    inside = e.join(F.broadcast(long_ones), (F.col("ts_ms") >= F.col("start_ts")) & (F.col("ts_ms") <= F.col("end_ts")))
    return inside.groupBy("owner", "session").agg(F.count(F.lit(1)).alias("events"), F.sum((F.col("listener") == F.col("owner")).cast("long")).alias("own"))


# lists and pages
on_archive("l01_top_tracks", lambda a: a.table("tracks").filter("q_plays > 0").orderBy(F.desc("q_plays"), F.desc("ms_played"), "track_id").limit(50).select("track_id", "q_plays", "ms_played"))
on_archive("l01_top_tracks_year", lambda a: a.table("monthly_track").filter("ym LIKE '1998-%'").groupBy("track_id").agg(F.sum("q_plays").alias("q_plays"), F.sum("ms_played").alias("ms_played")).orderBy(F.desc("q_plays"), F.desc("ms_played"), "track_id").limit(50))
on_archive("l02_top_artists", lambda a: a.table("artists").filter("q_plays > 0").orderBy(F.desc("ms_played"), "artist_id").limit(10).select("artist_id", "q_plays", "ms_played"))
on_archive("l03_top_albums", lambda a: a.table("albums").filter("q_plays > 0").orderBy(F.desc("ms_played"), "album_id").limit(50).select("album_id", "q_plays", "ms_played"))
on_archive("r02_yearly_points", lambda a: a.table("years").select("year", "plays", "q_plays", "ms_played"))
on_archive("r10_months", lambda a: a.table("monthly_artist").select("ym").distinct())
for _name, _metric in (("r11_heatmap", "tracks"), ("r11_heatmap_plays", "plays"), ("r11_heatmap_ms", "ms_played")):
    on_archive(_name, lambda a, m=_metric: pages.heatmap(a, "1998-01-01", "1998-12-31", m))
on_archive("r12_bounds", lambda a: a.table("days").agg(F.min("local_date").alias("first_date"), F.max("local_date").alias("last_date")))


@query("l04_records")
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superlatives as (record, id, value); one that nothing qualifies for is left out."""
    built = archive(spark, sf_dir)
    tracks, artists, albums, days, years = (built.table(x) for x in ("tracks", "artists", "albums", "days", "years"))
    lost = built.table("lost").filter("score > 0")
    track_obsessions = built.table("obsessions_track")
    gaps = sequences.gaps_of(built.table("sequence_track")).join(tracks.filter("q_plays >= 15").select(F.col("track_id").alias("id")), "id").filter("gap_days >= 180")
    longest = built.table("sessions")
    streak = sequences.daily_streak(days)
    tops = [
        ("mostPlayedTrack", tracks, "track_id", F.desc("q_plays"), "q_plays"), ("mostPlayedArtist", artists, "artist_id", F.desc("ms_played"), "ms_played"), ("mostPlayedAlbum", albums, "album_id", F.desc("ms_played"), "q_plays"),
        ("longestDay", days, "local_date", F.desc("ms_played"), "ms_played"), ("busiestDay", days, "local_date", F.desc("plays"), "plays"), ("longestStreak", streak, "from_date", F.desc("days"), "days"),
        ("fastestFifty", track_obsessions.filter("days_to_50 IS NOT NULL"), "id", F.asc("days_to_50"), "days_to_50"), ("fastestHundred", track_obsessions.filter("days_to_100 IS NOT NULL"), "id", F.asc("days_to_100"), "days_to_100"),
        ("biggestComeback", gaps, "id", F.desc("gap_days"), "gap_days"),
        ("longestLost", lost, "id", F.asc("last_ts"), "days_since"), ("biggestObsession", track_obsessions, "id", F.desc("intensity"), "window_plays"), ("mostActiveYear", years, "year", F.desc("ms_played"), "plays"), ("longestSession", longest, "start_ts", F.desc("ms_played"), "ms_played"),
    ]
    rows = [df.orderBy(order, F.asc(key)).limit(1).select(F.lit(name).alias("record"), F.col(key).cast("string").alias("id"), F.col(value).cast("long").alias("value")) for name, df, key, order, value in tops]
    return reduce(DataFrame.unionByName, rows)


@query("r03_rediscovery")
def rediscovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's pick among the 60 best lost favourites. The date's digest chooses, so a day always gives the same one."""
    top = archive(spark, sf_dir).table("lost").filter("score >= 30").orderBy(F.desc("score"), F.desc("q_plays"), "id").limit(60)
    order = Window.orderBy(F.desc("score"), F.desc("q_plays"), "id")
    digest = F.conv(F.substring(F.md5(F.lit("2002-08-01").cast("binary")), 1, 8), 16, 10).cast("long")
    numbered = top.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("i", F.row_number().over(order) - 1)
    years = F.floor(F.col("days_since") / 365)
    reason = F.when(years >= 5, "years5").when(years >= 2, "years2").otherwise("quiet")
    return numbered.filter(F.col("i") == F.pmod(digest, F.col("n"))).select("id", "score", "days_since", reason.alias("reason"))


on_archive("r04_on_this_day", lambda a: pages.on_this_day(a, "06-15", "2001-06-15"))


@query("r07_rewind_year")
def rewind_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for 1998: totals, best month and day, late share, new tracks, and the year before."""
    built = archive(spark, sf_dir)
    e, year = built.events, F.col("year") == 1998
    totals = built.table("years").filter(year)
    months = built.table("monthly_artist").filter("ym LIKE '1998-%'").groupBy("ym").agg(F.sum("ms_played").alias("ms"))
    best_month = months.agg(F.max_by("ym", F.struct("ms", -F.regexp_replace("ym", "-", "").cast("int"))).alias("best_month"))
    best_day = built.table("days").filter("local_date LIKE '1998-%'").agg(F.max_by("local_date", F.struct("ms_played", -F.regexp_replace("local_date", "-", "").cast("int"))).alias("best_day"))
    late = e.filter(year).agg((p.count_if(p.night()) / F.count(F.lit(1))).alias("late_share"))
    first = built.table("tracks").filter(F.year(F.timestamp_millis("first_ts")) == 1998).agg(F.count(F.lit(1)).alias("new_tracks"))
    before = built.table("years").filter("year = 1997").agg(F.max("plays").alias("previous_plays"))
    # every side is one row
    return rounds(totals.crossJoin(best_month).crossJoin(best_day).crossJoin(late).crossJoin(first).crossJoin(before), "late_share")


@query("r07_vanished")
def vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of 2001 that were played often and last that year, a year or more ago."""
    built = archive(spark, sf_dir)
    per = built.table("monthly_track").filter("ym LIKE '2001-%'").groupBy("track_id").agg(F.sum("q_plays").alias("year_plays")).filter("year_plays >= 10")
    low, high = 978_307_200_000, 1_009_843_200_000
    last = built.table("tracks").filter((F.col("last_ts") >= low) & (F.col("last_ts") < high) & (F.col("last_ts") <= GRAVEYARD_NOW - 365 * DAY_MS))
    return per.join(last.select("track_id", "last_ts"), "track_id").orderBy(F.desc("year_plays"), "track_id").limit(12)


@query("r08_rewind_month")
def rewind_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month's most played tracks, without private plays."""
    rows = archive(spark, sf_dir).table("monthly_track").filter("ym = '1998-05'")
    return rows.select("track_id", "q_plays", "ms_played").orderBy(F.desc("q_plays"), F.desc("ms_played"), "track_id").limit(12)


@query("r09_random_month")
def random_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month that seed 4242 picks of those with 20 qualifying plays."""
    months = archive(spark, sf_dir).table("monthly_artist").groupBy("ym").agg(F.sum("q_plays").alias("q_plays")).filter("q_plays >= 20")
    numbered = months.withColumn("i", F.row_number().over(Window.orderBy("ym")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return numbered.filter(F.col("i") == F.lit(4242) % F.col("n")).select("ym", "q_plays")


on_short("r13_day_detail", lambda e: e.filter("local_date = '2024-01-03'").groupBy("track_id").agg(F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms_played")).orderBy(F.desc("plays"), F.desc("ms_played"), "track_id").limit(20))


@query("r14_session_detail")
def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, private ones and those of other listeners too, from the start to the end of a session."""
    e = short_view(spark, sf_dir)
    one = sessions.session_stats(e, 360).filter("listener = 8 AND session = 3").select("start_ts", "end_ts")
    inside = e.join(F.broadcast(one), (F.col("ts_ms") >= F.col("start_ts")) & (F.col("ts_ms") <= F.col("end_ts")))  # one row
    return inside.select("event_id", "ts_ms", "track_id", "ms_played", p.skip().cast("long").alias("skip"))


@query("r15_track_detail")
def track_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track 7 in one row, and its gap and comeback."""
    built = archive(spark, sf_dir)
    gap = sequences.gaps_of(built.table("sequence_track")).filter("id = 7").select("gap_days", "gap_from", "gap_to")
    return built.table("tracks").filter("track_id = 7").crossJoin(gap)  # one row each


@query("r15_milestones")
def track_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = archive(spark, sf_dir)
    return pages.milestones(built)


@query("r16_insights")
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.artist_insights(archive(spark, sf_dir))


on_archive("q09_artist_gaps", lambda a: sequences.gaps_of(a.table("sequence_artist")))


@query("r17_album_detail")
def album_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive(spark, sf_dir).table("album_tracks").filter("album_id = 'Brand#2|ECONOMY'")
    return rows.select("track_id", "plays", "ms_played").orderBy(F.desc("plays"), "track_id").limit(25)


def on_library(name: str, limit: int = 60, **page: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = table(spark, sf_dir, "part")
        names = parts.select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist"))
        flags = parts.select(F.col("p_partkey").alias("track_id"), (F.col("p_size") % 2).alias("favorite"), (F.col("p_size") % 3).alias("retired"))
        rows = names.join(archive(spark, sf_dir).table("tracks"), "track_id")
        return library.listed(rows, flags, _part_tags(spark, sf_dir), **page).limit(limit).select("track_id", "name", "artist", "q_plays", "last_ts")

    QUERIES[name] = run


on_library("r19_library_plays", status="favorite", sort="q_plays", descending=True)
on_library("r19_library_recent", status="tagged", sort="last_ts", descending=True)
on_library("r19_library_first", status="untagged", sort="first_ts")
on_library("r19_library_time", tag=12, sort="ms_played", descending=True)
on_library("r19_library_artist", text="BLUE", status="retired", sort="artist")


@query("r19_library")
def library_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks whose name holds a text in any case, by name."""
    stats = archive(spark, sf_dir).table("tracks")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("name"))
    return stats.join(parts, "track_id").filter(F.col("name").ilike("%RED%")).orderBy(F.lower("name"), "track_id").limit(100).select("track_id", "name", "q_plays")


# further parts of the pages
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, name, artist_id, artist) of the test tables' parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("name"), F.substring("p_brand", 7, 9).cast("long").alias("artist_id"), F.col("p_brand").alias("artist"))


for _filter, _text in (("oldFavorites", ""), ("forgottenAlbums", ""), ("deepCuts", ""), ("all", "red")):
    QUERIES[f"r05_lost_{_filter}"] = lambda s, d, f=_filter, t=_text: pages.lost_page(archive(s, d), _names(s, d), f, LOST_NOW, t)
on_archive("l02_top_artists_year", lambda a: pages.top_of_year(a, "artist", 1998))
on_archive("l03_top_albums_year", lambda a: pages.top_of_year(a, "album", 1998))
on_archive("r01_overview", pages.overview)
on_archive("r07_first_heard", lambda a: pages.first_heard(a, 788_918_400_000, 820_454_400_000))
on_archive("r07_obsession", lambda a: pages.obsession_between(a, 694_224_000_000, 883_612_800_000))
on_archive("r08_month_artists", lambda a: pages.month_artists(a, "1998-05"))
on_archive("r07_year_months", lambda a: pages.year_months(a, 1998))
on_archive("r07_year_hours", lambda a: pages.year_hours(a, 1998))
on_archive("r08_new_artists", lambda a: pages.new_artists(a, 788_918_400_000, 791_596_800_000))
on_short("q04_session_cards", lambda e: rounds(pages.session_cards(sessions.session_stats(e, 360)), "value"))
QUERIES["s19_highlights"] = lambda s, d: pages.highlights(archive(s, d), LOST_NOW, written(QUERIES["q19_eras"](s, d), "era-list"))
on_archive("r08_month_days", lambda a: pages.month_days(a, "1998-05"))
on_archive("r15_track_points", lambda a: pages.track_points(a, 7))
on_archive("r16_artist_lists", lambda a: pages.artist_lists(a, 2))
on_archive("r17_album_months", lambda a: pages.album_months(a, "Brand#2|ECONOMY"))
on_short("r13_day_artist", lambda e: pages.day_artist(e, "2024-01-03"))
on_short("r13_day_sessions", lambda e: pages.day_sessions(sessions.session_stats(e, 360), "2024-01-03").select("listener", "session", "start_ts", "events", "ms_played"))


# rules
def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = archive(spark, sf_dir)
    lost = built.table("lost").select(F.col("id").alias("track_id"), "q_plays", "plays", "ms_played", "skips", "first_ts", "last_ts", "score")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("tags"), (F.col("p_size") % 2).alias("favorite"))
    years = built.table("monthly_track").groupBy("track_id", F.substring("ym", 1, 4).cast("int").alias("year")).agg(F.sum("q_plays").alias("n"))
    best = peaks.first_of(years, "track_id", F.desc("n"), "year").select("track_id", F.col("year").alias("peak_year"))
    return lost.join(parts, "track_id").join(best, "track_id", "left").withColumn("retired", F.lit(None).cast("int"))


def _collected(spark: SparkSession, sf_dir: str, match: str, *rows: rules.Rule) -> DataFrame:
    return rules.collection(_tracks(spark, sf_dir), list(rows), match, LOST_NOW).select("track_id", "q_plays")


R = rules.Rule
QUERIES["c01_rules_all"] = lambda s, d: _collected(s, d, "all", R("qualifyingPlays", "gte", 20), R("skipRate", "lt", 60), R("firstHeardYear", "between", 1990, 1996), R("favorite", "isTrue", True))
QUERIES["c02_rules_any"] = lambda s, d: _collected(s, d, "any", R("msPlayed", "gt", 120), R("peakYear", "eq", 1999), R("daysSinceLastPlay", "gte", 900))
QUERIES["c03_rules_text"] = lambda s, d: _collected(s, d, "all", R("artist", "contains", "brand#1"), R("tag", "notContains", "RED"), R("album", "neq", "economy"))


# search
_INDEXES: dict[tuple[str, str], search.Index] = {}


def _text_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be found, in six kinds: parts are tracks, brands artists, brands' types albums, nations tags, regions collections, and eras."""
    parts, nations, regions = (table(spark, sf_dir, x) for x in ("part", "nation", "region"))
    artist = F.substring("p_brand", 7, 9).cast("long")
    tracks = parts.select(F.lit("track").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("subtitle"), artist.alias("artist_id"))
    artists = parts.select(F.lit("artist").alias("kind"), artist.cast("string").alias("id"), F.col("p_brand").alias("title"), F.lit("").alias("subtitle"), artist.alias("artist_id")).distinct()
    albums = parts.select(F.lit("album").alias("kind"), F.concat("p_brand", F.lit("|"), "p_type").alias("id"), F.col("p_type").alias("title"), F.col("p_brand").alias("subtitle"), artist.alias("artist_id")).distinct()
    found = QUERIES["q19_eras"](spark, sf_dir)
    era = found.select(F.lit("era").alias("kind"), F.concat_ws(":", "listener", "era").alias("id"), "title", F.concat_ws(" - ", "start_ym", "end_ym").alias("subtitle"), F.lit(None).cast("long").alias("artist_id"))
    tags = nations.select(F.lit("tag").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.lit("").alias("subtitle"), F.lit(None).cast("long").alias("artist_id"))
    sets = regions.select(F.lit("collection").alias("kind"), F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"), F.lit("The small ring of a region").alias("subtitle"), F.lit(None).cast("long").alias("artist_id"))
    return reduce(DataFrame.unionByName, [tracks, artists, albums, era, tags, sets])


def search_index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of the archive, written with its marts by the first search of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        built = archive(spark, sf_dir)
        parts = table(spark, sf_dir, "part")
        flags = parts.select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 2 == 0).alias("favorite"), (F.col("p_size") % 5 == 0).alias("retired"))
        tagged = parts.select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 25).cast("string").alias("tag"))
        _INDEXES[key] = search.build(f"{built.folder}/search/{built.manifest.marts}-{uuid.uuid4().hex}", _text_entries(spark, sf_dir), marts.search_attributes(built, flags, tagged))
    return _INDEXES[key]


def on_search(name: str, text: str, limit: int = 60, now: int = LOST_NOW, **filters: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = search.found(search_index(spark, sf_dir), text, search.Filters(**filters), now, limit)
        return rounds(page.select("kind", "id", "plays", "score"), "score", digits=4)

    QUERIES[name] = run


QUERIES["t03_search_match"] = lambda s, d: search.matching(search_index(s, d), "red brand 1").select("kind", "id")
QUERIES["t04_search_rank"] = lambda s, d: rounds(search.ranked(search_index(s, d), "small ring").select("kind", "id", "text_score", "score"), "text_score", "score")
on_search("t06_all", "brand 1")
on_search("t06_browse", "", kinds=("artist", "tag", "collection", "era"))
on_search("t06_kinds", "small", kinds=("album", "collection"))
on_search("t06_min_plays", "brand", min_plays=25, kinds=("track", "era"))
on_search("t06_year", "red", year=1999)
on_search("t06_first_heard", "", first_from=1996, first_to=1997)
on_search("t06_last_heard", "ring", last_from=2000, last_to=2001)
on_search("t06_artist", "", artist=7)
on_search("t06_tag", "blue", tag="3")
on_search("t06_lost", "", min_lost=45.0)
on_search("t06_favorite", "cold", status="favorite")
on_search("t06_retired", "hot", status="retired")
on_search("t06_dormant", "brand", status="dormant")
on_search("t06_active", "gear", now=1_008_000_000_000, status="active")


@query("t02_document_tokens")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent tokens of all documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(search.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(100)


# ingest
def _as_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = long_view(spark, sf_dir)
    return e.select("ts_ms", F.col("artist_id").alias("artist_key"), F.col("track_id").alias("track_key"), "ms_played", F.lit(None).cast("string").alias("platform"), "reason_end", F.lit("first").alias("file"), F.col("supplier_id").alias("row"), "year")


@query("s16_dedup")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that brings every event of 1998 twice: events kept by year."""
    rows = _as_import(spark, sf_dir)
    twice = rows.unionByName(rows.filter("year = 1998").withColumn("file", F.lit("second")))
    return history.merged(twice).groupBy("year").agg(F.count(F.lit(1)).alias("events"))


@query("x01_incremental_merge")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import of 1998 and 1999 adds to an archive that ends with 1998."""
    rows = _as_import(spark, sf_dir)
    added = history.merged(rows.filter("year >= 1998 AND year <= 1999"), rows.filter("year <= 1998"))
    return added.groupBy("year").agg(F.count(F.lit(1)).alias("events"))


@query("s20_reject_tally")
def reject_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and documents as export records, some broken on purpose: rejects by reason."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 7
    made = {
        "ts": F.when(n == 1, F.lit(None)).when(n == 2, F.lit("nonsense")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "ms_played": (F.col("value") * 1000).cast("string"),
        "master_metadata_track_name": F.when(n == 3, F.lit("  ")).otherwise(F.col("props")), "master_metadata_album_artist_name": F.when(n == 4, F.lit(None)).otherwise(F.col("event_type")), "episode_name": F.when(n == 5, F.lit("show")),
    }
    raw = e.select(F.lit("f").alias("file"), F.lit("h").alias("file_hash"), F.col("event_id").alias("row"), (n != 6).alias("is_object"), *[made.get(f, F.lit(None)).cast("string").alias(f) for f in history.FIELDS])
    return history.tally(history.normalised(raw))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most played tracks with their best month."""
    e = long_view(spark, sf_dir)
    top = rollups.track_stats(e, LOST_NOW).orderBy(F.desc("q_plays"), F.desc("ms_played"), "track_id").limit(50)
    return top.join(peaks.peak_month(e, "track"), "track_id", "left")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (statements.STATEMENTS | era_statements.STATEMENTS).items() if k in QUERIES}
