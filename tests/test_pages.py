"""Pages and small operators on rows that tell near definitions apart."""

import math

import pytest
from pyspark.sql import functions as F

from playtrace.config import DAY_MS, Settings
from playtrace.operators import eras, library, sessions
from playtrace.plans import marts, pages
from playtrace.sources.testbed import calendar

SCHEMA = "ts_ms long, track_id long, artist_id long, album_id string, ms_played long, skipped boolean, reason_end string, incognito boolean, listener long"
NOW = 4000 * DAY_MS
HOUR = 3_600_000


def play(day, hour=12, track=1, artist=1, album="x", ms=40_000, private=False):
    return (day * DAY_MS + hour * HOUR, track, artist, album, ms, None, None, private, 1)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    rows = [play(i, 23 if i < 16 else 12, track=1 + i % 3) for i in range(40)]  # 40 plays, 16 at night, of three tracks
    rows += [play(i, 23, track=9, artist=2) for i in range(39)]  # 39 plays, all at night
    rows += [play(i, track=4, artist=3, ms=10_000) for i in range(60)] + [play(60 + i, track=5, artist=3) for i in range(20)]  # short plays count for the leading track
    rows += [play(1000, track=6, artist=4)] * 2 + [play(1300 + i, track=6, artist=4) for i in range(4)] + [play(1310, track=6, artist=4, private=True)]  # a return: five plays since, one of them private
    rows += [play(1000, track=7, artist=5), play(1400, track=7, artist=5)]  # a silence, no return
    rows += [play(2000 + i, track=8, artist=6, private=True) for i in range(5)]  # a month with private plays only
    e = calendar(spark.createDataFrame(rows, SCHEMA))
    return marts.rebuild(e, str(tmp_path_factory.mktemp("pages")), NOW, NOW, Settings())


def test_insights(archive):
    got = {r.artist_id: r for r in pages.artist_insights(archive).collect()}
    assert (got[1].nocturnal, got[1].night_plays, got[2].nocturnal) == (True, 16, False)
    assert (got[3].one_track, got[3].best) == (True, 60) and got[1].one_track
    assert (got[4].gap_days, got[4].plays_since, got[4].returned) == (300, 5, True)
    assert (got[5].gap_days, got[5].plays_since, got[5].returned) == (400, 1, False)
    assert got[1].gap_days is None and got[1].returned is None and 6 not in got
    assert (got[4].from_year, got[4].to_year, got[4].percent) == (1972, 1973, 100) and got[5].from_year == 1972


def test_milestones(archive):
    rows = pages.milestones(archive, archive.spark.createDataFrame([(6,), (7,)], "track_id long")).collect()
    kinds = {(r.track_id, r.kind): r for r in rows}
    assert set(kinds) == {(6, "first-heard"), (6, "peak-month"), (6, "longest-absence"), (6, "comeback"), (6, "last-heard"), (7, "first-heard"), (7, "peak-month"), (7, "longest-absence"), (7, "last-heard")}
    assert (kinds[6, "comeback"].ts_ms, kinds[6, "comeback"].n, kinds[6, "comeback"].days) == (1300 * DAY_MS + 12 * HOUR, 5, 300)
    assert kinds[6, "longest-absence"].ts_ms == 1000 * DAY_MS + 12 * HOUR
    every = pages.milestones(archive).filter("track_id = 9 AND kind = 'play-count'").orderBy("n").collect()
    assert [(r.n, r.days) for r in every] == [(10, 9), (25, 24)]
    assert kinds[7, "peak-month"].ts_ms % DAY_MS == 0


def test_private_months_have_no_page(archive):
    months = {r.ym for r in archive.table("monthly_artist").select("ym").distinct().collect()}
    assert "1975-06" not in months and archive.events.filter("ym = '1975-06'").count() == 5
    assert pages.month_artists(archive, "1975-06").count() == 0
    assert [r.plays for r in pages.year_hours(archive, 1975).orderBy("hour").collect()] == [5 if h == 12 else 0 for h in range(24)]
    assert pages.year_months(archive, 1975).count() == 0


def test_days_and_new_artists(archive):
    rows = pages.on_this_day(archive, "01-05").collect()
    assert [(r.local_date, r.plays, r.top_artist, r.top_track) for r in rows] == [("1970-01-05", 3, 1, 2)]
    assert pages.on_this_day(archive, "01-05", "1970-01-05").count() == 0
    assert [r.artist_id for r in pages.new_artists(archive, 0, DAY_MS).collect()] == [1, 2, 3]
    assert pages.heatmap(archive, "1970-01-01", "1970-01-02", "plays").count() == 2
    with pytest.raises(ValueError):
        pages.heatmap(archive, "", "", "none such")


def test_highlights_and_lifetime(archive):
    none = archive.spark.range(0)
    cards = {r.card: (r.a, r.b) for r in pages.highlights(archive, NOW, none).collect()}
    assert cards["years"] == (4, 1970) and cards["biggestYear"][0] == 1970 and "eras" not in cards and "totalTime" in cards
    life = {r.id: r.value for r in pages.overview(archive).filter("section = 'lifetime'").collect()}
    assert life["streams"] == archive.events.count() and life["plays"] == life["streams"] - 6


def test_orders_of_sessions(spark):
    rows = [(1, 0, 10, 0, 0.5, 2, 3), (1, 1, 10, 0, 0.5, 3, 3), (1, 2, 12, 0, 0.1, 1, 3), (1, 3, 5, 9, 0.9, 5, 9)]
    df = spark.createDataFrame(rows, "listener int, session int, events int, start_ts int, diversity double, artists int, max_repeats int")
    assert [r.session for r in sessions.session_list(df, "diverse", 9).collect()] == [1, 0, 2]
    assert [r.session for r in sessions.session_list(df, "repetitive", 9).collect()] == [2, 0, 1]
    assert [r.session for r in sessions.session_list(df, "most", 9).collect()] == [2, 0, 1, 3]


def test_names_and_eras_at(spark):
    found = spark.createDataFrame([(1, 0, "A", "2001-01", "2001-06"), (1, 1, "B", "2001-08", "2002-01"), (2, 0, "C", "2001-01", "2001-03")], "listener int, era long, title string, start_ym string, end_ym string")
    names = spark.createDataFrame([(1, "2001-08", " My year "), (2, "2001-01", "  "), (3, "2001-01", "none")], "listener int, start_ym string, custom_title string")
    assert {(r.listener, r.era): (r.title, r.auto_title) for r in eras.with_names(found, names).collect()} == {(1, 0): ("A", "A"), (1, 1): ("My year", "B"), (2, 0): ("C", "C")}
    months = spark.createDataFrame([(1, "2001-06"), (1, "2001-07"), (2, "2001-02"), (9, "2001-02")], "listener int, ym string")
    assert {(r.listener, r.ym): r.era for r in eras.at(found, months).collect()} == {(1, "2001-06"): 0, (1, "2001-07"): None, (2, "2001-02"): 0, (9, "2001-02"): None}


def test_eras_of_listeners_do_not_mix(spark):
    months = [(who, 1 + (m >= 12) + 10 * who, f"{2000 + m // 12}-{m % 12 + 1:02d}", 20, 20, 1_000) for who in (1, 2) for m in range(24)]
    df = spark.createDataFrame(months, "listener int, track_id int, ym string, plays long, q_plays long, ms_played long")
    vectors, every = eras.month_vectors(df, "track_id"), eras.calendar_months(df)
    distances = eras.boundaries(vectors, every)
    found = eras.segments(vectors, every, distances, eras.change_points(distances))
    assert sorted((r.listener, r.era, r.start_ym, r.end_ym) for r in found.collect()) == [(w, i, f"200{i}-01", f"200{i}-12") for w in (1, 2) for i in (0, 1)]
    full = eras.era_measures(found, df.withColumnRenamed("track_id", "artist_id"), df).orderBy("listener", "era").collect()
    assert [(r.streams, r.new_artists, r.leaders, r.tracks) for r in full[:2]] == [(240, 1, ["11"], ["11"]), (240, 1, ["12"], ["12"])]


def test_library_tables(spark):
    tracks = spark.createDataFrame([(1, "One", 10, 5, None), (2, "Two", 10, None, "u2"), (3, "Three", 11, 9, "u3")], "track_id int, name string, artist_id int, album_id int, uri string")
    artists = spark.createDataFrame([(10, "Band", None), (11, "Solo", "own")], "artist_id int, name string, uri string")
    albums = spark.createDataFrame([(5, "Disc")], "album_id int, name string")
    stats = spark.createDataFrame([(1, 4, 3, 1, 100), (2, 9, 9, 0, 200)], "track_id int, plays int, q_plays int, skips int, ms_played int")
    rows = {r.track_id: r for r in library.track_summaries(tracks, artists.drop("uri"), albums, stats).collect()}
    assert (rows[1].artist, rows[1].album, rows[1].skip_rate) == ("Band", "Disc", 0.25) and (rows[3].plays, rows[3].skip_rate, rows[3].album) == (0, 0.0, None)
    known = tracks.join(stats.select("track_id", "q_plays"), "track_id", "left").fillna(0, ["q_plays"])
    assert {r.artist_id: r.uri for r in library.with_fallback_uri(artists, "artist_id", known.select("artist_id", "track_id", "uri", "q_plays")).collect()} == {10: "u2", 11: "own"}
    subjects = library.entities(("artist", artists.select(F.col("artist_id").alias("id"), "name", "uri")), ("album", albums.select(F.col("album_id").alias("id"), "name", F.lit("Band").alias("secondary"))))
    notes = spark.createDataFrame([("artist", "10", "old", 1), ("album", "5", "new", 2), ("track", "99", "lost", 2)], "kind string, id string, text string, updated_ts long")
    assert [(r.kind, r.name, r.secondary) for r in library.notes_with_subjects(notes, subjects).collect()] == [("album", "Disc", "Band"), ("track", None, None), ("artist", "Band", None)]
    tags = spark.createDataFrame([(1, "Love"), (2, "Night")], "tag_id int, name string")
    assert {r.tag_id: r.uses for r in library.tag_usage(tags, spark.createDataFrame([(7, 1), (7, 1), (8, 1)], "track_id int, tag_id int")).collect()} == {1: 2, 2: 0}


def test_cosine_pairs_by_cells_equal_all_pairs(spark):
    """Several chunks and blocks of queries; copies, vectors of zeros, nulls, other lengths and NaN."""
    from random import Random

    from playtrace.plans.catalogue import similar

    r = Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows = [(i, rows[50][1]) if i % 90 == 0 else (i, x) for i, x in rows] + [(700, [0.0] * 8), (750, None), (751, [None] * 8), (800, [1.0] * 5), (801, [2.0] * 5), (850, [float("nan")] * 8), (900, [])]
    got = {(x.query_id, x.vec_id): x.cosine for x in similar(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.25, 8).collect()}

    def unit(x):
        n = math.sqrt(sum(v * v for v in x))
        return [v / n for v in x]

    held = [(i, unit(x)) for i, x in rows if x and None not in x and any(x)]
    want = {(i, j): sum(a * b for a, b in zip(x, y, strict=True)) for i, x in held if i % 50 == 0 for j, y in held if i != j and len(x) == len(y)}
    want = {k: c for k, c in want.items() if not c < 0.25}
    assert set(got) == set(want) and len(want) > 1000
    assert all(math.isnan(c) or abs(c - got[k]) < 1e-6 for k, c in want.items())
