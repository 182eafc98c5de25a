"""The rebuild, ranks from histograms and sessions across listeners against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from playtrace.config import DAY_MS, Settings
from playtrace.operators import eras, peaks, rollups, scores, sequences, sessions
from playtrace.plans import marts, pages
from playtrace.sources import testbed
from playtrace.sources.testbed import calendar
from playtrace.streaming import live

SCHEMA = "ts_ms long, track_id long, artist_id long, album_id string, ms_played long, skipped boolean, reason_end string, incognito boolean, listener long"


def events(spark, rows):
    return calendar(spark.createDataFrame(rows, SCHEMA))


def some_rows(n=400, seed=7):
    r = random.Random(seed)
    return [(r.randrange(900) * DAY_MS + r.randrange(24) * 3_600_000, r.randrange(12), r.randrange(3), r.choice(["x", "y", None]), r.choice([10_000, 40_000, 90_000]), r.choice([True, None]), None, r.random() < 0.1, r.randrange(4)) for _ in range(n)]


@pytest.mark.parametrize("gap, block_ms", [(10, 3_600_000), (90, 3_600_000), (600, 60_000), (1, DAY_MS)])
def test_sessions_across_listeners(spark, gap, block_ms):
    r = random.Random(gap)
    times = sorted(r.randrange(3 * DAY_MS // 60_000) * 60_000 for _ in range(300))
    times += times[:40]  # repeated instants
    rows = [(t, 1, 1, None, 1000, None, None, False, i % 5) for i, t in enumerate(times)]
    want, last = [], None
    for t in sorted(times):
        if last is None or t - last > gap * 60_000:
            want.append([t, t, 0])
        want[-1][1], want[-1][2], last = t, want[-1][2] + 1, t
    got = sessions.across_listeners(events(spark, rows), gap, block_ms=block_ms).orderBy("session").collect()
    assert [(x.session, x.start_ts, x.end_ts, x.events, x.ms_played) for x in got] == [(i, a, b, n, n * 1000) for i, (a, b, n) in enumerate(want)]


def test_ranks_from_histograms(spark):
    e = events(spark, some_rows())
    counts = peaks.plays_by_year(e, "track").collect()
    got = {(x.track_id, x.year): x.rank_in_year for x in peaks.rank_in_year(e, "track").collect()}
    assert got == {(x.track_id, x.year): 1 + sum(y.year == x.year and y.n > x.n for y in counts) for x in counts}


def test_track_stats_count_days_and_months(spark):
    rows = some_rows()
    got = {x.track_id: (x.plays, x.distinct_days, x.active_months) for x in rollups.track_stats(events(spark, rows), 0).collect()}
    dated = events(spark, rows).filter("NOT incognito").collect()
    assert got == {k: (sum(x.track_id == k for x in dated), len({x.local_date for x in dated if x.track_id == k}), len({x.ym for x in dated if x.track_id == k})) for k in got}


@pytest.mark.parametrize("rows", [some_rows(), []], ids=["some", "none"])
def test_rebuild_and_pages(spark, tmp_path, rows):
    e = events(spark, rows)
    now = 2000 * DAY_MS
    built = marts.rebuild(e, str(tmp_path / "archive"), now, now)
    assert built.events.count() == len(rows)
    assert sorted(map(tuple, built.table("tracks").collect())) == sorted(map(tuple, rollups.track_stats(e, now).collect()))
    names = e.select("track_id", F.col("track_id").cast("string").alias("name"), "artist_id", F.lit("who").alias("artist")).dropDuplicates(["track_id"])
    best = built.table("lost").filter("score >= 30").count()
    for which in ("all", "deepCuts", "oldFavorites", "forgottenArtists", "forgottenAlbums", "years3", "years5", "years10"):
        assert pages.lost_page(built, names, which, now).count() <= best
    assert pages.lost_page(built, names, "all", now, "WHO").count() == pages.lost_page(built, names, "all", now).count()
    for page in (pages.overview(built), pages.top_of_year(built, "album", 1971), pages.first_heard(built, 0, now), pages.track_points(built, 1), pages.artist_lists(built, 1)):
        assert (page.count() == 0 or rows) or page.columns == ["section", "id", "value"]
    with pytest.raises(ValueError):
        pages.lost_page(built, names, "none such", now)


MARTS = (
    "tracks", "artists", "albums", "monthly_track", "monthly_artist", "monthly_album", "sequence_track", "sequence_artist", "sequence_album", "days", "years", "owned", "track_album", "album_tracks", "album_months",
    "track_hours", "hours", "played_years", "sessions", "obsessions_track", "obsessions_artist", "obsessions_album", "graveyard_track", "graveyard_artist", "graveyard_album", "track_peak_month", "artist_peak_month", "lost",
)
IDENTITY = ["ts_ms", "track_id", "artist_id", "ms_played", "listener"]
LOOSE = Settings(obsession_least_plays={"track": 3, "artist": 3, "album": 3}, obsession_least_window_plays=1, graveyard_least_plays={"track": 2, "artist": 2, "album": 2}, lost_least_plays=2)
NOW = 2000 * DAY_MS


def files(folder, name):
    return {str(x.relative_to(folder)): x.stat().st_mtime_ns for x in (folder / name).rglob("*.parquet")}


def rows_of(archive, name):
    return sorted(map(str, archive.table(name).collect()))


@pytest.mark.parametrize("late", ["some", "only known events"])
def test_a_late_file_touches_its_months_only(spark, tmp_path, late):
    rows = list({(x[0], x[1], x[2], x[4], x[8]): x for x in some_rows(500)}.values())
    days = lambda x: x[0] // DAY_MS
    new = [x for x in rows if 40 <= days(x) < 50 or 410 <= days(x) < 415]
    old = [x for x in rows if x not in new]
    whole = marts.rebuild(events(spark, rows), str(tmp_path / "whole"), NOW, NOW, LOOSE)
    folder = tmp_path / "archive"
    before = marts.rebuild(events(spark, old), str(folder), NOW, NOW, LOOSE)
    kept = {n: files(folder, n) for n in marts.MONTHLY}
    had = rows_of(before, "tracks")
    if late != "some":
        assert marts.updated(before, events(spark, old[:50]), IDENTITY, s=LOOSE) is before
        assert marts.manifests(spark, str(folder)) == [1]
        return
    after = marts.updated(before, events(spark, new + old[:20]), IDENTITY, s=LOOSE)
    for n in marts.MONTHLY:
        now = files(folder, n)
        assert kept[n].items() <= now.items(), "no file of the older version changes"
        fresh = {re.search("ym=([0-9-]+)", x)[1] for x in now.keys() - kept[n].keys()}
        assert fresh == {r.ym for r in events(spark, new).select("ym").distinct().collect()}
    assert sorted(map(str, after.events.select(sorted(after.events.columns)).collect())) == sorted(map(str, whole.events.select(sorted(after.events.columns)).collect()))
    for name in MARTS:
        assert rows_of(after, name) == rows_of(whole, name), name
    assert rows_of(before, "tracks") == had and before.events.count() == len(old), "a reader keeps its version"
    assert marts.opened(spark, str(folder)).manifest == after.manifest and after.manifest.number == 2


def test_marts_equal_those_from_events(spark, tmp_path):
    e = events(spark, some_rows(600, seed=11))
    a = marts.rebuild(e, str(tmp_path), NOW, NOW, LOOSE)
    same = {
        "artists": rollups.artist_stats(e, NOW, LOOSE), "albums": rollups.album_stats(e, NOW, LOOSE), "days": rollups.daily(e, LOOSE), "years": rollups.yearly(e, LOOSE), "hours": rollups.hourly(e, LOOSE), "monthly_album": rollups.monthly(e, "album", LOOSE),
        "sessions": sessions.across_listeners(e, s=LOOSE), "lost": scores.lost_favourites(e, NOW, LOOSE), **{f"graveyard_{k}": scores.graveyard(e, k, NOW, LOOSE) for k in rollups.KEYS}, **{f"obsessions_{k}": scores.obsessions(e, k, LOOSE) for k in rollups.KEYS},
    }
    for name, want in same.items():
        got = a.table(name)
        assert rows_of(a, name) == sorted(map(str, want.select(got.columns).collect())), name
        assert got.columns and (not name.startswith(("obs", "grave")) or got.count())


def test_staleness_and_versions(spark, tmp_path):
    folder, e = str(tmp_path), events(spark, some_rows(60))
    assert marts.stale(marts.opened(spark, folder), "a", NOW, NOW)
    a = marts.rebuild(e, folder, NOW, NOW, source="a")
    assert not marts.stale(marts.opened(spark, folder), "a", NOW, NOW)
    assert marts.stale(a, "b", NOW, NOW) and marts.stale(a, "a", NOW + 1, NOW) and marts.stale(a, "a", NOW, NOW, LOOSE)
    b = marts.rebuild(e.filter("track_id = 1"), folder, NOW, NOW, source="b")
    assert a.table("tracks").count() > 1 and b.table("tracks").count() == 1 and marts.opened(spark, folder).table("tracks").count() == 1
    with pytest.raises(RuntimeError):
        marts._publish(spark, folder, b.manifest)


def test_sweeping_keeps_what_the_last_manifests_name(spark, tmp_path):
    rows = list({(x[0], x[1], x[2], x[4], x[8]): x for x in some_rows(120)}.values())
    folder = str(tmp_path)
    first = marts.rebuild(events(spark, rows[:60]), folder, NOW, NOW)
    last = marts.updated(marts.updated(first, events(spark, rows[60:90]), IDENTITY), events(spark, rows[90:]), IDENTITY)
    tracks = rows_of(last, "tracks")
    assert marts.swept(last, keep=1) == 0, "all folders are young"
    assert marts.swept(last, keep=1, older_than_ms=-60_000) > 2
    assert marts.manifests(spark, folder) == [3] and [x.name for x in (tmp_path / "marts").iterdir()] == [last.manifest.marts]
    again = marts.opened(spark, folder)
    assert rows_of(again, "tracks") == tracks and again.events.count() == len(rows)
    versions = {(x.parent.name[3:], x.name[8:]) for x in (tmp_path / "events").glob("year=*/ym=*/version=*")}
    assert versions == set(again.manifest.months.items())


def test_months_are_pruned(spark, tmp_path):
    a = marts.rebuild(events(spark, some_rows(80)), str(tmp_path), NOW, NOW)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = a.events.filter("ym = '1970-02'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    held = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1]
    assert "1970-02" in held and "version" in held


def test_a_stream_keeps_an_archive_up_to_date(spark, tmp_path):
    rows = list({(x[0], x[1], x[2], x[4], x[8]): x for x in some_rows(200)}.values())
    folder = str(tmp_path / "archive")
    marts.rebuild(events(spark, rows[:100]), folder, NOW, NOW)
    events(spark, rows[80:]).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.keep_up(stream, folder, str(tmp_path / f"check{_}"), IDENTITY).awaitTermination()
    got, want = marts.opened(spark, folder), marts.rebuild(events(spark, rows), str(tmp_path / "whole"), NOW, NOW)
    assert got.manifest.number == 2 and rows_of(got, "artists") == rows_of(want, "artists")


@pytest.mark.parametrize("days", [(7,), (30, 200), (400,)])
def test_folded_sequences(spark, days):
    r = random.Random(sum(days))
    plays = [(k, r.randrange(1500) * DAY_MS // 2) for k in range(4) for _ in range((1, 5, 120, 400)[k])]
    plays += plays[-60:]  # repeated instants
    got = {x.id: x for x in sequences.folded(spark.createDataFrame(plays, "id int, ts_ms long"), days, (5, 100)).collect()}
    for k in range(4):
        times = sorted(t for i, t in plays if i == k)
        x = got[k]
        assert (x.n, x.first_ts, x.last_ts) == (len(times), times[0], times[-1])
        gap = max(((b - a, -b, a) for a, b in zip(times, times[1:], strict=False) if b > a), default=None)
        assert (x.gap_ms, x.gap_from, x.gap_to) == ((gap[0], gap[2], -gap[1]) if gap else (0, None, None))
        for d in days:
            best = max((sum(t - d * DAY_MS <= u <= t for u in times), -t) for t in times)
            inside = [u for u in times if -best[1] - d * DAY_MS <= u <= -best[1]]
            assert (x[f"d{d}_in"], x[f"d{d}_to"], x[f"d{d}_from"], x[f"d{d}_after"]) == (best[0], -best[1], inside[0], sum(u > -best[1] for u in times))
        assert [x[f"nth_{n}"] for n in (5, 100)] == [times[n - 1] if n <= len(times) else None for n in (5, 100)]


def test_folded_sequences_sort_plays_once_and_spread_one_entity(spark):
    plays = spark.range(4000).select((F.col("id") % 2).alias("id"), (F.col("id") * (DAY_MS // 2)).alias("ts_ms"))
    df = sequences.folded(plays, (7, 30, 90), (50,))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bSort \[.*ts_ms", plan)) == 1
    assert "ShuffledHashJoin" in plan


@pytest.mark.parametrize("days", [(7,), (30, 400)])
def test_folded_sequences_of_large_and_small_entities(spark, days):
    """Entities with over 100 plays lie in blocks, the others whole, and both as if they lay whole."""
    r = random.Random(sum(days))
    plays = [(k, r.randrange(1500) * DAY_MS // 2) for k in range(4) for _ in range((1, 5, 120, 400)[k])]
    df = spark.createDataFrame(plays + plays[-60:], "id int, ts_ms long")
    whole = sorted(map(str, sequences.folded(df, days, (5, 100)).collect()))
    assert sorted(map(str, sequences.folded(df, days, (5, 100), most=100).collect())) == whole
    assert sorted(map(str, sequences.folded(df, days, (5, 100), most=0).collect())) == whole


@pytest.mark.parametrize("rows", [some_rows(300), []], ids=["some", "none"])
def test_marts_on_demand(spark, tmp_path, rows):
    """Only what is read is derived, and equals a full rebuild's; an update completes the folds."""
    rows = list({(x[0], x[1], x[2], x[4], x[8]): x for x in rows}.values())
    bare = spark.createDataFrame(rows, SCHEMA)
    whole = marts.rebuild(calendar(bare), str(tmp_path / "whole"), NOW, NOW, LOOSE)
    a = marts.rebuild(bare, str(tmp_path / "lazy"), NOW, NOW, LOOSE, parts=calendar, on_demand=True)
    made = lambda: {x.name for x in (tmp_path / "lazy" / "marts").glob("*/*") if not x.name.startswith(".")}
    assert made() == set() and not (tmp_path / "lazy" / "by_day").exists()
    assert rows_of(a, "owned") == rows_of(whole, "owned") and made() == {"by_day", "owned"}
    a = marts.opened(spark, str(tmp_path / "lazy"))
    for name in MARTS:
        assert rows_of(a, name) == rows_of(whole, name), name
    assert pages.track_points(a, 1).count() == pages.track_points(whole, 1).count() and made() == {*MARTS, "by_day", "by_hour"}
    for name in ("by_day", "by_hour"):
        assert sorted(map(str, a.by_month(name, {"1970-02"}).collect())) == sorted(map(str, whole.by_month(name, {"1970-02"}).collect()))
    late = events(spark, [(500 * DAY_MS + 1, 3, 1, "x", 40_000, None, None, False, 0)])
    b, c = marts.updated(a, late, IDENTITY, s=LOOSE), marts.updated(whole, late, IDENTITY, s=LOOSE)
    for name in ("tracks", "hours", "sequence_track", "lost"):
        assert rows_of(b, name) == rows_of(c, name), name


def test_tasks_of_folds_grow_with_the_rows(spark, monkeypatch):
    e = events(spark, some_rows(200))
    want = [sorted(map(str, fold(e).collect())) for fold in (marts.by_day, marts.by_hour)]
    monkeypatch.setattr(marts, "TASK_ROWS", 20)
    assert [sorted(map(str, fold(e).collect())) for fold in (marts.by_day, marts.by_hour)] == want
    assert [fold(e).rdd.getNumPartitions() for fold in (marts.by_day, marts.by_hour)] == [10, 10]


def test_folds_are_dealt_once(spark, tmp_path, monkeypatch):
    a = marts.rebuild(events(spark, some_rows(80)), str(tmp_path), NOW, NOW)
    for fold in (marts.by_day, marts.by_hour):
        df = fold(a.events)
        df.collect()
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[1].count("Exchange") == 1
    monkeypatch.setattr(marts, "TASK_ROWS", 8)
    df = marts.track_stats(a.by_month("by_day"), spark.createDataFrame([], "track_id long, recent_plays long"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2, "the days, and the recent plays"


def test_tasks_of_events_and_marts_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """Whatever the session's number of shuffle partitions: events as they are written, and marts with nearly as many groups as rows."""
    monkeypatch.setattr(marts, "TASK_ROWS", 20)
    a = marts.rebuild(events(spark, some_rows(200)), str(tmp_path), NOW, NOW, LOOSE, on_demand=True)
    assert len({x.name[:10] for x in (tmp_path / "events").rglob("part-*")}) > 4
    first, _ = marts.makers(a, None, LOOSE)
    days, hours = a.by_month("by_day").filter("NOT incognito").count(), a.by_month("by_hour").count()
    for name, rows in (("monthly_track", days), ("track_hours", hours)):
        assert first[name]().rdd.getNumPartitions() == -(-rows // 20) > 4, name
    assert "Expand" not in first["days"]()._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_sorted_once_as_they_are_written(spark, tmp_path):
    a = marts.rebuild(events(spark, some_rows(80)), str(tmp_path), NOW, NOW, on_demand=True)
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [done.apply(i).physicalPlanDescription() for i in range(done.size())]
    written = next(x for x in reversed(plans) if "WriteFiles" in x and str(tmp_path) in x and "/events" in x)
    assert len(re.findall(r"^.*\bSort \(", written.split("Initial Plan")[0], re.M)) == 1
    assert a.events.count() == 80


def test_sequences_and_eras_are_dealt_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(rollups, "TASK_ROWS", 100)
    plays = spark.range(2000).select((F.col("id") % 7).alias("id"), (F.col("id") * (DAY_MS // 9)).alias("ts_ms"))
    df = sequences.folded(plays, (7,), (5,))
    assert "hashpartitioning(id#" in (plan := df._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan
    months = spark.range(2000).select(F.lit(1).alias("listener"), (F.col("id") % 900).alias("track_id"), F.lit("2001-02").alias("ym"), F.lit(1).alias("q_plays"), F.col("id").alias("ms_played"))
    found = spark.createDataFrame([(1, 0, "2001-01", "2001-03")], "listener int, era long, start_ym string, end_ym string")
    led = [eras._leading(found, months, "track_id", [F.desc("ms_played")], dealt=x) for x in (True, False)]
    assert sorted(map(str, led[0].collect())) == sorted(map(str, led[1].collect()))
    assert ", 20), REPARTITION_BY_NUM" in led[0]._jdf.queryExecution().executedPlan().toString()


def test_lines_meet_many_parts_in_bounded_tasks(spark, monkeypatch):
    """Where parts are too many to be sent whole, tasks grow with the lines and not with the session's shuffle partitions."""
    few = testbed.long_view(spark, "/root/testdata/sf0.001")
    want, lines = sorted(map(str, few.collect())), testbed.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    monkeypatch.setattr(testbed, "MOST_PARTS", 10)
    monkeypatch.setattr(rollups, "TASK_ROWS", 500)
    many = testbed.long_view(spark, "/root/testdata/sf0.001")
    assert many.rdd.getNumPartitions() == -(-lines // 500) > 4
    assert sorted(map(str, many.collect())) == want


def test_days_are_folded_by_date_alone(spark):
    """Year and month follow from the date: they are given, but not dealt or grouped by."""
    df = marts.by_day(events(spark, some_rows(80)))
    assert all((x.year, x.ym) == (int(x.local_date[:4]), x.local_date[:7]) for x in df.collect())
    grouped = re.findall(r"HashAggregate\(keys=\[(.*?)\]", df._jdf.queryExecution().executedPlan().toString())
    assert grouped and not any("ym#" in keys or "year#" in keys for keys in grouped)
