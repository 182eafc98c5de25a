import math

import pytest
from pyspark.sql import functions as F

from playtrace.config import DAY_MS
from playtrace.functions import curves as c
from playtrace.operators import eras, library, rules, search, sequences, sessions

D = DAY_MS


def plays(spark, rows):
    return spark.createDataFrame([(i, int(t), "2020-01") for i, t in rows], "id int, ts_ms long, ym string")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_densest_window_takes_closed_intervals(spark):
    got = sequences.densest(plays(spark, [(1, d * D) for d in (0, 1, 2, 3, 200, 300)] + [(2, 0), (2, 7 * D)]), 7)
    rows = {r["id"]: r for r in got.collect()}
    assert (rows[1]["plays_in"], rows[1]["from_ts"], rows[1]["to_ts"], rows[1]["plays_after"]) == (4, 0, 3 * D, 2)
    assert rows[2]["plays_in"] == 2


def test_longest_gap_first_wins_and_none_is_zero(spark):
    got = {r["id"]: r for r in sequences.longest_gap(plays(spark, [(1, d * D) for d in (0, 5, 300, 595)] + [(2, 4), (2, 4), (3, 9)])).collect()}
    assert (got[1]["gap_days"], got[1]["gap_from"], got[1]["gap_to"]) == (295, 5 * D, 300 * D)
    assert (got[2]["gap_ms"], got[2]["gap_from"]) == (0, None)
    assert got[3]["gap_days"] == 0


def test_days_to_nth_play(spark):
    got = sequences.days_to_nth(plays(spark, [(1, 2 * d * D) for d in range(60)])).first()
    assert (got["days_to_50"], got["days_to_100"]) == (98, None)


def test_monthly_run_breaks_at_gaps_and_weak_months(spark):
    months = {"2020-01": 5, "2020-02": 5, "2020-03": 1, "2020-04": 5, "2020-05": 5, "2020-06": 5, "2020-08": 5}
    rows = [(1, 0, m) for m, n in months.items() for _ in range(n)]
    assert sequences.monthly_run(spark.createDataFrame(rows, "id int, ts_ms long, ym string")).first()["longest_run"] == 3


def test_streak_takes_the_earliest_of_equals(spark):
    days = spark.createDataFrame([(d,) for d in ("2020-01-01", "2020-01-02", "2020-02-01", "2020-02-02", "2020-03-05")], "local_date string")
    got = sequences.daily_streak(days).first()
    assert (got["days"], got["from_date"]) == (2, "2020-01-01")


def test_a_gap_of_exactly_the_limit_stays_in_the_session(spark):
    rows = [(1, i, t * 60_000, "t", "a", 1000, False) for i, t in enumerate((0, 30, 61))]
    events = spark.createDataFrame(rows, "listener int, event_id int, ts_ms long, track_id string, artist_id string, ms_played long, incognito boolean")
    assert [r["session"] for r in sessions.sessionised(events, 30).orderBy("ts_ms").collect()] == [0, 0, 1]
    assert sessions.by_session_window(events, 30).count() == 2


@pytest.mark.parametrize(("counts", "low", "high"), [([10], 0, 0), ([5, 5, 5, 5], 1, 1), ([50, 5, 3, 2], 0.01, 0.8)])
def test_session_diversity(spark, counts, low, high):
    rows = [(1, 0, i, f"t{k}", i) for k, n in enumerate(counts) for i in range(n)]
    events = spark.createDataFrame(rows, "listener int, session int, event_id int, track_id string, ts_ms long")
    got = sessions.favourite(events, ["listener", "session"], "track_id").first()
    assert low - 1e-9 <= got["diversity"] <= high + 1e-9
    assert got["top"] == "t0"


def test_curves(spark):
    assert value(spark, c.clamp01(F.lit(float("nan")))) == 0
    assert value(spark, c.clamp01(F.lit(float("inf")))) == 1
    assert value(spark, c.log_scale(F.lit(5), 9, 3)) == 0
    assert value(spark, c.log_scale(F.lit(400), 5, 400)) == 1
    assert value(spark, c.dormancy(F.lit(0))) == 0
    assert value(spark, c.dormancy(F.lit(2920))) == 1
    assert value(spark, c.dormancy(F.lit(365))) == pytest.approx(math.log1p(365 / 30) / math.log1p(2920 / 30))
    assert value(spark, c.graveyard(F.lit(25), F.lit(730), F.lit(None).cast("int"), 25)) < value(spark, c.graveyard(F.lit(25), F.lit(730), F.lit(1), 25))


def test_rules(spark):
    row = dict(track_id=1, q_plays=20, plays=25, ms_played=60_000, skips=5, first_ts=1_300_000_000_000, last_ts=1_300_000_000_000, score=1.0, peak_year=2011, artist="The Ärzte", album=None, tags=None, favorite=1, retired=0)
    df = spark.createDataFrame([row], "track_id int, q_plays long, plays long, ms_played long, skips long, first_ts long, last_ts long, score double, peak_year int, artist string, album string, tags string, favorite int, retired int")

    def hit(*rows, match="all"):
        return df.filter(rules.compile_rules([rules.Rule(*r) for r in rows], match, 1_400_000_000_000)).count() == 1

    assert hit()
    assert hit(("plays", "between", 20, 30)) and hit(("plays", "between", 20)) and not hit(("plays", "between", 21, 30))
    assert hit(("plays", "gt", "abc")) and hit(("plays", "nonsense", 20))
    assert hit(("artist", "contains", "ärz")) and not hit(("artist", "notContains", "the"))
    assert hit(("tag", "notContains", "x")) and not hit(("tag", "neq", "x")) and not hit(("tag", "eq", "x"))
    assert hit(("favorite", "odd", None)) and not hit(("favorite", "isFalse", None))
    assert hit(("plays", "lt", 1), ("skipRate", "eq", 20), match="any")
    assert hit(("firstHeardYear", "eq", 2011))
    with pytest.raises(rules.RuleError):
        hit(("mood", "eq", 1))


ENTRY = "kind string, id string, title string, subtitle string, artist_id long"
KNOWN = "kind string, id string, " + search.ATTRIBUTES


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    entries = [("track", "1", "AC/DC", "Thunder", 1), ("artist", "2", "Björk", "", 2), ("track", "3", "thunder road road", "", 1), ("album", "4", "Road & Sky", "Björk", 2), ("era", "5", "The Road Years", "2001-01 - 2002-02", None), ("tag", "6", "Road", "", None), ("collection", "7", "Дорога road", "", None)]
    known = [("track", "1", 9, 5, 978_307_200_000, 1_009_843_200_000, 40.0, True, None, ["a"], [2001]), ("track", "3", 2, 5, 1_009_843_200_000, 1_020_000_000_000, 10.0, False, True, ["a", "b"], [2002]), ("artist", "2", 7, 5, 978_307_200_000, 1_020_000_000_000, None, None, None, None, [2001, 2002])]
    return search.build(str(tmp_path_factory.mktemp("index") / "one"), spark.createDataFrame(entries, ENTRY), spark.createDataFrame(known, KNOWN))


def test_search(index):
    ids = lambda q: sorted(r["id"] for r in search.matching(index, q).collect())
    assert ids("AC/DC") == ["1"] and ids("bjork") == ["2", "4"] and ids("thun") == ["1", "3"] and ids("***") == [] and ids("road thunder x") == []
    assert ids("alder & ash") == [] and ids("road & sky") == ["4"] and ids("дор") == ["7"]
    assert search.ranked(index, "thunder road").first()["id"] == "3"
    assert search.ranked(index, "***").count() == 0


@pytest.mark.parametrize(("query", "filters", "want"), [
    ("road", {}, "34567"), ("", {}, "1234567"), ("***", {"kinds": ("era", "tag")}, "56"), ("road", {"kinds": ("track", "album")}, "34"), ("", {"min_plays": 2}, "123"), ("", {"year": 2001}, "12567"),
    ("", {"first_from": 2001, "first_to": 2001}, "12"), ("", {"last_from": 2002}, "123"), ("", {"last_to": 2001}, ""), ("", {"artist": 2}, "24"), ("", {"tag": "b"}, "3"), ("", {"min_lost": 20.0}, "1"),
    ("thunder", {"status": "favorite"}, "1"), ("", {"status": "retired"}, "3"), ("", {"status": "dormant"}, "1"), ("", {"status": "active"}, "23"),
])
def test_search_filters(index, query, filters, want):
    found = search.found(index, query, search.Filters(**filters), 1_009_843_200_000 + 365 * D if filters.get("status") != "active" else 1_020_000_000_000 + 180 * D, 50).collect()
    assert "".join(sorted(r["id"] for r in found)) == want
    assert [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)


def test_search_pages_and_reads_its_letters_only(index):
    whole = [r["id"] for r in search.found(index, "road", search.Filters(), 0, 50).collect()]
    assert [r["id"] for r in search.found(index, "road", search.Filters(), 0, 2, 2).collect()] == whole[2:4]
    with pytest.raises(ValueError):
        search.Filters(status="none such").condition(0)
    spark = index.spark
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = search.ranked(index, "sky road")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [letter" in plan and "IN (r,s)" in plan


def test_era_settling_follows_the_order_of_steps():
    a, b = {"x": 1.0}, {"y": 1.0}
    months = [a] * 6 + [b] * 6
    plays_ = [20] * 12
    d = [0.0] * 6 + [1.0] + [0.0] * 5
    assert eras.settle(d, [6], months, plays_) == [(0, 5, 0.0), (6, 11, 1.0)]
    assert eras.settle(d, [6], [a] * 12, plays_) == [(0, 11, 0.0)]
    # one odd month inside is short and weak, and joins the neighbour that it resembles more
    d2 = [0.0, 0, 0, 0.5, 0.5] + [0.0] * 7
    assert eras.settle(d2, [3, 4], [a] * 3 + [{"x": 0.4, "y": 1.0}] + [b] * 8, plays_) == [(0, 2, 0.0), (3, 11, 0.5)]
    assert eras.settle([0.0] * 4, [], [a] * 4, [20] * 4) == []
    assert eras.settle([0.0] * 8, [], [a] * 8, [0, 20, 20, 20, 20, 20, 20, 2]) == [(1, 6, 0.0)]


def test_era_titles(spark):
    def made(n1, n2, s1, s2, months, a="2019-01", b="2020-03"):
        second = F.lit(n2) if n2 else F.lit(None).cast("string")
        return value(spark, eras.title(F.lit(n1), second, F.lit(s1), F.lit(s2), F.lit(months), F.lit(a), F.lit(b)))

    assert made("The Owls", "Fox", 0.6, 0.1, 4) == "The Owls Period"
    assert made("Owls", "A Fox", 0.35, 0.3, 12) == "The Owls / Fox Era"
    assert made("Owls", "Fox", 0.09, 0.08, 20) == "The 2019–2020 Stretch"
    assert made("The ", None, 0.5, 0.0, 20, "2019-01", "2019-12") == "The The  Years"


def test_library(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, name string")
    assert sorted(library.upserted(old, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert library.removed(old, new, ["id"]).collect() == [(1, "a")]
    empty = spark.createDataFrame([], "tag_id int, name string, icon string, color string")
    assert library.seeded(empty).count() == 8 and library.seeded(library.seeded(empty)).count() == 8
    sets = library.seeded_collections(spark.createDataFrame([], "name string, description string, match string, rules string"))
    assert [r["name"] for r in sets.collect()] == ["Lost Classics", "Forgotten 2010s", "Still Standing"] and library.seeded_collections(sets).count() == 3
    tracks = spark.createDataFrame([(1, "Bell", "X"), (2, "apple", "Y")], "track_id int, name string, artist string")
    flags = spark.createDataFrame([(1, 1, 0)], "track_id int, favorite int, retired int")
    tags = spark.createDataFrame([(2, 5)], "track_id int, tag_id int")
    assert [r["track_id"] for r in library.listed(tracks, flags, tags).collect()] == [2, 1]
    assert [r["track_id"] for r in library.listed(tracks, flags, tags, status="favorite").collect()] == [1]
    assert [r["track_id"] for r in library.listed(tracks, flags, tags, status="untagged").collect()] == [1]
    assert library.orphans(spark.createDataFrame([(1,), (9,)], "track_id int"), tracks).collect() == [(9,)]
