import json
import zipfile

import pytest

from playtrace.sources import history
from playtrace.streaming import live

GOOD = {"ts": "2020-05-01T10:00:00Z", "ms_played": 200_000, "master_metadata_track_name": "Song", "master_metadata_album_artist_name": "Band", "spotify_track_uri": "spotify:track:1", "platform": "Windows 10", "conn_country": "de", "skipped": "false", "shuffle": "true", "username": "secret", "ip_addr_decrypted": "1.2.3.4"}
LEGACY = {"endTime": "2019-01-02 03:04", "artistName": "Bänd", "trackName": "Song", "msPlayed": "214000"}


def written(folder, name, rows):
    path = folder / name
    path.write_text(json.dumps(rows))
    return path


def read(spark, folder):
    return history.normalised(history.raw_records(history.read_files(spark, str(folder))))


@pytest.mark.parametrize(("change", "reason"), [
    ({"ts": None}, "missing-timestamp"), ({"ts": "nonsense"}, "invalid-timestamp"), ({"master_metadata_track_name": None}, "missing-track"), ({"master_metadata_album_artist_name": "  "}, "missing-artist"),
    ({"episode_name": "x"}, "podcast"), ({"audiobook_title": "x", "episode_name": ""}, "audiobook"), ({}, None), ({"ms_played": {"odd": 1}}, None),
])
def test_reject_reasons(spark, tmp_path, change, reason):
    written(tmp_path, "Streaming_History_1.json", [GOOD | change])
    assert read(spark, tmp_path).first()["reject_reason"] == reason


def test_not_an_object_and_private(spark, tmp_path):
    written(tmp_path, "endsong_0.json", [GOOD, GOOD | {"incognito_mode": True}, 42, None])
    rows = history.normalised(history.raw_records(history.read_files(spark, str(tmp_path))), drop_private=True)
    assert sorted(str(r["reject_reason"]) for r in rows.collect()) == ["None", "incognito-excluded", "not-an-object", "not-an-object"]
    assert {r["reject_reason"]: r["n"] for r in history.tally(rows).collect()} == {"incognito-excluded": 1, "not-an-object": 2}


@pytest.mark.parametrize(("given", "want"), [(-50, 0), (999_999_999, 86_400_000), ("214000", 214_000), (None, 0), ("", 0), ("x", 0), (1.5, 2)])
def test_milliseconds(spark, tmp_path, given, want):
    written(tmp_path, "a.json", [GOOD | {"ms_played": given}])
    assert read(spark, tmp_path).first()["ms_played"] == want


@pytest.mark.parametrize(("given", "want"), [("2020-05-01T10:00:00Z", 1588327200000), (1588327200, 1588327200000), (1588327200000, 1588327200000), ("2020-05-01 10:00", 1588327200000), ("2020-05-01 10:00:07", 1588327207000), ("2020-05-01T12:00:00+02:00", 1588327200000)])
def test_timestamps(spark, tmp_path, given, want):
    written(tmp_path, "a.json", [GOOD | {"ts": given}])
    assert read(spark, tmp_path).first()["ts_ms"] == want


def test_fields(spark, tmp_path):
    written(tmp_path, "a.json", [GOOD, LEGACY])
    a, b = read(spark, tmp_path).orderBy("row").collect()
    assert (a["platform"], a["country"], a["skipped"], a["shuffle"], a["offline"], a["incognito"]) == ("windows", "DE", False, True, None, False)
    assert (b["artist_name"], b["ms_played"], b["platform"], b["uri"]) == ("Bänd", 214_000, None, None)
    assert not {"username", "ip_addr_decrypted"} & set(a.asDict())


@pytest.mark.parametrize(("raw", "family"), [("Chromecast", "web"), ("webos tv", "web"), ("Android TV", "android"), ("kiosk", "ios"), ("OS X 10", "macos"), ("sonos", "partner"), ("cast device", "cast"), ("toaster", "other"), (None, None)])
def test_platform_families(spark, raw, family):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(raw,)], "p string").select(history.platform_family(F.col("p"))).first()[0] == family


def test_folder_and_zip_are_equal_and_reimport_adds_nothing(spark, tmp_path):
    rows = [GOOD | {"ts": f"2020-05-01T10:{i:02d}:00Z"} for i in range(30)]
    folder, other = tmp_path / "folder", tmp_path / "zipped"
    folder.mkdir(), other.mkdir()
    written(folder, "Streaming_History_1.json", rows)
    written(folder, "Userdata.json", [{"name": "x"}])
    written(folder, "broken.json", "nonsense")
    with zipfile.ZipFile(other / "export.zip", "w") as z:
        z.writestr("my/Streaming_History_1.json", json.dumps(rows))
        z.writestr("my/Payments.json", "[]")
    first, second = (history.keyed(read(spark, x)) for x in (folder, other))
    assert first.count() == second.count() == 30
    assert history.merged(second, first).count() == 0
    both = history.raw_records(history.read_files(spark, str(tmp_path)))
    assert history.one_copy_per_file(both).count() == 30
    report = history.import_report(read(spark, tmp_path), history.merged(history.keyed(read(spark, tmp_path)))).first()
    assert (report["found"], report["inserted"], report["duplicate"], report["invalid"]) == (60, 30, 30, 0)


def test_corrupt_archive():
    with pytest.raises(history.SourceError) as e:
        list(history.unzip("x.zip", b"no archive"))
    assert e.value.code == "CORRUPT_ARCHIVE"


def test_identity_keeps_nulls_apart(spark):
    rows = [(1, "a", "t", 5, None, "x"), (1, "a", "t", 5, "x", None), (1, "a", "t", 5, None, "x")]
    df = spark.createDataFrame([(*r, "f", i) for i, r in enumerate(rows)], "ts_ms long, artist_key string, track_key string, ms_played long, platform string, reason_end string, file string, row int")
    assert history.merged(df).count() == 2
    assert df.select(history.fingerprint()).distinct().count() == 2


def test_name_keys():
    assert history.name_key("  The  Café–Bar’s ") == "the cafe-bar's"
    assert history.name_key("") == "" and history.name_key("!!!") == "!!!" and history.name_key(None) is None
    assert history.slugify("Çok  Güzel!") == "cok-guzel" and history.slugify("***") == "tag"


def test_names_of_files():
    assert history.looks_like_history("x/Streaming_History_Audio_1.json") and history.looks_like_history("endsong_3.json")
    assert not history.looks_like_history("Userdata.json")
    assert sorted(["f10", "f2", "f1"], key=history.natural) == ["f1", "f2", "f10"]


def test_csv_equals_a_plain_writer(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [("=1+1", 3, 61.0), ("plain, text", 5, 0.5), ('say "hi"', 5, None), ("two\nlines", 4, -2.0), (None, 1, 7.25), *[(f"Läng {i}", 0, float(i)) for i in range(500)]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, name string, q_plays long, score double").repartition(7)
    size = history.write_csv(df, str(tmp_path / "out.csv"), F.desc("q_plays"), F.asc("id"))

    def cell(x):
        text = "" if x is None else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
        text = f"'{text}" if text[:1] in tuple("=+-@\t\r") else text
        return '"' + text.replace('"', '""') + '"' if set(text) & set('",\n') else text

    lines = ["id,name,q_plays,score", *(",".join(map(cell, (i, *r))) for i, r in sorted(enumerate(rows), key=lambda x: (-x[1][1], x[0])))]
    want = b"\xef\xbb\xbf" + "\r\n".join(lines).encode()
    assert (tmp_path / "out.csv").read_bytes() == want and size == len(want)
    assert [x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")] == ["out.csv"]
    history.write_csv(df.limit(0), str(tmp_path / "none.csv"), F.desc("q_plays"))
    assert (tmp_path / "none.csv").read_bytes() == b"\xef\xbb\xbfid,name,q_plays,score"


def test_track_rows(spark):
    df = spark.createDataFrame([("Song", "Band", None, None, 3, 2, 89_999, 1_000, 1_588_327_200_000, 2020, 61.0), ("New", "Band", "Disc", "u", None, None, None, None, None, None, None)], "track_name string, artist_name string, album_name string, uri string, plays long, q_plays long, ms_played long, first_ts long, last_ts long, peak_year int, score double")
    a, b = history.track_rows(df).collect()
    assert tuple(a) == ("Song", "Band", None, 3, 2, 1, "1970-01-01T00:00:01.000Z", "2020-05-01T10:00:00.000Z", 2020, 61.0, None)
    assert tuple(b) == ("New", "Band", "Disc", 0, 0, 0, None, None, None, 0.0, "u")


def hour(i):
    return GOOD | {"ts": f"2020-05-{1 + i // 24:02d}T{i % 24:02d}:00:00Z"}


def test_only_named_files_of_the_whole_selection_are_read(spark, tmp_path):
    one, two, deep = tmp_path / "one", tmp_path / "two", tmp_path / "one" / "/".join("abcdefghi")
    for x in (one / ".hidden", two, deep):
        x.mkdir(parents=True)
    written(one, "renamed.json", [hour(0)])
    written(two, "Streaming_History_10.json", [hour(1)])
    written(two, "Streaming_History_2.json", [hour(1), hour(2)])
    written(two, "notes.json", [hour(3)])
    written(deep, "Streaming_History_9.json", [hour(4)])
    written(one / ".hidden", "Streaming_History_7.json", [hour(5)])
    with zipfile.ZipFile(two / "export.ZIP", "w") as z:
        z.writestr("my/endsong_1.json", json.dumps([hour(6)]))
        z.writestr("my/other.json", json.dumps([hour(7)]))
        z.writestr("__MACOSX/my/endsong_2.json", json.dumps([hour(8)]))
    (two / "bad.zip").write_bytes(b"no archive")
    rows = history.normalised(history.selection(spark, str(one), str(two)))
    got = {(r.file.rsplit("/", 1)[-1], r.row, r.reject_reason) for r in rows.collect()}
    assert got == {("Streaming_History_10.json", 0, None), ("Streaming_History_2.json", 0, None), ("Streaming_History_2.json", 1, None), ("endsong_1.json", 0, None), ("bad.zip", -1, "corrupt-archive")}
    kept = history.merged(history.keyed(rows)).filter("hour(timestamp_millis(ts_ms)) = 1").collect()
    assert [r.file.rsplit("/", 1)[-1] for r in kept] == ["Streaming_History_2.json"], "2 stands before 10"
    assert {r.file.rsplit("/", 1)[-1] for r in history.selection(spark, str(one)).collect()} == {"renamed.json"}
    with pytest.raises(history.SourceError) as e:
        history.selection(spark, str(tmp_path / "nowhere"))
    assert e.value.code == "NOT_FOUND"


def test_faults_inside_archives_cost_their_entries_only(spark, tmp_path):
    path = tmp_path / "export.zip"
    body = json.dumps([hour(i) for i in range(40)])
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("endsong_1.json", body)
        z.writestr("endsong_2.json", json.dumps([hour(50)]))
        z.writestr("endsong_3.json", json.dumps([hour(51)]))
    data = bytearray(path.read_bytes())
    at = data.index(b"endsong_1.json") + len("endsong_1.json")
    data[at + 5 : at + 25] = b"\xff" * 20  # the deflated bytes
    flags = [i for i in range(len(data)) if data[i : i + 4] == b"PK\x01\x02"][2] + 8
    data[flags] |= 1  # an encrypted entry
    path.write_bytes(bytes(data))
    got = sorted((r.file.rsplit("!", 1)[-1], str(r.reject_reason)) for r in history.normalised(history.selection(spark, str(tmp_path))).collect())
    assert got == [("endsong_1.json", "corrupt-archive"), ("endsong_2.json", "None"), ("endsong_3.json", "corrupt-archive")]


def test_the_ledger_survives_a_crash(spark, tmp_path, monkeypatch):
    from playtrace.sources import ledger

    source, folder = tmp_path / "in", str(tmp_path / "archive")
    source.mkdir()
    written(source, "endsong_1.json", [hour(i) for i in range(30)])
    append = ledger._append

    def crash(spark, folder, row):
        if row[1] == "complete":
            raise OSError("gone")
        append(spark, folder, row)

    monkeypatch.setattr(ledger, "_append", crash)
    with pytest.raises(OSError):
        ledger.bring_in(spark, folder, "first", 1_000, str(source))
    monkeypatch.undo()
    assert spark.read.parquet(f"{folder}/events").count() == 30 and ledger.seen(spark, folder).count() == 0
    again = ledger.bring_in(spark, folder, "second", 2_000, str(source)).first()
    assert (again.events_found, again.events_inserted, again.events_duplicate, again.state) == (30, 0, 30, "complete")
    assert spark.read.parquet(f"{folder}/events").count() == 30 and ledger.seen(spark, folder).count() == 1
    written(source, "endsong_2.json", [hour(i) for i in range(28, 40)] + [{"no": "record"}])
    (source / "copy.json").write_bytes((source / "endsong_1.json").read_bytes())  # not named, not looked at
    (source / "endsong_10.json").write_bytes((source / "endsong_2.json").read_bytes())
    third = ledger.bring_in(spark, folder, "third", 3_000, str(source)).first()
    assert (third.file_count, third.events_found, third.events_inserted, third.events_duplicate, third.events_invalid) == (3, 13, 10, 2, 1)
    assert [(r.import_id, r.state, r.finished_ms) for r in ledger.recent(spark, folder).collect()] == [("third", "complete", 3_000), ("second", "complete", 2_000), ("first", "started", None)]
    assert ledger.recent(spark, folder, 1).count() == 1
    took = ledger._table(spark, folder, "files", ledger.FILES).filter("import_id = 'third'").collect()
    assert {(r.file.rsplit("/", 1)[-1], r.events_found, r.skipped) for r in took} == {("endsong_1.json", 0, True), ("endsong_2.json", 13, False), ("endsong_10.json", 0, True)}


def test_entities_calendar_and_export(spark, tmp_path):
    rows = [hour(0), hour(1) | {"master_metadata_track_name": "SONG", "spotify_track_uri": None}, hour(2) | {"master_metadata_album_album_name": "Disc"}, hour(3) | {"master_metadata_album_artist_name": "bänd"}]
    written(tmp_path, "endsong_1.json", rows)
    events = history.keyed(history.normalised(history.selection(spark, str(tmp_path))))
    artists, albums, tracks = history.entities(events)
    assert sorted(r["name"] for r in artists.collect()) == ["Band"] or sorted(r["name"] for r in artists.collect()) == ["Band", "bänd"]
    assert [r["name"] for r in albums.collect()] == ["Disc"]
    assert {(r["name"], r["uri"]) for r in tracks.collect()} == {("Song", "spotify:track:1")}
    late = history.localised(events, "Asia/Tokyo").orderBy("ts_ms").first()
    assert (late.local_date, late.ym, late.year, late.hour, late.dow) == ("2020-05-01", "2020-05", 2020, 9, 5)
    history.export_json(events, str(tmp_path / "back"))
    back = history.keyed(history.normalised(history.raw_records(spark.read.text(str(tmp_path / "back")).selectExpr("'endsong_9.json' AS path", "CAST(concat('[', value, ']') AS BINARY) AS content"))))
    assert sorted(x.fingerprint for x in back.collect()) == sorted(x.fingerprint for x in events.collect())


def test_streaming_merge_and_rollups(spark, tmp_path):
    rows = [(int(t) * 60_000, 1, "k", "t", 40_000, None, "x", False) for t in (0, 10, 100, 3000, 9000)]
    schema = "ts_ms long, listener int, artist_key string, track_key string, ms_played long, platform string, reason_end string, incognito boolean"
    source, archive = str(tmp_path / "in"), str(tmp_path / "archive")
    for _ in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = live.event_stream(spark, source, spark.createDataFrame([], schema).schema)
    live.merge_into(stream.drop("at"), archive, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(archive).count() == 5
    one = live.event_stream(spark, archive, spark.read.parquet(archive).schema)
    q = live.sessions(one).writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert [(r["start_ts"], r["events"]) for r in spark.table("sess").orderBy("start_ts").collect()][:2] == [(0, 2), (6_000_000, 1)]
    q = live.daily(one).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    assert {r["local_date"]: r["plays"] for r in spark.table("days").collect()} == {"1970-01-01": 3, "1970-01-03": 1, "1970-01-07": 1}
