"""The archive: events and folds by month, marts over them, and a manifest that says which of them belong together.

Events and their folds (counts by track and date, by track and hour) lie by year, month and version. A mart is derived from
the folds, not from the events; only what depends on the order of plays or on instants reads events. So an import that
touches a few months writes those months anew, folds them, and derives the marts from small tables, while sequence measures are
computed again for the entities that it touched. Nothing is overwritten: new months and marts have a version of their own,
and readers see them once a manifest with the next number is in place. A reader keeps the version that it opened.

An archive on demand has only its events written; a fold or mart is derived and written when a page first reads it.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import playtrace
from playtrace.config import DAY_MS, DEFAULTS, Settings
from playtrace.functions import predicates as p
from playtrace.operators import peaks, rollups, scores, sequences, sessions
from playtrace.shared import discard, written
from playtrace.sources import history

#: Tables that lie by month.
MONTHLY = ("events", "by_day", "by_hour")


def engine() -> str:
    """A name for the code that builds marts: other code, other marts."""
    root = Path(playtrace.__file__).parent
    files = [x for part in ("config.py", "functions", "operators", "plans", "sources") for x in sorted([root / part] if part.endswith(".py") else (root / part).glob("*.py"))]
    return hashlib.sha256(b"".join(x.read_bytes() for x in files)).hexdigest()[:16]


@dataclass(frozen=True)
class Manifest:
    """What belongs together: the version of each month, that of the marts, and what they were made from."""

    number: int = 0
    months: dict = field(default_factory=dict)
    marts: str = ""
    schemas: dict = field(default_factory=dict)
    engine: str = ""
    source: str = ""
    settings: dict = field(default_factory=dict)
    clocks: tuple = (0, 0)
    made_ms: int = 0
    on_demand: bool = False


@dataclass(frozen=True)
class Archive:
    """A folder of months and marts, read as one manifest names them."""

    spark: SparkSession
    folder: str
    manifest: Manifest

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/marts/{self.manifest.marts}/{name}"
        if self.manifest.on_demand:
            _on_demand(self, name, path)
        return self.spark.read.parquet(path)

    def by_month(self, name: str, months: set[str] | None = None) -> DataFrame:
        """A table that lies by month; Spark reads only the folders of the manifest's versions."""
        if name not in self.manifest.schemas:
            path = f"{self.folder}/marts/{self.manifest.marts}/{name}"
            _on_demand(self, name, path)
            rows = self.spark.read.schema(_by_month_last(_FOLDS[name](self.events, tasks=1)).schema).parquet(path)
            return rows if months is None else rows.filter(F.col("ym").isin(*months) if months else F.lit(False))
        versions: dict[str, list[str]] = {}
        for ym, version in sorted(self.manifest.months.items()):
            if months is None or ym in months:
                versions.setdefault(version, []).append(ym)
        known = reduce(lambda a, b: a | b, [(F.col("version") == v) & F.col("ym").isin(yms) for v, yms in versions.items()], F.lit(False))
        schema = T.StructType.fromJson(json.loads(self.manifest.schemas[name]))
        return self.spark.read.schema(schema.add("version", "string")).parquet(f"{self.folder}/{name}").filter(known).drop("version")

    @property
    def events(self) -> DataFrame:
        return self.by_month("events")


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, folder: str) -> list[int]:
    where, files = _files(spark, f"{folder}/manifests")
    names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())


def opened(spark: SparkSession, folder: str) -> Archive | None:
    """The archive as its last manifest names it; None where there is none."""
    numbers = manifests(spark, folder)
    if not numbers:
        return None
    text = spark.read.text(f"{folder}/manifests/{numbers[-1]:08d}.json", wholetext=True).first()[0]
    held = json.loads(text)
    return Archive(spark, folder, Manifest(**held | {"clocks": tuple(held["clocks"])}))


def _publish(spark: SparkSession, folder: str, manifest: Manifest) -> Archive:
    """Put a manifest in place by a rename, which readers see whole or not at all; fails if another has its number."""
    where, files = _files(spark, f"{folder}/manifests/{manifest.number:08d}.json")
    draft, _ = _files(spark, f"{folder}/manifests/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()
    if files.exists(where) or not files.rename(draft, where):
        files.delete(draft, False)
        raise RuntimeError(f"another rebuild has published {where}")
    return Archive(spark, folder, manifest)


def stale(archive: Archive | None, source: str, lost_now: int, graveyard_now: int, s: Settings = DEFAULTS) -> bool:
    """Whether marts must be made anew: other code, settings, clocks or sources, or none yet."""
    m = archive and archive.manifest
    return not m or (m.engine, m.source, m.settings, tuple(m.clocks)) != (engine(), source, json.loads(json.dumps(asdict(s))), (lost_now, graveyard_now))


# ---- folds: what marts need of a month


# Each is dealt once, by range of some of its keys: so a month has few files, and the grouping needs no second shuffle.
# Hardly two events share all keys, so that sums by task before the shuffle would save nothing.

TASK_ROWS = rollups.TASK_ROWS


def _tasks(rows: DataFrame) -> int:
    return rollups.tasks_of(rows, TASK_ROWS)


def by_day(events: DataFrame, s: Settings = DEFAULTS, tasks: int | None = None) -> DataFrame:
    keys = ["local_date", "track_id", "artist_id", "album_id", "incognito"]
    rows = events.select(*keys, "ms_played", "ts_ms", p.qualifying(s).alias("q"), p.skip(s).alias("skip"), p.night().alias("night"))
    folded = rows.repartitionByRange(tasks or _tasks(events), "local_date", "track_id").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("plays"), p.count_if(F.col("q")).alias("q_plays"), F.sum("skip").alias("skips"), F.sum("ms_played").alias("ms_played"), p.count_if(F.col("night")).alias("night_plays"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"),
    )
    # year and month follow from the date, and are neither dealt nor grouped by
    return folded.withColumns({"year": F.substring("local_date", 1, 4).cast("int"), "ym": F.substring("local_date", 1, 7)})


def by_hour(events: DataFrame, s: Settings = DEFAULTS, tasks: int | None = None) -> DataFrame:
    keys = ["year", "ym", "track_id", "hour", "dow", "incognito"]
    rows = events.select(*keys, "ms_played", p.qualifying(s).alias("q")).repartitionByRange(tasks or _tasks(events), "ym", "track_id", "hour")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("plays"), p.count_if(F.col("q")).alias("q_plays"), F.sum("ms_played").alias("ms_played"))


_FOLDS = {"by_day": by_day, "by_hour": by_hour}


def _by_month_last(df: DataFrame) -> DataFrame:
    """Columns in the order in which a table that lies by month is read."""
    parts = ["year", "ym"]
    return df.select(*[c for c in df.columns if c not in parts], *parts)


_SUMS = ("plays", "q_plays", "skips", "ms_played")


def _sums(*columns: str):
    return [F.sum(c).alias(c) for c in columns]


def _span():
    return [F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")]


def recents(events: DataFrame, kind: str, now: int, s: Settings = DEFAULTS) -> DataFrame:
    """(key, recent_plays): qualifying plays of the last days before ``now``; only the months they lie in are read."""
    key, since = rollups.KEYS[kind], now - s.recent_days * DAY_MS
    # a zone shifts a month's edge by a day at most
    first = time.strftime("%Y-%m", time.gmtime((since - DAY_MS) / 1000))
    late = p.visible(events.filter(F.col("ym") >= first), s).filter(p.recent(now, s) & F.col(key).isNotNull())
    return late.groupBy(key).agg(F.count(F.lit(1)).alias("recent_plays"))


def track_stats(days: DataFrame, recent: DataFrame) -> DataFrame:
    # dealt once by track, which serves all three groupings
    dealt = days.select("track_id", "local_date", *_SUMS, "first_ts", "last_ts").repartition(_tasks(days), "track_id")
    dates = dealt.groupBy("track_id", "local_date").agg(*_sums(*_SUMS), *_span())
    rows = dates.groupBy("track_id").agg(*_sums(*_SUMS), *_span(), F.count("local_date").alias("distinct_days"), F.countDistinct(F.substring("local_date", 1, 7)).alias("active_months"))
    rows = rows.withColumn("short_plays", F.col("plays") - F.col("q_plays")).join(recent, "track_id", "left").fillna(0, ["recent_plays"])
    return rows.select("track_id", "plays", "q_plays", "short_plays", "skips", "ms_played", "first_ts", "last_ts", "distinct_days", "active_months", "recent_plays")


def artist_stats(days: DataFrame, recent: DataFrame) -> DataFrame:
    """Counts of distinct things come from rows folded to them, which is cheaper than several distinct counts at once."""
    dates = days.groupBy("artist_id", "local_date").agg(*_sums(*_SUMS, "night_plays"), *_span())
    rows = dates.groupBy("artist_id").agg(*_sums(*_SUMS, "night_plays"), *_span(), F.count("local_date").alias("distinct_days"))
    for name, key in (("tracks", "track_id"), ("albums", "album_id")):
        rows = rows.join(days.filter(F.col(key).isNotNull()).select("artist_id", key).distinct().groupBy("artist_id").agg(F.count(F.lit(1)).alias(name)), "artist_id", "left")
    rows = rows.join(recent, "artist_id", "left").fillna(0, ["recent_plays", "tracks", "albums"])
    return rows.select("artist_id", *_SUMS, "first_ts", "last_ts", "tracks", "albums", "distinct_days", "recent_plays", "night_plays")


def year_stats(a: Archive) -> DataFrame:
    """Years from the marts of days and months."""
    rows = a.table("days").groupBy(F.substring("local_date", 1, 4).cast("int").alias("year")).agg(*_sums("plays", "q_plays", "ms_played"), F.count(F.lit(1)).alias("distinct_days"))
    for kind, key in rollups.KEYS.items():
        seen = a.table(f"monthly_{kind}").select(F.substring("ym", 1, 4).cast("int").alias("year"), key).distinct()
        rows = rows.join(seen.groupBy("year").agg(F.count(F.lit(1)).alias(f"{kind}s")), "year", "left").fillna(0, [f"{kind}s"])
    return rows.select("year", "plays", "q_plays", "ms_played", "tracks", "artists", "albums", "distinct_days")


def album_stats(days: DataFrame, recent: DataFrame) -> DataFrame:
    rows = days.filter("album_id IS NOT NULL").groupBy("album_id").agg(*_sums(*_SUMS), *_span(), F.countDistinct("track_id").alias("tracks"))
    return rows.join(recent, "album_id", "left").fillna(0, ["recent_plays"]).select("album_id", *_SUMS, "first_ts", "last_ts", "tracks", "recent_plays")


_STATS = {"track": track_stats, "artist": artist_stats, "album": album_stats}


def owned(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Qualifying plays of each artist's tracks."""
    return p.visible(events, s).groupBy("artist_id", "track_id").agg(p.count_if(p.qualifying(s)).alias("q_plays"))


Makers = dict[str, Callable[[], DataFrame]]


def makers(a: Archive, sequence: Callable[[str], DataFrame], s: Settings) -> tuple[Makers, Makers]:
    """How each mart is derived: those from months, and those that read other marts. ``sequence`` gives the sequence fold of a kind."""
    lost_now, graveyard_now = a.manifest.clocks
    events = a.events

    def hours() -> DataFrame:
        return a.by_month("by_hour")

    def days() -> DataFrame:
        return p.visible(a.by_month("by_day"), s)

    def held() -> DataFrame:
        return a.by_month("by_day").filter("album_id IS NOT NULL")

    def dealt(rows: DataFrame, *keys: str) -> DataFrame:
        """Rows whose groups are nearly as many as they: dealt to bounded tasks first, which need no second shuffle."""
        return rows.repartition(_tasks(rows), *keys)

    def years_of(kind: str) -> DataFrame:
        key = F.col(rollups.KEYS[kind])
        rows = a.by_month("by_day").filter(key.isNotNull()).select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), "year")
        return (dealt(rows, "id", "year") if kind == "track" else rows).distinct()

    def monthly(kind: str) -> DataFrame:
        key = rollups.KEYS[kind]
        rows = days().filter(F.col(key).isNotNull()).select(key, "ym", "plays", "q_plays", "ms_played")
        return (dealt(rows, key, "ym") if kind == "track" else rows).groupBy(key, "ym").agg(*_sums("plays", "q_plays", "ms_played"))

    def daily() -> DataFrame:
        """Tracks are counted as rows of dealt groups, artists apart from them: no row is copied for each distinct count."""
        per = dealt(days().select("local_date", "track_id", "plays", "q_plays", "ms_played", "first_ts", "last_ts"), "local_date", "track_id")
        per = per.groupBy("local_date", "track_id").agg(*_sums("plays", "q_plays", "ms_played"), *_span())
        rows = per.groupBy("local_date").agg(*_sums("plays", "q_plays", "ms_played"), F.count("track_id").alias("tracks"), *_span())
        artists = days().select("local_date", "artist_id").distinct().groupBy("local_date").agg(F.count("artist_id").alias("artists"))
        return rows.join(artists, "local_date", "left").fillna(0, ["artists"]).select("local_date", "plays", "q_plays", "ms_played", "tracks", "artists", "first_ts", "last_ts")

    def gone(kind: str) -> DataFrame:
        key = rollups.KEYS[kind]
        recent = recents(events, kind, graveyard_now, s)
        stats = a.table(f"{kind}s").drop("recent_plays").join(recent, key, "left").fillna(0, ["recent_plays"])
        months = a.table(f"monthly_{kind}")
        yearly = months.groupBy(key, F.substring("ym", 1, 4).cast("int").alias("year")).agg(F.sum("q_plays").alias("n"))
        return scores.graveyard_of(stats, yearly, kind, graveyard_now, s, months if kind == "album" else None)

    def obsessed(kind: str) -> DataFrame:
        months = a.table(f"monthly_{kind}").filter("q_plays > 0").select(F.col(rollups.KEYS[kind]).alias("id"), "ym", F.col("q_plays").alias("n"))
        return scores.obsessions(events, kind, s, fold=a.table(f"sequence_{kind}"), months=months)

    def peak_month(kind: str) -> DataFrame:
        key = rollups.KEYS[kind]
        best = peaks.first_of(a.table(f"monthly_{kind}"), key, F.desc("q_plays"), F.desc("plays"), "ym")
        return best.select(key, F.col("ym").alias("peak_ym"), F.col("q_plays").alias("peak_ym_plays"))

    first = {
        **{f"{k}s": lambda k=k: _STATS[k](days(), recents(events, k, lost_now, s)) for k in _STATS}, **{f"monthly_{k}": lambda k=k: monthly(k) for k in _STATS}, **{f"sequence_{k}": lambda k=k: sequence(k) for k in _STATS},
        "days": daily,
        "owned": lambda: days().groupBy("artist_id", "track_id").agg(*_sums("plays", "q_plays")),
        "track_album": lambda: peaks.first_of(held().groupBy("track_id", "album_id").agg(*_sums("plays")), "track_id", F.desc("plays"), "album_id"),
        "album_tracks": lambda: held().groupBy("album_id", "track_id").agg(*_sums("plays", "q_plays", "ms_played")),
        "album_months": lambda: held().groupBy("album_id", "ym").agg(*_sums("plays", "q_plays", "ms_played")),
        "track_hours": lambda: dealt(hours().select("track_id", "hour", "plays", "q_plays", "ms_played"), "track_id", "hour").groupBy("track_id", "hour").agg(*_sums("plays", "q_plays", "ms_played")),
        "hours": lambda: p.visible(hours(), s).groupBy("hour", "dow").agg(*_sums("plays", "ms_played")),
        "played_years": lambda: reduce(DataFrame.unionByName, [years_of(k) for k in _STATS]),
        "sessions": lambda: sessions.across_listeners(events, s=s),
    }
    second = {
        "years": lambda: year_stats(a),
        **{f"obsessions_{k}": lambda k=k: obsessed(k) for k in _STATS}, **{f"graveyard_{k}": lambda k=k: gone(k) for k in _STATS}, **{f"{k}_peak_month": lambda k=k: peak_month(k) for k in ("track", "artist")},
        "lost": lambda: scores.lost_favourites(events, lost_now, s, a.table("tracks"), a.table("sequence_track")),
    }
    return first, second


def derived(a: Archive, put: Callable[[str, DataFrame], None], sequence: Callable[[str], DataFrame], s: Settings, at_once: int) -> None:
    """Write every mart of an archive whose months are written."""
    with ThreadPoolExecutor(at_once) as pool:
        for group in makers(a, sequence, s):
            for done in [pool.submit(lambda n=name, f=make: put(n, f())) for name, make in group.items()]:
                done.result()


def _on_demand(a: Archive, name: str, path: str) -> None:
    """Derive and write a fold or mart if it isn't there: beside its place, which it takes whole by a rename."""
    where, files = _files(a.spark, path)
    if files.exists(where):
        return
    s = Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in a.manifest.settings.items()})

    def sequence(kind: str) -> DataFrame:
        key = rollups.KEYS[kind]
        return scores.folds(a.events, kind, s, a.table(f"{kind}s").select(F.col(key).alias("id"), F.col("q_plays").alias("n")))

    draft, _ = _files(a.spark, f"{path.rsplit('/', 1)[0]}/.{name}-{uuid.uuid4().hex}")
    if name in _FOLDS:
        _FOLDS[name](a.events, s).write.option("compression", "zstd").partitionBy("year", "ym").parquet(draft.toString())
    else:
        first, second = makers(a, sequence, s)
        (first | second)[name]().write.option("compression", "zstd").parquet(draft.toString())
    if files.exists(where) or not files.rename(draft, where):
        files.delete(draft, True)


def search_attributes(a: Archive, flags: DataFrame, tagged: DataFrame) -> DataFrame:
    """(kind, id, ...) of what search filters and ranks by: numbers of tracks, artists and albums, the years they were played in,
    and of tracks the score as lost favourite, flags (id, favorite, retired) and tags (id, tag)."""
    none = F.lit(None).cast("double").alias("lost_score")
    parts = []
    for kind, key in rollups.KEYS.items():
        rows = a.table(f"{kind}s").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col("q_plays").alias("plays"), "ms_played", "first_ts", "last_ts")
        if kind == "track":
            rows = rows.join(a.table("lost").select(F.col("id").cast("string").alias("id"), F.col("score").alias("lost_score")), "id", "left").join(flags, "id", "left")
            rows = rows.join(tagged.groupBy("id").agg(F.collect_set("tag").alias("tags")), "id", "left")
        else:
            rows = rows.select("*", none, F.lit(None).cast("boolean").alias("favorite"), F.lit(None).cast("boolean").alias("retired"), F.lit(None).cast("array<string>").alias("tags"))
        parts.append(rows)
    # a row per entity and year; the calendar bounds the years of one
    years = a.table("played_years").groupBy("kind", "id").agg(F.collect_set("year").alias("years"))
    return years.join(reduce(DataFrame.unionByName, parts), ["kind", "id"], "full")


def _put_months(df: DataFrame, folder: str, name: str, version: str, again: bool = False) -> dict[str, str]:
    """Write whole months of a table under a version, in place of what a broken off call left there if ``again``. Its schema by name."""
    df = _by_month_last(df)
    out = df.withColumn("version", F.lit(version)).write.mode("overwrite" if again else "append").option("partitionOverwriteMode", "dynamic")
    out.option("compression", "zstd").partitionBy("year", "ym", "version").parquet(f"{folder}/{name}")
    return {name: df.schema.json()}


def _write_months(events: DataFrame, folder: str, version: str, s: Settings, parts: Callable[[DataFrame], DataFrame] = lambda df: df, folds: bool = True) -> dict[str, str]:
    """Write whole months under a version, and their folds. The schemas of the tables. ``parts`` adds columns once events are dealt."""
    spark = events.sparkSession
    # in the order that the writer needs, which it otherwise makes by a second sort
    schemas = _put_months(parts(events.repartitionByRange(_tasks(events), "ts_ms")).sortWithinPartitions("year", "ym", "ts_ms"), folder, "events", version)
    back = spark.read.schema(T.StructType.fromJson(json.loads(schemas["events"])).add("version", "string")).parquet(f"{folder}/events").filter(F.col("version") == version).drop("version")
    for name, fold in _FOLDS.items() if folds else ():
        schemas |= _put_months(fold(back, s), folder, name, version)
    return schemas


def _with_folds(a: Archive, s: Settings) -> Archive:
    """An archive on demand with its folds beside its events, as a late file needs them."""
    schemas = dict(a.manifest.schemas)
    for name in [x for x in _FOLDS if x not in schemas]:
        for version in sorted(set(a.manifest.months.values())):
            rows = a.by_month("events", {ym for ym, v in a.manifest.months.items() if v == version})
            schemas |= _put_months(_FOLDS[name](rows, s), a.folder, name, version, again=True)
    return Archive(a.spark, a.folder, replace(a.manifest, schemas=schemas))


def _months(rows: DataFrame) -> list[str]:
    """The calendar bounds their number."""
    return sorted(r.ym for r in rows.select("ym").distinct().collect())


def _with_marts(a: Archive, sequence: Callable[[str], DataFrame], s: Settings, at_once: int) -> Archive:
    def put(name: str, df: DataFrame) -> None:
        df.write.option("compression", "zstd").parquet(f"{a.folder}/marts/{a.manifest.marts}/{name}")

    derived(a, put, sequence, s, at_once)
    return _publish(a.spark, a.folder, a.manifest)


def rebuild(
    events: DataFrame, folder: str, lost_now: int, graveyard_now: int, s: Settings = DEFAULTS, at_once: int = 4, source: str = "", parts: Callable[[DataFrame], DataFrame] = lambda df: df, on_demand: bool = False
) -> Archive:
    """Write ``events``, their folds and all marts below ``folder``; at most ``at_once`` marts are built side by side.

    ``parts`` adds columns that follow from others, such as the calendar's, so that they aren't shuffled. ``on_demand`` leaves folds
    and marts to the pages that first read them. An empty table gives empty marts. Readers of an older version go on reading it.
    """
    spark, version = events.sparkSession, uuid.uuid4().hex
    schemas = _write_months(events, folder, version, s, parts, not on_demand)
    number = (manifests(spark, folder) or [0])[-1] + 1
    months = {ym: version for ym in _months(spark.read.schema(T.StructType.fromJson(json.loads(schemas["events"])).add("version", "string")).parquet(f"{folder}/events").filter(F.col("version") == version))}
    a = Archive(spark, folder, Manifest(number, months, version, schemas, engine(), source, json.loads(json.dumps(asdict(s))), (lost_now, graveyard_now), int(time.time() * 1000), on_demand))
    if on_demand:
        return _publish(spark, folder, a.manifest)
    return _with_marts(a, lambda kind: scores.folds(a.events, kind, s), s, at_once)


def updated(a: Archive, new: DataFrame, identity: list[str], order: list[str] | None = None, s: Settings = DEFAULTS, at_once: int = 4) -> Archive:
    """Add the events of ``new`` that the archive doesn't have: only the months that they lie in are written and folded again.

    Lifetime marts come from the folds of all months. Sequence measures are computed again for entities that have a new event
    and kept for all others. The result's marts equal those of a full rebuild. Nothing new leaves the archive as it is.
    """
    touched = set(_months(new))
    old = a.by_month("events", touched)
    added = written(history.merged(new, old, identity, order or identity), "added")
    months = set(_months(added))
    if not months:
        discard(added)
        return a
    a = _with_folds(a, s)
    version = uuid.uuid4().hex
    whole = a.by_month("events", months)
    schemas = _write_months(whole.unionByName(added.select(*whole.columns)), a.folder, version, s)
    fresh = Manifest(a.manifest.number + 1, a.manifest.months | {ym: version for ym in months}, version, schemas, engine(), a.manifest.source, json.loads(json.dumps(asdict(s))), a.manifest.clocks, int(time.time() * 1000))
    b = Archive(a.spark, a.folder, fresh)

    def sequence(kind: str) -> DataFrame:
        key = rollups.KEYS[kind]
        ids = added.select(F.col(key).alias("id")).filter("id IS NOT NULL").distinct()
        again = b.events.join(ids.withColumnRenamed("id", key), key, "left_semi")
        kept = a.table(f"sequence_{kind}").join(ids, "id", "left_anti")
        return kept.unionByName(scores.folds(again, kind, s))

    out = _with_marts(b, sequence, s, at_once)
    discard(added)
    return out


def swept(a: Archive, keep: int = 2, older_than_ms: int = 3_600_000) -> int:
    """Delete months and marts that none of the last ``keep`` manifests names, and older manifests; the number of deleted folders.

    Folders younger than ``older_than_ms`` stay, as a rebuild that isn't published yet may have written them. Readers of older
    versions must have ended.
    """
    spark, numbers = a.spark, manifests(a.spark, a.folder)
    held, before, gone = [], int(time.time() * 1000) - older_than_ms, 0
    for number in numbers[-keep:]:
        held.append(json.loads(spark.read.text(f"{a.folder}/manifests/{number:08d}.json", wholetext=True).first()[0]))
    named = {(ym, version) for m in held for ym, version in m["months"].items()}
    for pattern, used in [("marts/*", lambda x: x.getName() in {m["marts"] for m in held}), *[(f"{n}/year=*/ym=*/version=*", lambda x: (x.getParent().getName()[3:], x.getName()[8:]) in named) for n in MONTHLY]]:
        where, files = _files(spark, f"{a.folder}/{pattern}")
        for x in files.globStatus(where) or []:
            if x.getModificationTime() < before and not used(x.getPath()):
                files.delete(x.getPath(), True)
                gone += 1
    for number in numbers[:-keep]:
        where, files = _files(spark, f"{a.folder}/manifests/{number:08d}.json")
        files.delete(where, False)
    return gone
