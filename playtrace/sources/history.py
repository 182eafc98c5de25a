"""Listening-history exports: JSON files, folders and ZIP archives to normalised, deduplicated events.

Both generations of records are read with one schema of strings, so that a malformed field becomes null and never costs the
record. Rules that reject a record are tried in a fixed order, and every rejected record keeps its reason.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import unicodedata
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.config import DEFAULTS, Settings

#: Names of history files, and of files in an export that are something else. Fixed values of the export's format.
HISTORY = (r"streaming[_-]?history", r"^endsong[_-]?\d*\.json$", r"StreamingHistory[_-]?music")
OTHER = (
    r"Userdata\.json$", r"Identity\.json$", r"Payments\.json$", r"Follow\.json$", r"Inferences\.json$", r"SearchQueries\.json$", r"Playlist\d*\.json$", r"YourLibrary\.json$", r"Marquee\.json$",
)
#: Folders and names of resource forks in archives. Fixed values.
FORKS = (r"^__MACOSX/", r"/\._")
MOST_BYTES = 512 * 1024 * 1024
#: Fields of both generations. Fixed values of the export's format.
FIELDS = (
    "ts", "endTime", "offline_timestamp", "ms_played", "msPlayed", "master_metadata_track_name", "trackName", "master_metadata_album_artist_name", "artistName",
    "master_metadata_album_album_name", "albumName", "spotify_track_uri", "episode_name", "episode_show_name", "spotify_episode_uri", "audiobook_title", "audiobook_chapter_title",
    "platform", "conn_country", "reason_start", "reason_end", "shuffle", "skipped", "offline", "incognito_mode",
)
TRACK_URI = "spotify:track:"
#: Families of platforms, in the order in which their marks are looked for. Fixed values.
PLATFORMS = (
    ("android", ("android",)), ("ios", ("ios", "iphone", "ipad")), ("windows", ("windows",)), ("macos", ("osx", "os x", "macos", "darwin")), ("linux", ("linux", "ubuntu")),
    ("web", ("web", "chrome", "firefox", "safari")), ("cast", ("cast", "chromecast")), ("partner", ("partner", "sonos", "tv", "playstation")),
)


class SourceError(Exception):
    """A path that is missing or an archive that can't be read; ``code`` says which."""

    def __init__(self, code: str, path: str):
        super().__init__(f"{code}: {path}")
        self.code = code


def looks_like_history(name: str) -> bool:
    base = name.rsplit("/", 1)[-1]
    return base.lower().endswith(".json") and any(re.search(x, base, re.I) for x in HISTORY) and not is_other(name)


def is_other(name: str) -> bool:
    """Whether a path, or the path inside an archive, is a file of another kind."""
    inner = name.rsplit("!", 1)[-1]
    return any(re.search(x, inner, re.I) for x in OTHER) or any(re.search(x, inner) for x in FORKS)


def natural(name: str) -> list:
    """Sort key under which file 2 stands before file 10."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.split(r"(\d+)", name) if x]


#: What the zip library raises for archives and entries that are damaged, encrypted or packed by an unknown method.
_ZIP_FAULTS = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError, ValueError)


def natural_key(name: Column) -> Column:
    """Text under which names sort as ``natural`` does: lower case, each number padded to twenty digits."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x)), "")


def zip_entries(name: str, content: bytes) -> Iterator[str]:
    """Names of an archive's JSON entries that are not too large, from its directory alone."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            yield from (x.filename for x in archive.infolist() if x.filename.lower().endswith(".json") and x.file_size <= MOST_BYTES)
    except _ZIP_FAULTS as bad:
        raise SourceError("CORRUPT_ARCHIVE", name) from bad


def unzip(name: str, content: bytes, wanted=lambda _: True) -> Iterator[tuple[str, bytes | SourceError]]:
    """The wanted JSON entries of an archive one by one, or the file itself. An entry that can't be read comes as its error."""
    if not name.lower().endswith(".zip"):
        yield name, content
        return
    for entry in list(zip_entries(name, content)):
        if not wanted(f"{name}!{entry}"):
            continue
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                body: bytes | SourceError = archive.read(entry)
        except _ZIP_FAULTS:
            body = SourceError("CORRUPT_ARCHIVE", f"{name}!{entry}")
        yield f"{name}!{entry}", body


def records_of(content: bytes) -> list | None:
    """The records of a file that is a JSON array and looks like a history by its first records; else None."""
    try:
        rows = json.loads(content.decode("utf-8-sig"))
    except (ValueError, UnicodeDecodeError):
        return None
    if not isinstance(rows, list) or not rows:
        return None
    head = rows[:25]
    tracks = ("master_metadata_track_name", "trackName", "spotify_track_uri", "episode_name")
    hits = sum(isinstance(r, dict) and ("ts" in r or "endTime" in r) and any(k in r for k in tracks) for r in head)
    return rows if hits >= max(1, len(head) // 2) else None


RAW = "file string, file_hash string, row long, is_object boolean, " + ", ".join(f"`{f}` string" for f in FIELDS)
_RAW_NAMES = ["file", "file_hash", "row", "is_object", *FIELDS]
#: Folders below the selected one that are looked into.
DEPTH = 8


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content) of all files below ``paths``, listed and read by the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")


def listed(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, name) of what a selection offers: JSON files, not too large nor too deep, and the JSON entries of archives.

    Of JSON files only names are read, of archives the directories. A path that doesn't exist is an error; an archive that can't
    be opened is offered under its own name, so that its fault is told.
    """
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            raise SourceError("NOT_FOUND", path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    # the path below the selected folder, of several that hold it the deepest; a selected file stands alone
    roots = [x.rstrip("/").split(":/")[-1].lstrip("/") for x in paths]
    ways = [F.when(F.col("path").endswith(r), F.substring_index("path", "/", -1)).otherwise(F.substring_index("path", f"{r}/", -1)) for r in roots]
    below = F.array_min(F.array(*[F.struct(F.length(w).alias("n"), w.alias("w")) for w in ways]))["w"]
    files = reader.load(list(paths)).select("path", "length", below.alias("below"))
    files = files.filter((F.size(F.split("below", "/")) - 1 <= DEPTH) & ~F.col("below").rlike(r"(^|/)(__MACOSX|\.[^/]*)/"))
    loose = files.filter(F.lower("path").endswith(".json") & (F.col("length") <= MOST_BYTES)).select("path", F.col("path").alias("name"))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    names = [f"{path}!{x}" for x in zip_entries(path, content)]
                except SourceError:
                    names = [path]
                yield pd.DataFrame({"path": path, "name": names})

    zips = reader.option("pathGlobFilter", "*.[zZ][iI][pP]").load(list(paths)).select("path", "content").mapInPandas(entries, "path string, name string")
    other = F.lit(False)
    inner = F.substring_index("name", "!", -1)
    for x in OTHER:
        other = other | inner.rlike(f"(?i){x}")
    for x in FORKS:
        other = other | inner.rlike(x)
    return loose.unionByName(zips).filter(~other)


def chosen(offered: DataFrame) -> DataFrame:
    """Of what is offered the files with a history's name if there is one in the whole selection, else all; archives with a fault stay."""
    base = F.substring_index(F.substring_index("name", "!", -1), "/", -1)
    history = F.lit(False)
    for x in HISTORY:
        history = history | base.rlike(f"(?i){x}")
    marked = offered.withColumn("named", F.lower(base).endswith(".json") & history).withColumn("fault", F.lower("name").endswith(".zip"))
    any_named = marked.agg(F.coalesce(F.max("named"), F.lit(False)).alias("any_named"))
    return marked.join(F.broadcast(any_named)).filter(F.col("named") | F.col("fault") | ~F.col("any_named")).select("path", "name", natural_key(base).alias("place"))  # one row


def hashed(files: DataFrame, wanted: set[str]) -> DataFrame:
    """(path, file, file_hash) of the wanted files and entries, without a look at their records. A fault has the archive's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                out = []
                try:
                    for name, body in unzip(path, content, lambda x: x in wanted):
                        if name in wanted:
                            out.append((path, name, hashlib.sha256(content if isinstance(body, SourceError) else body).hexdigest()))
                except SourceError:
                    out.append((path, path, hashlib.sha256(content).hexdigest()))
                yield pd.DataFrame(out, columns=["path", "file", "file_hash"])

    return files.mapInPandas(run, "path string, file string, file_hash string")


def picked(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, file, place, file_hash) of the chosen files of a selection."""
    wanted = chosen(listed(spark, *paths)).collect()  # paths, which Spark's driver lists for any scan
    if not wanted:
        return spark.createDataFrame([], "path string, file string, place string, file_hash string")
    places = spark.createDataFrame([(r.name, r.place) for r in wanted], "file string, place string")
    return hashed(read_files(spark, *sorted({r.path for r in wanted})), {r.name for r in wanted}).join(places, "file").select("path", "file", "place", "file_hash")


def unseen(files: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Of files with equal contents the first in natural order, and none whose contents are in ``seen`` (file_hash)."""
    first = files.withColumn("rn", F.row_number().over(Window.partitionBy("file_hash").orderBy("place", "file"))).filter("rn = 1").drop("rn")
    return first if seen is None else first.join(seen.select("file_hash"), "file_hash", "left_anti").select(*files.columns)


def records_in(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Raw records of picked files, with ``place``; contents of other files are not read."""
    known = files.select("path", "file", "place").collect()  # as listed
    if not known:
        return spark.createDataFrame([], RAW + ", place string")
    raw = raw_records(read_files(spark, *sorted({r.path for r in known})), {r.file for r in known})
    places = spark.createDataFrame([(r.file, r.place) for r in known], "file string, place string")
    return raw.join(places, "file")


def selection(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw records of the chosen files of a selection. ``place`` is a file's natural order."""
    wanted = chosen(listed(spark, *paths)).select("path", F.col("name").alias("file"), "place")
    return records_in(spark, wanted)


def raw_records(files: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """One row per record: its file, the file's SHA-256, its place, and every known field as text (JSON for what isn't text).

    Files are independent, so each is handled where it lies, one entry of an archive at a time; files that are no history give
    no row, and an archive or an entry that can't be read gives one that is rejected. ``wanted`` names the files to look at.
    """

    def fault(name: str, content: bytes) -> pd.DataFrame:
        return pd.DataFrame([[name, hashlib.sha256(content).hexdigest(), -1, False, *[None] * len(FIELDS)]], columns=_RAW_NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for name, body in unzip(path, content, lambda x: not is_other(x) and (wanted is None or x in wanted)):
                        if isinstance(body, SourceError):
                            yield fault(name, content)
                            continue
                        rows = None if is_other(name) or (wanted is not None and name not in wanted) else records_of(body)
                        if rows is None:
                            continue
                        digest = hashlib.sha256(body).hexdigest()
                        for begin in range(0, len(rows), 20_000):
                            out = []
                            for i, r in enumerate(rows[begin : begin + 20_000], begin):
                                known = r if isinstance(r, dict) else {}
                                values = [known.get(f) for f in FIELDS]
                                out.append([name, digest, i, isinstance(r, dict), *(v if v is None or isinstance(v, str) else json.dumps(v) for v in values)])
                            yield pd.DataFrame(out, columns=_RAW_NAMES)
                except SourceError:
                    yield fault(path, content)

    return files.mapInPandas(run, RAW)


def one_copy_per_file(raw: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Drop files whose content came before, in this run (the first name stays) or in ``seen`` (file_hash)."""
    first = raw.groupBy("file_hash").agg(F.min("file").alias("file"))
    kept = raw.join(first if seen is None else first.join(seen.select("file_hash"), "file_hash", "left_anti"), ["file_hash", "file"], "left_semi")
    return kept


def trimmed(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def boolean(c: str) -> Column:
    return F.when(F.col(c).isin("true", "1"), True).when(F.col(c).isin("false", "0"), False)


def milliseconds(c: Column, most: int = DEFAULTS.most_ms) -> Column:
    x = c.try_cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    return F.when(good, F.least(F.floor(x + 0.5), F.lit(most).cast("long"))).otherwise(0).cast("long")


def timestamp_ms(c: Column) -> Column:
    """Milliseconds of a timestamp as text: seconds or milliseconds as a number, a plain UTC time, or ISO 8601."""
    n = c.try_cast("double")
    numeric = F.when(n < 1e11, n * 1000).otherwise(n).cast("long")
    c = F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2})$", "$1:00")
    plain = c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2})?$")
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    text = F.when(plain | (~zoned & c.rlike(r"^\d{4}-\d{2}-\d{2}")), F.concat(F.regexp_replace(c, " ", "T"), F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("T00:00:00Z")).otherwise(F.lit("Z")))).otherwise(c)
    return F.when(n.isNotNull(), numeric).otherwise(F.unix_millis(F.try_to_timestamp(text)))


def platform_family(c: Column) -> Column:
    text = F.lower(c)
    out = None
    for family, marks in PLATFORMS:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | text.contains(mark)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return F.when(c.isNull(), None).otherwise(out.otherwise("other"))


_QUOTES = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "‑": "-"})


def name_key(name: str | None) -> str | None:
    """The key under which spellings of one name meet: case, white space, quotes, dashes and diacritics are folded."""
    if name is None:
        return None
    plain = unicodedata.normalize("NFKD", name.translate(_QUOTES))
    return re.sub(r"\s+", " ", "".join(c for c in plain if not unicodedata.combining(c)).casefold()).strip()


def _name_keys(names: pd.Series) -> pd.Series:
    return names.map(name_key)


def name_keys(name: str) -> Column:
    return F.pandas_udf(_name_keys, T.StringType())(F.col(name))


def slugify(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name_key(text) or "").strip("-") or "tag"


def unit_hash(text: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the text and the salt alone."""
    return F.pmod(F.xxhash64(text, F.lit(salt)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def normalised(raw: DataFrame, s: Settings = DEFAULTS, drop_private: bool = False) -> DataFrame:
    """All records with their event columns and ``reject_reason``, null for the good ones."""
    # the first field that is there counts, even if it is blank
    stamp = F.nullif(F.coalesce("ts", "endTime", "offline_timestamp"), F.lit(""))
    ts = timestamp_ms(F.trim(stamp))

    def first(*names: str) -> Column:
        return F.nullif(F.trim(F.coalesce(*names)), F.lit(""))

    track, artist = first("master_metadata_track_name", "trackName"), first("master_metadata_album_artist_name", "artistName")
    incognito = F.coalesce(boolean("incognito_mode"), F.lit(False))

    def some(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in names]).isNotNull()

    reason = (
        F.when(F.col("row") < 0, "corrupt-archive").when(~F.col("is_object"), "not-an-object").when(some("episode_name", "episode_show_name", "spotify_episode_uri"), "podcast").when(some("audiobook_title", "audiobook_chapter_title"), "audiobook")
        .when(stamp.isNull(), "missing-timestamp").when(ts.isNull() | (ts <= 0), "invalid-timestamp").when(track.isNull(), "missing-track").when(artist.isNull(), "missing-artist")
        .when(F.lit(drop_private) & incognito, "incognito-excluded")
    )
    uri, country = trimmed("spotify_track_uri"), trimmed("conn_country")
    return raw.select(
        *(["place"] if "place" in raw.columns else []), "file", "file_hash", "row", reason.alias("reject_reason"), ts.alias("ts_ms"), track.alias("track_name"), artist.alias("artist_name"), first("master_metadata_album_album_name", "albumName").alias("album_name"),
        F.when(uri.startswith(TRACK_URI), uri).alias("uri"), milliseconds(F.coalesce("ms_played", "msPlayed"), s.most_ms).alias("ms_played"), platform_family(trimmed("platform")).alias("platform"),
        F.when(F.length(country) <= 4, F.upper(country)).alias("country"), trimmed("reason_start").alias("reason_start"), trimmed("reason_end").alias("reason_end"),
        boolean("shuffle").alias("shuffle"), boolean("skipped").alias("skipped"), boolean("offline").alias("offline"), incognito.alias("incognito"),
    )


def tally(rows: DataFrame) -> DataFrame:
    """Rejected records by reason."""
    return rows.filter("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


IDENTITY = ["ts_ms", "artist_key", "track_key", "ms_played", "platform", "reason_end"]


def fingerprint(columns: list[str] = IDENTITY) -> Column:
    """64 bits of an event's identity; null is a value of its own."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])


def keyed(rows: DataFrame) -> DataFrame:
    """Good events with name keys and fingerprint."""
    good = rows.filter("reject_reason IS NULL").drop("reject_reason")
    return good.withColumns({"artist_key": name_keys("artist_name"), "track_key": name_keys("track_name"), "album_key": name_keys("album_name")}).withColumn("fingerprint", fingerprint())


def merged(new: DataFrame, old: DataFrame | None = None, identity: list[str] = IDENTITY, order: list[str] | None = None) -> DataFrame:
    """The rows of ``new`` to append: the first of each identity, none that ``old`` has. Identity, not its hash, decides."""
    first = Window.partitionBy(*identity).orderBy(*(order or [*(["place"] if "place" in new.columns else []), "file", "row"]))
    fresh = new.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    if old is None:
        return fresh
    known = old.select(*[F.col(c).alias(f"old_{c}") for c in identity]).distinct()
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return fresh.join(known, same, "left_anti")


def import_report(found: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: found = inserted + duplicate + invalid."""
    a = found.agg(F.count(F.lit(1)).alias("found"), F.sum(F.col("reject_reason").isNotNull().cast("long")).alias("invalid"))
    b = inserted.agg(F.count(F.lit(1)).alias("inserted"), F.year(F.min(F.timestamp_millis("ts_ms"))).alias("first_year"), F.year(F.max(F.timestamp_millis("ts_ms"))).alias("last_year"))
    return a.crossJoin(b).select("found", "inserted", (F.col("found") - F.col("inserted") - F.coalesce("invalid", F.lit(0))).alias("duplicate"), F.coalesce("invalid", F.lit(0)).alias("invalid"), "first_year", "last_year")


def localised(events: DataFrame, zone: str) -> DataFrame:
    """Calendar parts in the listener's zone."""
    t = F.from_utc_timestamp(F.timestamp_millis("ts_ms"), zone)
    return events.withColumns({"local_date": F.date_format(t, "yyyy-MM-dd"), "ym": F.date_format(t, "yyyy-MM"), "year": F.year(t), "hour": F.hour(t), "dow": F.dayofweek(t) - 1})


def entities(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(artists, albums, tracks): ids are hashes of the natural keys; the first spelling and URI seen name each."""
    when = F.struct("ts_ms", "file", "row")
    artists = events.groupBy("artist_key").agg(F.min_by("artist_name", when).alias("name")).withColumn("artist_id", F.xxhash64("artist_key"))
    albums = events.filter("album_key IS NOT NULL").groupBy("artist_key", "album_key").agg(F.min_by("album_name", when).alias("name")).withColumn("album_id", F.xxhash64("artist_key", "album_key"))
    tracks = events.groupBy("artist_key", "track_key").agg(F.min_by("track_name", when).alias("name"), F.min_by("uri", F.when(F.col("uri").isNotNull(), when)).alias("uri")).withColumn("track_id", F.xxhash64("artist_key", F.lit("track"), "track_key"))
    return artists, albums, tracks


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_cell(c: Column, kind: str) -> Column:
    """A value as a spreadsheet takes it: nothing for null, whole numbers without a fraction, quotes where they are needed."""
    text = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")) if kind in ("double", "float") else c.cast("string")
    safe = csv_safe(F.coalesce(text, F.lit("")))
    return F.when(safe.rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(safe, '"', '""'), F.lit('"'))).otherwise(safe)


BOM = "\ufeff".encode()


def write_csv(rows: DataFrame, path: str, *order: Column) -> int:
    """One file: a byte-order mark, a header, and the rows in order with CRLF between lines. Returns its number of bytes.

    Executors write the rows as ordered parts, dealt by range; the file system then copies the parts one after the other, so no
    task and not the driver holds them. ``order`` should end in a unique key.
    """
    spark = rows.sparkSession
    line = F.concat_ws(",", *[csv_cell(F.col(n), t) for n, t in rows.dtypes])
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    ordered.select(line.alias("value")).write.option("lineSep", "\r\n").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    files = target.getFileSystem(conf)
    found = sorted((x.getPath().getName(), x.getLen(), x.getPath()) for x in files.listStatus(folder) if x.getPath().getName().startswith("part-") and x.getLen())
    out = files.create(target, True)
    try:
        out.write(bytearray(BOM + ",".join(rows.columns).encode()))
        if found:
            out.write(bytearray(b"\r\n"))
        for i, (_, size, part) in enumerate(found):
            held = files.open(part)
            # the last line ends without a break
            jvm.org.apache.commons.io.IOUtils.copyLarge(held, out, 0, size - 2 * (i == len(found) - 1))
            held.close()
    finally:
        out.close()
    files.delete(folder, True)
    return files.getFileStatus(target).getLen()


def track_rows(tracks: DataFrame) -> DataFrame:
    """The columns of a track export, from tracks with track_name, artist_name, album_name, uri and their numbers."""

    def at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))

    return tracks.select(
        F.col("track_name").alias("track"), F.col("artist_name").alias("artist"), F.col("album_name").alias("album"), F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("q_plays", F.lit(0)).alias("qualifying_plays"),
        F.floor(F.coalesce("ms_played", F.lit(0)) / 60_000 + 0.5).alias("minutes_played"), at("first_ts").alias("first_heard"), at("last_ts").alias("last_heard"), "peak_year", F.coalesce("score", F.lit(0.0)).alias("lost_favorite_score"), F.col("uri").alias("spotify_uri"),
    )


def export_json(events: DataFrame, path: str) -> None:
    """Events as export records, one per line."""
    out = events.select(
        F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "ms_played", F.col("track_name").alias("master_metadata_track_name"), F.col("artist_name").alias("master_metadata_album_artist_name"),
        F.col("album_name").alias("master_metadata_album_album_name"), F.col("uri").alias("spotify_track_uri"), "platform", F.col("country").alias("conn_country"), "reason_start", "reason_end", "shuffle", "skipped", "offline", F.col("incognito").alias("incognito_mode"),
    )
    out.write.mode("overwrite").json(path)
