"""The import ledger: which imports began, which were completed, and which files they took in.

Rows are only ever appended, each state of an import by one small write, so a crash leaves an import that began and wasn't
completed. Its files count as unseen: the next import reads them again, and events that were written already are found by
their identity and not written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtrace.config import DEFAULTS, Settings
from playtrace.shared import discard, written
from playtrace.sources import history

IMPORTS = "import_id string, state string, at_ms long, source_name string, file_count long, events_found long, events_inserted long, events_duplicate long, events_invalid long"
FILES = "import_id string, file string, file_hash string, events_found long, skipped boolean"


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if there else spark.createDataFrame([], schema)


def _append(spark: SparkSession, folder: str, row: tuple) -> None:
    spark.createDataFrame([row], IMPORTS).coalesce(1).write.mode("append").parquet(f"{folder}/imports")


def imports(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "imports", IMPORTS)


def seen(spark: SparkSession, folder: str) -> DataFrame:
    """(file_hash) of files that completed imports have taken in."""
    done = imports(spark, folder).filter("state = 'complete'").select("import_id")
    return _table(spark, folder, "files", FILES).join(done, "import_id", "left_semi").select("file_hash").distinct()


def recent(spark: SparkSession, folder: str, limit: int = 25) -> DataFrame:
    """The newest imports with their last state: import_id, started_ms, finished_ms, source_name, counts, state."""
    rows = imports(spark, folder)
    last = Window.partitionBy("import_id").orderBy(F.desc(F.col("state") == "complete"))
    started = F.min("at_ms").over(Window.partitionBy("import_id")).alias("started_ms")
    newest = rows.select("*", started, F.row_number().over(last).alias("rn")).filter("rn = 1")
    finished = F.when(F.col("state") == "complete", F.col("at_ms")).alias("finished_ms")
    counts = ("file_count", "events_found", "events_inserted", "events_duplicate", "events_invalid")
    return newest.select("import_id", "started_ms", finished, "source_name", *counts, "state").orderBy(F.desc("started_ms"), "import_id").limit(limit)


def bring_in(spark: SparkSession, folder: str, import_id: str, at_ms: int, *paths: str, zone: str = "UTC", drop_private: bool = False, s: Settings = DEFAULTS) -> DataFrame:
    """Import a selection into ``folder``/events: one row with the counts. Files that a completed import has seen are hashed but not parsed.

    Events lie by month; new ones are compared with the months that they touch.
    """
    _append(spark, folder, (import_id, "started", at_ms, ", ".join(paths), None, None, None, None, None))
    files = written(history.picked(spark, *paths), "picked")
    fresh = written(history.unseen(files, seen(spark, folder)), "fresh")
    rows = written(history.normalised(history.records_in(spark, fresh), s, drop_private), "normalised")
    events = history.localised(history.keyed(rows), zone)
    where = f"{folder}/events"
    old = None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        months = [r.ym for r in events.select("ym").distinct().collect()]  # the calendar bounds their number
        old = spark.read.schema(events.schema).parquet(where).filter(F.col("ym").isin(months))
    added = written(history.merged(events, old), "added")
    added.write.mode("append").partitionBy("ym").parquet(where)
    found = rows.groupBy("file").agg(F.count(F.lit(1)).alias("events_found"))
    by_file = files.join(fresh.select("file", F.lit(True).alias("taken")), "file", "left").join(found, "file", "left").fillna(0, ["events_found"])
    by_file.select(F.lit(import_id).alias("import_id"), "file", "file_hash", "events_found", F.col("taken").isNull().alias("skipped")).write.mode("append").parquet(f"{folder}/files")
    report = history.import_report(rows, added).first()
    _append(spark, folder, (import_id, "complete", at_ms, ", ".join(paths), files.count(), report["found"], report["inserted"], report["duplicate"], report["invalid"]))
    discard(files, fresh, rows, added)
    return recent(spark, folder).filter(F.col("import_id") == import_id)
