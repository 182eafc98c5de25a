"""Structured Streaming editions: events that arrive file by file, merged idempotently and rolled up within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playtrace.config import DEFAULTS, Settings
from playtrace.functions import predicates as p
from playtrace.plans import marts
from playtrace.sources import history


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they appear, with a timestamp column ``at``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("at", F.timestamp_millis("ts_ms"))


def sessions(stream: DataFrame, s: Settings = DEFAULTS, late: str = "1 day") -> DataFrame:
    """Sessions of each listener, emitted once no event within the watermark can extend them."""
    window = F.session_window("at", f"{s.session_gap_minutes} minutes")
    return stream.withWatermark("at", late).groupBy("listener", window.alias("w")).agg(F.min("ts_ms").alias("start_ts"), F.max("ts_ms").alias("end_ts"), F.count(F.lit(1)).alias("events"), F.sum("ms_played").alias("ms_played")).drop("w")


def daily(stream: DataFrame, s: Settings = DEFAULTS, late: str = "1 day") -> DataFrame:
    """Plays by UTC day, updated as events arrive; an event later than the watermark is left to the batch rebuild."""
    return p.visible(stream, s).withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("plays"), p.count_if(p.qualifying(s)).alias("q_plays"), F.sum("ms_played").alias("ms_played")).select(F.date_format("w.start", "yyyy-MM-dd").alias("local_date"), "plays", "q_plays", "ms_played")


def merge_into(stream: DataFrame, archive: str, checkpoint: str, identity: list[str] = history.IDENTITY, order: list[str] | None = None) -> StreamingQuery:
    """Append each batch's new identities to the Parquet archive, which lies by ``ym`` where events have it; a batch that runs again adds nothing.

    An identity holds the event's time, so that a batch is compared with the months that it touches and no others are read.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        parts = ["ym"] if "ym" in rows.columns else []
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(archive)
        old = None
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            old = spark.read.schema(rows.schema).parquet(archive)
            if parts:
                # the calendar bounds their number
                old = old.filter(F.col("ym").isin([r.ym for r in rows.select("ym").distinct().collect()]))
        history.merged(rows, old, identity, order or ["ts_ms"]).write.mode("append").partitionBy(*parts).parquet(archive)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_up(stream: DataFrame, folder: str, checkpoint: str, identity: list[str], order: list[str] | None = None, s: Settings = DEFAULTS) -> StreamingQuery:
    """Bring the archive at ``folder`` up to date with each batch: its months are folded again, its entities' sequences too.

    A batch that runs again adds nothing, and pages go on reading the version that they opened.
    """

    def batch(rows: DataFrame, _: int) -> None:
        held = marts.opened(rows.sparkSession, folder)
        if held is None:
            raise ValueError(f"no archive at {folder}")
        marts.updated(held, rows, identity, order, s)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
