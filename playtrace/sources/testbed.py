"""The benchmark tables in the event shape: ``long_view`` for histories of years, ``short_view`` for days and sessions.

An event has ts_ms, local_date, ym, year, hour, dow (0 is Sunday), listener, track_id, artist_id, album_id, ms_played,
skipped (true, false or null), reason_end and incognito. Calendar parts come from ts_ms by arithmetic, so the session's zone
doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.operators.rollups import tasks_of

#: Parts up to which it is left to Spark how lines find theirs; with more, which Spark sorts in as many tasks as shuffle partitions, both are dealt to bounded tasks.
MOST_PARTS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since 1970 of a zoneless timestamp taken as UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    return days * 86_400_000 + seconds.cast("long") * 1000 + F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("long")


def calendar(df: DataFrame) -> DataFrame:
    """Add the calendar parts of ts_ms in UTC."""
    day = F.floor(F.col("ts_ms") / 86_400_000).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day)
    text = date.cast("string")  # a formatter takes far longer
    return df.select(
        "*", text.alias("local_date"), F.substring(text, 1, 7).alias("ym"), F.year(date).alias("year"),
        (F.pmod(F.col("ts_ms"), F.lit(86_400_000)) / 3_600_000).cast("int").alias("hour"), F.pmod(day + 4, F.lit(7)).alias("dow"),
    )


def long_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of plays: line items by part. Album is null for line number 7; about one in twenty is private."""
    return calendar(long_plays(spark, sf_dir))


def long_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the calendar parts."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    if parts.count() > MOST_PARTS:
        lines, parts = lines.repartition(tasks_of(lines), "l_partkey"), parts.hint("merge")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 86400
    flag = F.col("l_returnflag")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        (day * 86_400_000 + second * 1000).alias("ts_ms"), F.lit(1).cast("long").alias("listener"), F.col("l_partkey").alias("track_id"),
        F.substring("p_brand", 7, 9).cast("long").alias("artist_id"),
        F.when(F.col("l_linenumber") != 7, F.concat("p_brand", F.lit("|"), "p_type")).alias("album_id"), F.col("l_suppkey").alias("supplier_id"),
        (F.col("l_quantity") * 6000).cast("long").alias("ms_played"), F.when(flag == "R", True).when(flag == "A", False).alias("skipped"),
        F.element_at(F.array(F.lit("trackdone"), F.lit("fwdbtn"), F.lit("backbtn")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("reason_end"),
        (F.col("l_discount") == 0.1).alias("incognito"),
    )


def short_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of events to the microsecond: the listener is the user, the track the event type with its key."""
    rows = table(spark, sf_dir, "events")
    return calendar(
        rows.select(
            "event_id", epoch_ms("ts").alias("ts_ms"), F.col("user_id").alias("listener"), F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("track_id"),
            F.col("event_type").alias("artist_id"), F.lit(None).cast("string").alias("album_id"), F.floor(F.col("value") * 1000).cast("long").alias("ms_played"),
            (F.col("event_type") == "error").alias("skipped"), F.lit(None).cast("string").alias("reason_end"), F.lit(False).alias("incognito"),
        )
    )


#: The same views in SQL, as the head of a WITH clause: ``a`` has all events, ``e`` those that are not private, ``s`` the short view.
SQL = """
WITH a AS (
  SELECT *, strftime(d, '%Y-%m-%d') AS local_date, strftime(d, '%Y-%m') AS ym, CAST(year(d) AS INTEGER) AS year, CAST((ts_ms % 86400000) // 3600000 AS INTEGER) AS hour,
    CAST(dayofweek(d) AS INTEGER) AS dow, CAST(ms_played >= 30000 AS BIGINT) AS q,
    CASE WHEN skipped OR (ms_played < 20000 AND reason_end IN ('fwdbtn', 'backbtn')) THEN 1::BIGINT ELSE 0::BIGINT END AS skip
  FROM (
    SELECT CAST(l_shipdate AS DATE) AS d, epoch_ms(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) + ((l_orderkey * 7919 + l_linenumber * 104729) % 86400) * 1000 AS ts_ms,
      1::BIGINT AS listener, l_partkey AS track_id, CAST(substr(p_brand, 7) AS BIGINT) AS artist_id,
      CASE WHEN l_linenumber <> 7 THEN p_brand || '|' || p_type END AS album_id, l_suppkey AS supplier_id, CAST(l_quantity * 6000 AS BIGINT) AS ms_played,
      CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS skipped, (['trackdone', 'fwdbtn', 'backbtn'])[l_linenumber % 3 + 1] AS reason_end, l_discount = 0.1 AS incognito
    FROM lineitem JOIN part ON l_partkey = p_partkey
  )
), e AS (SELECT * FROM a WHERE NOT incognito
), s AS (
  SELECT *, strftime(d, '%Y-%m-%d') AS local_date, strftime(d, '%Y-%m') AS ym, CAST(year(d) AS INTEGER) AS year, CAST((ts_ms % 86400000) // 3600000 AS INTEGER) AS hour, CAST(dayofweek(d) AS INTEGER) AS dow,
    CAST(ms_played >= 30000 AS BIGINT) AS q
  FROM (SELECT event_id, CAST(ts AS DATE) AS d, epoch_us(ts) // 1000 AS ts_ms, user_id AS listener, event_type || ':' || (props ->> '$.k') AS track_id, event_type AS artist_id,
    CAST(floor(value * 1000) AS BIGINT) AS ms_played FROM events)
)"""
