"""Rankings: peak months and years, canonical albums, ranks within years. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.config import DEFAULTS, Settings
from playtrace.functions import predicates as p
from playtrace.operators.rollups import KEYS, monthly


def first_of(df: DataFrame, by: str | list[str], *order) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("rn = 1").drop("rn")


def peak_month(events: DataFrame, kind: str, s: Settings = DEFAULTS) -> DataFrame:
    key = KEYS[kind]
    best = first_of(monthly(events, kind, s), key, F.desc("q_plays"), F.desc("plays"), "ym")
    return best.select(key, F.col("ym").alias("peak_ym"), F.col("q_plays").alias("peak_ym_plays"))


def plays_by_year(events: DataFrame, kind: str, s: Settings = DEFAULTS) -> DataFrame:
    """Qualifying plays of each entity and year, years without one included if they had events."""
    key = KEYS[kind]
    return p.visible(events, s).filter(F.col(key).isNotNull()).groupBy(key, "year").agg(p.count_if(p.qualifying(s)).alias("n"))


def all_plays_by_year(events: DataFrame, key: str, s: Settings = DEFAULTS) -> DataFrame:
    """Visible plays of any length of each key and year."""
    return p.visible(events, s).groupBy(key, "year").agg(F.count(F.lit(1)).alias("n"))


def peak_year(events: DataFrame, kind: str, s: Settings = DEFAULTS) -> DataFrame:
    key = KEYS[kind]
    best = first_of(plays_by_year(events, kind, s), key, F.desc("n"), "year")
    return best.select(key, F.col("year").alias("peak_year"), F.col("n").alias("peak_year_plays"))


def album_peak(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The best month, and that month's year, which need not be the best year."""
    months = p.visible(events, s).filter(F.col("album_id").isNotNull()).groupBy("album_id", "year", "ym").agg(p.count_if(p.qualifying(s)).alias("n"))
    return first_of(months, "album_id", F.desc("n"), "ym").select("album_id", F.col("ym").alias("peak_ym"), F.col("year").alias("peak_year"), F.col("n").alias("peak_ym_plays"))


def canonical_album(events: DataFrame, album: str = "album_id") -> DataFrame:
    """The album that a track was most often played on, over all events."""
    counts = events.filter(F.col(album).isNotNull()).groupBy("track_id", album).agg(F.count(F.lit(1)).alias("n"))
    return first_of(counts, "track_id", F.desc("n"), album).select("track_id", F.col(album).alias("album_id"), F.col("n").alias("plays"))


def rank_in_year(events: DataFrame, kind: str, s: Settings = DEFAULTS) -> DataFrame:
    """Equal counts share a rank, and ranks after them are left out.

    A rank is one more than the entities with a larger count, so it comes from a histogram of counts: a row per year and
    distinct count, which is about the square root of a year's plays at most, and no task holds all entities of a year.
    """
    return ranks_of(plays_by_year(events, kind, s))


def ranks_of(yearly: DataFrame) -> DataFrame:
    """Rows of an entity, year and count n with ``rank_in_year``."""
    larger = F.sum("entities").over(Window.partitionBy("year").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = yearly.groupBy("year", "n").agg(F.count(F.lit(1)).alias("entities")).withColumn("rank_in_year", 1 + F.coalesce(larger, F.lit(0)))
    return yearly.join(ranks.drop("entities"), ["year", "n"]).select(*yearly.columns, "rank_in_year")


def top_per_day(events: DataFrame, kind: str) -> DataFrame:
    key = KEYS[kind]
    counts = events.groupBy("local_date", key).agg(F.count(F.lit(1)).alias("plays"))
    return first_of(counts, "local_date", F.desc("plays"), key)


def diversified(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """Rows in order, but those beyond the first ``cap`` of a group after all others. Adds ``position``.

    The global rank is taken over rows that a caller has already cut to a page's worth.
    """
    marked = df.withColumn("within", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return marked.withColumn("position", F.row_number().over(Window.orderBy(F.col("within") > cap, *order))).drop("within")


def tight_span(yearly: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """The shortest span of years with at least ``share`` of an entity's plays; the fuller, then the earlier one wins ties.

    Only spans of at most half of the entity's years, or two, are reported. A row per entity and year comes in.
    """
    line = Window.partitionBy(key).orderBy("year")
    whole = Window.partitionBy(key)
    sums = yearly.select(key, "year", "n", F.sum("n").over(line).alias("upto"), F.sum("n").over(whole).alias("total"), F.count(F.lit(1)).over(whole).alias("years"), F.row_number().over(line).alias("i"))
    a, b = sums.alias("a"), sums.alias("b")
    spans = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.i") <= F.col("b.i"))).select(
        F.col(f"a.{key}").alias(key), F.col("a.year").alias("from_year"), F.col("b.year").alias("to_year"), (F.col("b.i") - F.col("a.i") + 1).alias("span"),
        (F.col("b.upto") - F.col("a.upto") + F.col("a.n")).alias("plays"), F.col("a.total").alias("total"), F.col("a.years").alias("years"),
    )
    enough = spans.filter((F.col("total") > 0) & (F.col("plays") >= share * F.col("total")))
    best = first_of(enough, key, "span", F.desc("plays"), "from_year")
    return best.filter(F.col("span") <= F.greatest(F.lit(2), F.ceil(F.col("years") / 2))).select(key, "from_year", "to_year", F.col("span").cast("long").alias("span"), "plays", "total")


def versus_previous_year(yearly: DataFrame) -> DataFrame:
    """Each year beside the calendar year before it, null where that year has no plays."""
    before = yearly.select((F.col("year") + 1).alias("year"), F.col("plays").alias("previous_plays"), F.col("ms_played").alias("previous_ms"))
    return yearly.select("year", "plays", "ms_played").join(before, "year", "left")
