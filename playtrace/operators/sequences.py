"""Order-dependent measures of each entity's plays, as windows over (entity, time).

``plays`` is always the qualifying plays as (id, ts_ms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.config import DAY_MS, DEFAULTS, Settings
from playtrace.functions import predicates as p
from playtrace.operators.rollups import KEYS, tasks_of


def qualifying_plays(events: DataFrame, kind: str, s: Settings = DEFAULTS) -> DataFrame:
    key = KEYS[kind]
    return p.visible(events, s).filter(p.qualifying(s) & F.col(key).isNotNull()).select(F.col(key).alias("id"), "ts_ms", "ym")


#: Days of a block of time. A large entity's blocks are worked on side by side, so that one with half of all plays spreads.
BLOCK_DAYS = 180
#: Plays of an entity that lie in one block, whatever time they cover.
BLOCK_PLAYS = 1 << 10


def folded(plays: DataFrame, days: tuple[int, ...] = (), counts: tuple[int, ...] = (), totals: DataFrame | None = None, most: int = BLOCK_PLAYS) -> DataFrame:
    """All sequence measures of each entity from one repartition and one sort of its plays.

    id, n, first_ts, last_ts, gap_ms, gap_from, gap_to (the first of the longest silences; 0 and nulls without one); for each
    window of ``days`` d{days}_in, d{days}_from, d{days}_to, d{days}_after (most plays in a closed interval of that length, the
    earliest of equals); for each of ``counts`` nth_{count}, the time of that play.

    The plays of an entity with more than ``most`` lie in blocks of time. A block also gets the plays that its windows reach back
    to, and knows from the table of blocks how many plays came before it, so that blocks are independent and their results merge
    to one row. ``totals`` has each entity's number of plays n by id, where at hand.
    """
    size, tasks = BLOCK_DAYS * DAY_MS, tasks_of(plays)
    totals = plays.groupBy("id").agg(F.count(F.lit(1)).alias("n")) if totals is None else totals
    large = totals.filter(F.col("n") > most).select("id", F.lit(True).alias("large"))
    plays = plays.select("id", "ts_ms").join(F.broadcast(large), "id", "left")  # one entity for 1 024 plays at most
    block = F.when(F.col("large"), F.floor(F.col("ts_ms") / size)).otherwise(F.lit(0).cast("long"))
    table = plays.filter("large").groupBy("id", block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))
    # a row per entity and block: the calendar bounds them
    earlier = Window.partitionBy("id").orderBy("block")
    table = table.select(
        "id", "block", "first_ts", F.lag("last_ts").over(earlier).alias("last_before"), F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    reach = F.when(F.col("large"), F.floor((F.col("ts_ms") + max(days, default=0) * DAY_MS) / size)).otherwise(F.lit(0).cast("long"))
    dealt = plays.select("id", "ts_ms", block.alias("own_block"), F.explode(F.sequence(block, reach)).alias("block"))
    dealt = dealt.select("id", "block", "ts_ms", (F.col("own_block") == F.col("block")).alias("own")).repartition(tasks, "id", "block").sortWithinPartitions("id", "block", "ts_ms")
    rows = dealt.join(table.hint("shuffle_hash"), ["id", "block"], "left").fillna(0, ["before"])  # the build side has a row per block, and the sort stays
    line = Window.partitionBy("id", "block").orderBy("ts_ms")
    # only frames that begin with the block: Spark carries them on from row to row, while it adds up a sliding one anew for each
    upto, rows_upto = line.rangeBetween(Window.unboundedPreceding, Window.currentRow), line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = F.col("own").cast("long")
    rows = rows.select(
        "*", F.lag("ts_ms").over(line).alias("previous"), F.lead("ts_ms").over(line).alias("next"), (F.col("before") + F.sum(owned).over(rows_upto)).alias("number"), (F.col("before") + F.sum(owned).over(upto)).alias("upto"),
        F.count(F.lit(1)).over(upto).alias("all_upto"), F.min("ts_ms").over(rows_upto).alias("begin"),
    )
    for d in days:
        gone = line.rangeBetween(Window.unboundedPreceding, -d * DAY_MS - 1)
        # what follows the last play before the window is its first
        rows = rows.withColumns({f"in_{d}": F.col("all_upto") - F.count(F.lit(1)).over(gone), f"from_{d}": F.coalesce(F.max("next").over(gone), F.col("begin"))})
    rows = rows.filter("own")
    since = F.coalesce(F.when(F.col("ts_ms") == F.col("first_ts"), F.greatest("previous", "last_before")).otherwise(F.col("previous")), F.col("last_before"))
    gap = F.when(F.col("ts_ms") > since, F.struct((F.col("ts_ms") - since).alias("gap"), (-F.col("ts_ms")).alias("m"), since.alias("since")))
    blocks = rows.groupBy("id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.max(gap).alias("gap"),
        *[F.max(F.struct(f"in_{d}", (-F.col("ts_ms")).alias("m"), f"from_{d}", "upto")).alias(f"best_{d}") for d in days], *[F.min(F.when(F.col("number") == c, F.col("ts_ms"))).alias(f"nth_{c}") for c in counts],
    )
    merged = blocks.groupBy("id").agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("gap").alias("gap"), *[F.max(f"best_{d}").alias(f"best_{d}") for d in days], *[F.min(f"nth_{c}").alias(f"nth_{c}") for c in counts],
    )
    spans = [x for d in days for b in [F.col(f"best_{d}")] for x in (b[f"in_{d}"].alias(f"d{d}_in"), b[f"from_{d}"].alias(f"d{d}_from"), (-b["m"]).alias(f"d{d}_to"), (F.col("n") - b["upto"]).alias(f"d{d}_after"))]
    return merged.select("id", "n", "first_ts", "last_ts", F.coalesce("gap.gap", F.lit(0)).alias("gap_ms"), F.col("gap.since").alias("gap_from"), (-F.col("gap.m")).alias("gap_to"), *spans, *[f"nth_{c}" for c in counts])


def densest_of(folds: DataFrame, days: int) -> DataFrame:
    return folds.select("id", F.col(f"d{days}_in").alias("plays_in"), F.col(f"d{days}_to").alias("to_ts"), F.col(f"d{days}_from").alias("from_ts"), F.col(f"d{days}_after").alias("plays_after"))


def densest(plays: DataFrame, days: int) -> DataFrame:
    """Most plays in any closed interval of ``days`` days: id, plays_in, from_ts, to_ts, plays_after; the earliest wins ties."""
    return densest_of(folded(plays, (days,)), days)


def gaps_of(folds: DataFrame) -> DataFrame:
    return folds.select("id", "gap_ms", F.floor(F.col("gap_ms") / DAY_MS).alias("gap_days"), "gap_from", "gap_to")


def longest_gap(plays: DataFrame) -> DataFrame:
    """id, gap_ms, gap_days (floored), gap_from, gap_to: the first of the longest silences; 0 and nulls without one."""
    return gaps_of(folded(plays))


def days_to(folds: DataFrame, counts: tuple[int, ...]) -> list[Column]:
    """Whole days from the first to the n-th play; null with fewer plays."""
    return [F.floor((F.col(f"nth_{n}") - F.col("first_ts")) / DAY_MS).alias(f"days_to_{n}") for n in counts]


def days_to_nth(plays: DataFrame, counts: tuple[int, ...] = (50, 100)) -> DataFrame:
    folds = folded(plays, (), counts)
    return folds.select("id", *days_to(folds, counts))


def milestones(plays: DataFrame, counts: tuple[int, ...]) -> DataFrame:
    """(id, n, ts_ms) of the n-th plays."""
    numbered = plays.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("ts_ms")))
    return numbered.filter(F.col("rn").isin(*counts)).select("id", F.col("rn").cast("long").alias("n"), "ts_ms")


def month_number(ym):
    return F.substring(ym, 1, 4).cast("int") * 12 + F.substring(ym, 6, 2).cast("int")


def longest_monthly_run(months: DataFrame) -> DataFrame:
    """(id, longest_run) from counts (id, ym, n): most calendar months in a row with a fifth of the best month's plays, two at least."""
    strong = months.withColumn("peak", F.max("n").over(Window.partitionBy("id"))).filter(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("peak") * 0.2)))
    island = month_number(F.col("ym")) - F.row_number().over(Window.partitionBy("id").orderBy("ym"))
    return strong.withColumn("island", island).groupBy("id", "island").agg(F.count(F.lit(1)).alias("run")).groupBy("id").agg(F.max("run").alias("longest_run"))


def monthly_run(plays: DataFrame) -> DataFrame:
    """(id, longest_run) of all entities, 0 for those without a strong month."""
    runs = longest_monthly_run(plays.groupBy("id", "ym").agg(F.count(F.lit(1)).alias("n")))
    return plays.select("id").distinct().join(runs, "id", "left").select("id", F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def daily_streak(days: DataFrame) -> DataFrame:
    """One row: the longest run of dates in a row, the earliest of equals. ``days`` has a row per date."""
    number = F.datediff(F.col("local_date").cast("date"), F.lit("1970-01-01").cast("date"))
    runs = days.withColumn("island", number - F.row_number().over(Window.orderBy("local_date"))).groupBy("island").agg(F.count(F.lit(1)).alias("days"), F.min("local_date").alias("from_date"), F.max("local_date").alias("to_date"))
    return runs.orderBy(F.desc("days"), "from_date").limit(1).drop("island")


def comebacks_after(plays: DataFrame, gaps: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Entities whose longest silence (``gaps``) was long and was followed by enough plays, the returning one included."""
    long = gaps.filter(F.col("gap_days") >= s.comeback_gap_days).select("id", "gap_days", "gap_from", "gap_to")
    after = plays.select("id", "ts_ms").join(long, "id").filter((F.col("ts_ms") >= F.col("gap_to")) & (F.col("ts_ms") <= F.col("gap_to") + s.comeback_window_days * DAY_MS))
    return after.groupBy("id", "gap_days", "gap_from", "gap_to").agg(F.count(F.lit(1)).alias("plays_after")).filter(F.col("plays_after") >= s.comeback_least_plays)


def comebacks(plays: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The same from plays alone."""
    return comebacks_after(plays, longest_gap(plays), s)
