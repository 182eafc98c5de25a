"""Eras: stretches of months that sound alike, cut where the mix of artists changes.

Month vectors, boundary distances and change points are joins and windows over all listeners, months and entities. What remains is a
fixpoint over the segments of one listener's months, a few hundred rows of forty weights; a group is one listener.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.config import DEFAULTS, Settings
from playtrace.operators.rollups import tasks_of
from playtrace.operators.sequences import month_number

MONTHS = 12


def month_vectors(months: DataFrame, key: str, s: Settings = DEFAULTS) -> DataFrame:
    """(listener, i, ym, id, w): square roots of the time of each month's strongest entities; i counts a listener's calendar months from the first."""
    rank = F.row_number().over(Window.partitionBy("listener", "ym").orderBy(F.desc("ms_played"), key))
    top = months.filter("ms_played > 0").withColumn("rn", rank).filter(F.col("rn") <= s.era_vector_size)
    first = months.groupBy("listener").agg(F.min(month_number(F.col("ym"))).alias("m0"))
    return top.join(first, "listener").select("listener", (month_number(F.col("ym")) - F.col("m0")).cast("long").alias("i"), "ym", F.col(key).alias("id"), F.sqrt(F.col("ms_played").cast("double")).alias("w"))


def calendar_months(months: DataFrame) -> DataFrame:
    """(listener, i, ym, plays, ms_played) of every calendar month from a listener's first to the last, silent ones with zeros."""
    number = month_number(F.col("ym")) - 1
    bounds = months.groupBy("listener").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    every = bounds.select("listener", "lo", F.explode(F.sequence("lo", "hi")).alias("m")).select(
        "listener", (F.col("m") - F.col("lo")).cast("long").alias("i"), F.format_string("%04d-%02d", F.floor(F.col("m") / MONTHS), F.col("m") % MONTHS + 1).alias("ym")
    )
    sums = months.groupBy("listener", "ym").agg(F.sum("q_plays").alias("plays"), F.sum("ms_played").alias("ms_played"))
    return every.join(sums, ["listener", "ym"], "left").select("listener", "i", "ym", F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("ms_played", F.lit(0)).alias("ms_played"))


def boundaries(vectors: DataFrame, every: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(listener, i, ym, distance): 1 - cosine of the months before and after each boundary; 0.5 against silence, 0 between silences."""
    w = s.era_window_months
    # a month lies after the boundaries i-w+1..i and before the boundaries i+1..i+w
    side = F.explode(F.array(*[F.struct((F.col("i") + d).alias("at"), F.lit(d > 0).alias("before")) for d in range(1 - w, w + 1)])).alias("s")
    sums = vectors.select("listener", "id", "w", side).groupBy("listener", F.col("s.at").alias("i"), "id").agg(F.sum(F.when(F.col("s.before"), F.col("w"))).alias("b"), F.sum(F.when(~F.col("s.before"), F.col("w"))).alias("a"))
    norms = sums.groupBy("listener", "i").agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    dot, aa, bb = F.coalesce("dot", F.lit(0.0)), F.coalesce("aa", F.lit(0.0)), F.coalesce("bb", F.lit(0.0))
    distance = F.when(F.col("i") == 0, 0.0).when((aa == 0) & (bb == 0), 0.0).when((aa == 0) | (bb == 0), 0.5).otherwise(1 - dot / F.sqrt(F.when(aa * bb > 0, aa * bb).otherwise(1.0)))
    return every.select("listener", "i", "ym").join(norms, ["listener", "i"], "left").select("listener", "i", "ym", distance.alias("distance"))


def change_points(distances: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(listener, i, ym, distance) of boundaries that are large and not smaller than their neighbours. A row per listener and month comes in."""
    line = Window.partitionBy("listener").orderBy("i")
    left = F.when(F.col("i") == 1, 0.0).otherwise(F.coalesce(F.lag("distance").over(line), F.lit(0.0)))
    marked = distances.withColumn("left", left).withColumn("right", F.coalesce(F.lead("distance").over(line), F.lit(0.0)))
    return marked.filter((F.col("i") >= 1) & (F.col("distance") >= s.era_change) & (F.col("distance") >= F.col("left")) & (F.col("distance") >= F.col("right"))).select("listener", "i", "ym", "distance")


def _cosine(a: dict, b: dict) -> float:
    na, nb = sum(x * x for x in a.values()) ** 0.5, sum(x * x for x in b.values()) ** 0.5
    return sum(x * b.get(k, 0.0) for k, x in a.items()) / (na * nb) if na and nb else 0.0


class _Segment:
    def __init__(self, begin: int, end: int, strength: float, months: list[dict]):
        self.begin, self.end, self.strength = begin, end, strength
        self.vector: dict = {}
        for month in months[begin : end + 1]:
            for k, w in month.items():
                self.vector[k] = self.vector.get(k, 0.0) + w


def settle(strengths: list[float], points: list[int], months: list[dict], plays: list[int], s: Settings = DEFAULTS) -> list[tuple[int, int, float]]:
    """Final (begin, end, strength) of segments. Short weak ones join the neighbour they resemble, alike neighbours merge,
    silent edges go."""
    if sum(n >= s.era_least_month_plays for n in plays) < s.era_least_active_months:
        return []
    starts = [0, *(x for x in points if x > 0)]
    found = [_Segment(a, b - 1, strengths[a], months) for a, b in zip(starts, [*starts[1:], len(months)], strict=True)]

    def join(i: int, j: int, strength: float) -> None:
        found[i : j + 1] = [_Segment(found[i].begin, found[j].end, strength, months)]

    def short() -> int | None:
        return next((i for i, x in enumerate(found) if x.end - x.begin + 1 < s.era_least_months and x.strength < s.era_strong_change), None) if len(found) > 1 else None

    while (i := short()) is not None:
        before = _cosine(found[i].vector, found[i - 1].vector) if i else -1.0
        after = _cosine(found[i].vector, found[i + 1].vector) if i + 1 < len(found) else -1.0
        if before >= after:
            join(i - 1, i, found[i - 1].strength)
        else:
            join(i, i + 1, max(found[i].strength, found[i + 1].strength))

    def alike() -> int | None:
        return next((i for i, (a, b) in enumerate(zip(found, found[1:], strict=False)) if a.vector and b.vector and _cosine(a.vector, b.vector) >= s.era_merge), None)

    while (i := alike()) is not None:
        join(i, i + 1, found[i].strength)
    out = []
    for x in found:
        loud = [i for i in range(x.begin, x.end + 1) if plays[i] >= s.era_least_month_plays]
        if loud and sum(plays[loud[0] : loud[-1] + 1]) >= s.era_least_month_plays:
            out.append((loud[0], loud[-1], round(x.strength, 3)))
    return out


def segments(vectors: DataFrame, every: DataFrame, distances: DataFrame, points: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(listener, era, start_ym, end_ym, months, strength): a group is one listener's calendar, a row per month, so the calendar bounds it."""
    maps = vectors.groupBy("listener", "i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "w"))).alias("vector"))
    rows = every.select("listener", "i", "ym", "plays").join(maps, ["listener", "i"], "left").join(distances.select("listener", "i", "distance"), ["listener", "i"]).join(points.select("listener", "i", F.lit(True).alias("cut")), ["listener", "i"], "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        months = [dict(v) if v is not None else {} for v in pdf["vector"]]
        cuts = [int(i) for i, c in zip(pdf["i"], pdf["cut"], strict=True) if c is True]
        ym = pdf["ym"].tolist()
        got = settle(pdf["distance"].tolist(), cuts, months, [int(x) for x in pdf["plays"]], s)
        return pd.DataFrame([(key[0], k, ym[a], ym[b], b - a + 1, x) for k, (a, b, x) in enumerate(got)], columns=["listener", "era", "start_ym", "end_ym", "months", "strength"])

    return rows.groupBy("listener").applyInPandas(run, f"listener {every.schema['listener'].dataType.simpleString()}, era long, start_ym string, end_ym string, months long, strength double")


def title(first: F.col, second: F.col, share1, share2, months, start, end):
    """An era's name from its leading artists' names and shares."""
    # a name that is nothing but an article stays as it is
    bare = [F.coalesce(F.nullif(F.trim(F.regexp_replace(x, r"(?i)^(the|a|an)\s+", "")), F.lit("")), x) for x in (first, second)]
    suffix = F.when(months <= 5, " Period").when(months <= 17, " Era").otherwise(" Years")
    single, pair = F.concat(F.lit("The "), bare[0], suffix), F.concat(F.lit("The "), bare[0], F.lit(" / "), bare[1], suffix)
    years = F.when(F.substring(start, 1, 4) == F.substring(end, 1, 4), F.substring(start, 1, 4)).otherwise(F.concat(F.substring(start, 1, 4), F.lit("–"), F.substring(end, 1, 4)))
    years = F.concat(F.lit("The "), years, F.lit(" Stretch"))
    second_strong = second.isNotNull() & (share2 >= 0.13) & (share2 >= 0.55 * share1)
    return (
        F.when((share1 >= 0.24) & second_strong, pair).when(share1 >= 0.24, single).when(second.isNotNull() & (share1 + share2 >= 0.30), pair).otherwise(years)
    )


def _leading(found: DataFrame, months: DataFrame, key: str, order: list, most: int = 8, dealt: bool = False) -> DataFrame:
    """(listener, era, key, name, ms_played, q_plays, rn) of the entities that lead each era. Many entities are ``dealt`` to bounded tasks."""
    inside = months.join(found.select("listener", "era", "start_ym", "end_ym"), "listener").filter((F.col("ym") >= F.col("start_ym")) & (F.col("ym") <= F.col("end_ym")))
    if dealt:
        inside = inside.select("listener", "era", key, "ms_played", "q_plays").repartition(tasks_of(months), "listener", key)
    by = inside.groupBy("listener", "era", key).agg(F.sum("ms_played").alias("ms_played"), F.sum("q_plays").alias("q_plays"))
    ranked = by.withColumn("rn", F.row_number().over(Window.partitionBy("listener", "era").orderBy(*order, key))).filter(F.col("rn") <= most)
    return ranked.withColumn("name", F.col(key).cast("string"))


def era_measures(found: DataFrame, artists: DataFrame, tracks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Eras with totals, new artists, leading artists (8 by time), leading tracks (8 by qualifying plays), accent (cycles over five) and title.

    ``artists`` and ``tracks`` are monthly counts by listener; ``names`` has (artist_id, name), else ids name artists.
    """
    era = ["listener", "era"]
    spans = found.select(*era, "start_ym", "end_ym")
    inside = (F.col("ym") >= F.col("start_ym")) & (F.col("ym") <= F.col("end_ym"))
    months = artists.groupBy("listener", "ym").agg(*[F.sum(c).alias(c) for c in ("plays", "q_plays", "ms_played")])
    totals = months.join(spans, "listener").filter(inside).groupBy(*era).agg(F.sum("plays").alias("streams"), F.sum("q_plays").alias("plays"), F.sum("ms_played").alias("ms_played"))
    new = artists.groupBy("listener", "artist_id").agg(F.min("ym").alias("ym")).groupBy("listener", "ym").agg(F.count(F.lit(1)).alias("n"))
    new = new.join(spans, "listener").filter(inside).groupBy(*era).agg(F.sum("n").alias("new_artists"))
    lead = _leading(found, artists, "artist_id", [F.desc("ms_played")])
    if names is not None:
        lead = lead.drop("name").join(names, "artist_id")
    lead = lead.join(totals.select(*era, F.col("ms_played").alias("total")), era)
    share = F.when(F.col("total") > 0, F.col("ms_played") / F.col("total")).otherwise(0.0)
    leaders = lead.groupBy(*era).agg(
        F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("leaders"), *[F.max(F.when(F.col("rn") == i, share)).alias(f"share{i}") for i in (1, 2)], *[F.max(F.when(F.col("rn") == i, F.col("name"))).alias(f"name{i}") for i in (1, 2)]
    )
    heard = _leading(found, tracks, "track_id", [F.desc("q_plays")], dealt=True).groupBy(*era).agg(F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("tracks"))
    named = found.join(totals, era).join(leaders, era).join(heard, era).join(new, era, "left")
    label = title(F.col("name1"), F.col("name2"), F.col("share1"), F.coalesce("share2", F.lit(0.0)), F.col("months"), F.col("start_ym"), F.col("end_ym"))
    return named.select(
        *era, "start_ym", "end_ym", "months", "strength", "plays", "streams", "ms_played", F.coalesce("new_artists", F.lit(0)).alias("new_artists"), label.alias("title"),
        F.transform("leaders", lambda x: x["name"]).alias("leaders"), F.transform("tracks", lambda x: x["name"]).alias("tracks"), (F.col("era") % 5).alias("accent"),
    )


def with_names(found: DataFrame, names: DataFrame) -> DataFrame:
    """Eras with ``custom_title`` and the title that a listener gave them, where one was given.

    ``names`` has (listener, start_ym, custom_title), null or blank to take a name back. A rebuild gives eras new numbers, so a name
    stays with the era that begins where the named one did.
    """
    given = names.select("listener", "start_ym", F.nullif(F.trim("custom_title"), F.lit("")).alias("custom_title")).filter("custom_title IS NOT NULL").groupBy("listener", "start_ym").agg(F.max("custom_title").alias("custom_title"))
    return found.join(given, ["listener", "start_ym"], "left").withColumn("auto_title", F.col("title")).withColumn("title", F.coalesce("custom_title", "title"))


def at(found: DataFrame, months: DataFrame) -> DataFrame:
    """Each (listener, ym) of ``months`` with the number and title of the era that holds it, null outside all eras."""
    spans = found.select("listener", "era", "title", "start_ym", "end_ym")
    joined = months.join(spans, (months["listener"] == spans["listener"]) & (months["ym"] >= spans["start_ym"]) & (months["ym"] <= spans["end_ym"]), "left")
    return joined.select(months["listener"], months["ym"], "era", "title")
