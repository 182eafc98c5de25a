"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Targets: the sources' weights share a total; a source's target stops at a multiple of its size, and the excess is reshared
by weight. That fixed point is target = min(level x weight, cap) for one level, found from prefix sums over the sources.
Sampling: each document of a source is expected target / size times. Along the source, those expectations are
prefix-summed, one offset is added, and a document is emitted once for each integer boundary that its step crosses.

The order along a source runs from small to large documents, so that every stretch of sizes is sampled evenly. A source is
not sorted in one task: rows are sorted by range over all tasks, and only the counts of partitions are prefix-summed.

Defined results: null texts have size 0 and are never taken more often than others; a null source is a source of its own,
last in order; repeated rows are separate documents, of which ties in order may go either way; a source without words has
target 0; an empty table gives no rows; extra columns are kept by ``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.shared import written

#: Weights of the sources in their order, repeating; the mix as a share of all sizes; the cap as a multiple of a source.
WEIGHTS, TOTAL_SHARE, MOST_TIMES = (5, 2, 1), 1.5, 2
#: Cells that mix the order within a size class; a class is a size's bit length and its first four bits.
CELLS = 64
SEED = "mix"
WORDS = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of bytes other than ASCII white space; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORDS), "")), F.lit(0)).cast("long")


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) for each source, the same on every run: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_TIMES) -> DataFrame:
    """From (source, size): (source, source_size, weight, target). Windows over all rows here see one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    # treating one more source than needed as capped only lowers the level, so the largest level that fits is the right one
    filled = (
        ranked.withColumn("capped", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    )
    # no source is left open only if the total reaches all caps
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **goal) -> DataFrame:
    """One row per document: key, size, source_size, target, copies, taken (words that the mix takes of it)."""
    sized = written(sized_rows(docs, key, text, source), "sizes")
    return planned(sized, sized, seed, **goal).withColumnRenamed("key", key)


def sized_rows(docs: DataFrame, key: str, text: str, source: str, *more: Column) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text).cast("string")).alias("size"), *more)


def placed_rows(sized: DataFrame) -> DataFrame:
    """``sized`` with the place of each row in its source, from 1, in the order of size class, cell, size and key.

    Rows are dealt by range of that order and numbered within their partition; the counts of each partition and source are
    prefix-summed. So no source, class or key is ranked in one task; the row's number in the input splits equal rows.
    """
    bits = F.length(F.bin("size"))
    step = (bits * 16 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 4, F.lit(0)))).cast("long")
    digest = F.conv(F.substring(F.md5(F.col("key").cast("string").cast("binary")), 1, 4), 16, 10).cast("long")
    cell = F.coalesce(digest % CELLS, F.lit(0)).cast("long")
    order = ["source", "class", "cell", "size", "key", "row_number"]
    dealt = sized.withColumns({"class": step, "cell": cell, "row_number": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(dealt.drop("class", "cell", "row_number").withColumn("number", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("number", 33).alias("part")
    parts = numbered.groupBy("source", part).agg(F.min("number").alias("begin"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.select(F.col("source").alias("part_source"), F.col("part").alias("of_part"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("shift"))
    joined = numbered.join(begun, F.col("source").eqNullSafe(F.col("part_source")) & (F.shiftright("number", 33) == F.col("of_part")))
    return joined.withColumn("place", F.col("number") + F.col("shift") + 1).drop("part_source", "of_part", "shift", "number")


def planned(sized: DataFrame, counted: DataFrame, seed: str = SEED, **goal) -> DataFrame:
    """``plan`` from (key, source, size) and any further columns, which stay; ``counted`` has the same rows, for the counts."""
    goals = targets(counted.select("source", "size"), **goal).select(F.col("source").alias("goal_source"), "source_size", "target")
    joined = placed_rows(sized).join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shift = offset(F.col("source"), seed)
    copies = (F.floor(F.col("place") * rate + shift) - F.floor((F.col("place") - 1) * rate + shift)).cast("long")
    extra = [x for x in sized.columns if x not in ("key", "source", "size")]
    return joined.withColumn("copies", copies).select("key", *extra, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **goal) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    The whole row travels with its size through the ranking, so keys need not be unique.
    """
    names = docs.columns
    counted = written(sized_rows(docs, key, text, source), "sizes")
    full = planned(sized_rows(docs, key, text, source, F.struct(*[F.col(f"`{x}`") for x in names]).alias("row")), counted, seed, **goal)
    return full.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1])::DOUBLE AS weight, 2.0 * source_size::DOUBLE AS cap FROM by_source
), filled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS own_level FROM weighed
), leveled AS (
  SELECT source, source_size, weight, cap, max(CASE WHEN own_level * weight <= cap THEN own_level END) OVER () AS level FROM filled
), goals AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(level * weight, cap) END AS target,
    ('0x' || substr(md5('mix:' || coalesce('s' || source, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS shift FROM leveled
), placed AS (
  SELECT *, length(bin(size)) AS bits, ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT % 64 AS cell FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bits * 16 + (size >> greatest(bits - 4, 0)::BIGINT), cell, size, doc_id) AS place FROM placed
), rated AS (
  SELECT r.*, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate
  FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, source, size, source_size, target, CAST(floor(place * rate + shift) - floor((place - 1) * rate + shift) AS BIGINT) AS copies,
  CAST(floor(place * rate + shift) - floor((place - 1) * rate + shift) AS BIGINT) * size AS taken FROM rated
"""
