"""Bounded samples of labelled rows, the only rows that models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters are not fitted on (they are scored like all others).
LONGEST = 20_000


def fold(key, parts: int):
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def unit(*columns) -> Column:
    """A number in [0, 1) from a hash of the columns, in steps of 2^-53."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def share(n: int, most: int) -> float:
    """The share of ``n`` keys to look at so that ``most`` of them are there all but surely, at any ``n``."""
    return min(1.0, (2 * most + 1000) / max(n, 1))


def spread(rows: DataFrame, key: str, most: int, n: int | None = None) -> DataFrame:
    """The ``most`` rows with the least hashes of their keys, one row per key: the same rows on every run and under any partitioning.

    ``n`` is the number of rows, counted if not given. Only rows whose hash is below a share of that size are gathered to
    be ordered; of rows with one key the least stays.
    """
    few = rows.filter(unit(F.col(key), F.lit(17)) < share(rows.count() if n is None else n, most))
    rest = [x for x in rows.columns if x != key]
    once = few.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*") if rest else few.distinct()
    return once.orderBy(unit(F.col(key), F.lit(17)), key).limit(most)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, allowed=None, longest: int = LONGEST) -> list[tuple[int, str, int]]:
    """Up to ``most`` (doc_id, text, label) on the driver, in doc_id order, of non-null, not very long texts.

    Labels are sampled before the join: the broadcast side has ``most`` rows at most. Conflicting labels of one document
    count as 1; of several texts with one key the least is taken.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    if allowed is not None:
        rows = rows.filter(allowed("id"))
    picked = spread(rows.groupBy("id").agg(F.max("y").alias("y")), "id", most)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= longest))
    got = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas().sort_values("id", kind="stable")
    return list(zip(got["id"].tolist(), got["text"].tolist(), got["y"].tolist(), strict=True))
