"""Ranked text search over an index that is written once.

The index has three tables. Postings, one row per (kind, id, token) with the token's count and the document's length, lie by the
first letter of the token and are sorted by token, so that a query reads the folders of its tokens' letters and of those
the row groups that hold them. Documents lie by kind with what filters look at. Totals are one row. Query tokens are joined by
AND and the last is a prefix. Rank is BM25 with k1 1.2 and b 0.75; filters cut documents before any is ranked.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.config import DAY_MS

K1, B = 1.2, 0.75
#: What a match of each kind is multiplied by.
BOOST = {"artist": 1.15, "album": 1.05, "track": 1.0, "era": 1.1, "tag": 1.2, "collection": 1.2}


def fold(text: str | None) -> str | None:
    """Lower case without diacritics."""
    if text is None:
        return None
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold)


_fold_any = F.pandas_udf(_folded, T.StringType())


def folded(text: str) -> Column:
    """Python folds the texts that are not ASCII."""
    plain = F.col(text).rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(text)).otherwise(_fold_any(F.when(~plain, F.col(text))))


def tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_tokens(query: str) -> list[str]:
    return [x for x in re.split(r"[\W_]+", query.lower()) if x]


def postings(entries: DataFrame, fold_text: bool = True) -> DataFrame:
    """(kind, id, token, tf, length) of rows (kind, id, body)."""
    body = folded("body") if fold_text else F.col("body")
    words = entries.select("kind", "id", tokens(body).alias("words")).select("kind", "id", F.size("words").alias("length"), F.explode("words").alias("token"))
    return words.groupBy("kind", "id", "token", "length").agg(F.count(F.lit(1)).alias("tf"))


def letter(token: Column) -> Column:
    """The folder of a token: its first letter or digit if that is ASCII, else the block of 256 characters that it is in."""
    first = F.substring(token, 1, 1)
    return F.when(first.rlike("[a-z0-9]"), first).otherwise(F.concat(F.lit("u"), F.lower(F.hex(F.shiftright(F.ascii(first), 8)))))


def _letter(token: str) -> str:
    return token[0] if re.match("[a-z0-9]", token) else f"u{ord(token[0]) >> 8:x}"


@dataclass(frozen=True)
class Index:
    """A written index: postings by letter, documents by kind, one row of totals."""

    spark: SparkSession
    folder: str

    def postings(self, words: list[str]) -> DataFrame:
        """The postings of tokens: (kind, id, length, tf, n) where n is the place of the matched query token."""
        tests = [F.col("token") == w for w in words[:-1]] + [F.col("token").startswith(words[-1])]
        rows = self.spark.read.schema("kind string, id string, token string, length int, tf long, letter string").parquet(f"{self.folder}/postings")
        rows = rows.filter(F.col("letter").isin(sorted({_letter(w) for w in words}))).filter(reduce(operator.or_, tests))
        which = F.array_compact(F.array(*[F.when(t, i) for i, t in enumerate(tests)]))
        return rows.select("kind", "id", "length", "tf", F.explode(which).alias("n"))

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/documents")

    @property
    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/totals")


#: What a document has beside its texts; entries without a row among the attributes have nulls there and no plays.
ATTRIBUTES = "plays long, ms_played long, first_ts long, last_ts long, lost_score double, favorite boolean, retired boolean, tags array<string>, years array<int>"


def build(folder: str, entries: DataFrame, attributes: DataFrame) -> Index:
    """Write an index of entries (kind, id, title, subtitle, artist_id) with their attributes (kind, id and ``ATTRIBUTES``)."""
    known = attributes.select("kind", "id", *[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in ATTRIBUTES.split(", ")])
    documents = entries.join(known, ["kind", "id"], "left").fillna(0, ["plays", "ms_played"])
    index = Index(entries.sparkSession, folder)
    documents.repartitionByRange("kind", "id").write.partitionBy("kind").parquet(f"{folder}/documents")
    rows = postings(index.documents.select("kind", "id", F.concat_ws(" ", "title", "subtitle").alias("body"))).withColumn("letter", letter(F.col("token")))
    rows.repartitionByRange("letter", "token", "id").sortWithinPartitions("letter", "token", "id").write.partitionBy("letter").parquet(f"{folder}/postings")
    written = index.spark.read.parquet(f"{folder}/postings").select("kind", "id", "length").distinct()
    written.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length")).coalesce(1).write.parquet(f"{folder}/totals")
    return index


@dataclass(frozen=True)
class Filters:
    """What a search is narrowed to; None doesn't narrow. Years are those of UTC."""

    kinds: tuple[str, ...] | None = None
    min_plays: int | None = None
    year: int | None = None
    first_from: int | None = None
    first_to: int | None = None
    last_from: int | None = None
    last_to: int | None = None
    artist: int | None = None
    tag: str | None = None
    min_lost: float | None = None
    status: str = "any"

    def condition(self, now: int) -> Column:
        """A document that lacks what a filter asks for is left out; a year is asked of tracks, artists and albums only."""
        kind = F.col("kind")
        first, last = (F.year(F.timestamp_millis(c)) for c in ("first_ts", "last_ts"))
        tests = [
            (self.kinds, lambda x: kind.isin(*x)), (self.min_plays, lambda x: F.col("plays") >= x), (self.year, lambda x: ~kind.isin("track", "artist", "album") | F.array_contains("years", x)),
            (self.first_from, lambda x: first >= x), (self.first_to, lambda x: first <= x), (self.last_from, lambda x: last >= x), (self.last_to, lambda x: last <= x),
            (self.artist, lambda x: kind.isin("track", "artist", "album") & (F.col("artist_id") == x)), (self.tag, lambda x: (kind == "track") & F.array_contains("tags", x)), (self.min_lost, lambda x: (kind == "track") & (F.col("lost_score") >= x)),
        ]
        out = reduce(operator.and_, [F.coalesce(test(x), F.lit(False)) for x, test in tests if x not in (None, ())], F.lit(True))
        if self.status in ("favorite", "retired"):
            out = out & (kind == "track") & F.coalesce(F.col(self.status), F.lit(False))
        elif self.status == "dormant":
            out = out & F.coalesce(F.lit(now) - F.col("last_ts") >= 365 * DAY_MS, F.lit(False))
        elif self.status == "active":
            out = out & F.coalesce(F.lit(now) - F.col("last_ts") <= 180 * DAY_MS, F.lit(False))
        elif self.status != "any":
            raise ValueError(f"no such status: {self.status}")
        return out


def _hits(index: Index, words: list[str], documents: DataFrame | None) -> DataFrame:
    """(kind, id, length, hits) of documents that hold every token."""
    rows = index.postings(words)
    if documents is not None:
        rows = rows.join(documents.select("kind", "id"), ["kind", "id"], "left_semi")
    hit = rows.groupBy("kind", "id", "length", "n").agg(F.sum("tf").alias("tf"))
    return hit.groupBy("kind", "id", "length").agg(F.collect_list(F.struct("n", "tf")).alias("hits")).filter(F.size("hits") == len(words))


def _words(query: str) -> list[str]:
    return [fold(x) for x in query_tokens(query)]


def matching(index: Index, query: str) -> DataFrame:
    """(kind, id) of documents that hold every token. Nothing to look for gives no row."""
    words = _words(query)
    return _hits(index, words, None).select("kind", "id") if words else index.documents.select("kind", "id").limit(0)


def ranked(index: Index, query: str, documents: DataFrame | None = None) -> DataFrame:
    """(kind, id, text_score, score) of documents that hold every token, of those in ``documents`` where given (with their plays).

    Document frequencies are those of the whole index. The score is twice the text's, and ln(1 + plays) where plays are given.
    Nothing to look for lists the given documents.
    """
    words = _words(query)
    boost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BOOST.items() for x in kv]), F.col("kind")), F.lit(1.0))
    if not words:
        scored = (index.documents.select("kind", "id").limit(0) if documents is None else documents).withColumn("text_score", F.lit(0.0))
    else:
        df = index.postings(words).select("kind", "id", "n").distinct().groupBy("n").agg(F.count(F.lit(1)).alias("df"))
        rows = _hits(index, words, documents).select("kind", "id", "length", F.explode("hits").alias("h")).select("kind", "id", "length", "h.n", "h.tf")
        rows = rows.join(F.broadcast(df), "n").join(F.broadcast(index.totals))  # a row per query token, and one row
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
        scored = rows.groupBy("kind", "id").agg(F.sum(part).alias("text_score"))
        if documents is not None:
            scored = scored.join(documents, ["kind", "id"])
    plays = F.lit(0.0) if documents is None else F.log1p(F.col("plays").cast("double"))
    return scored.withColumn("score", (2 * F.col("text_score") + plays) * boost)


def found(index: Index, query: str, filters: Filters, now: int, limit: int, offset: int = 0) -> DataFrame:
    """A page of (kind, id, title, subtitle, plays, ms_played, last_ts, score), best first; an empty query lists all that pass the filters."""
    documents = index.documents.filter(filters.condition(now)).select("kind", "id", "title", F.nullif("subtitle", F.lit("")).alias("subtitle"), "plays", "ms_played", "last_ts")
    rows = ranked(index, query, documents).drop("text_score")
    return rows.orderBy(F.desc("score"), F.desc("plays"), "kind", "id").offset(offset).limit(limit)
