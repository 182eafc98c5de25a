"""Ranked lexical search over an index of document clusters, exact.

Documents are reordered by recursive graph bisection (fitted on a bounded sample, applied to all of them) and the new order is
cut into shards of a bounded number of documents. A shard is one row of the index: its documents' ids in order, and for
each term the documents that hold it, each one's part of a score, and the largest part. The sum of the largest parts of
an item's terms bounds every score of a shard. Items visit shards by falling bound, in rounds, and stop where the bound is
below their tenth score: equal bounds are visited, since an equal score ranks by doc_id. Shards hold ids in ascending
order, so that ties are settled by doc_id and not by the new order.

Items are taken in blocks of a bounded number of terms. What a task gets of a block, and what comes back to the driver from
a round, are one number for each of its items or terms; scores, shards and bounds stay on the cluster. Terms are compared by 64-bit
content hashes. A leaf of the tree that holds many documents, such as copies, is dealt to several shards.

Defined results: a null text has no terms and its document isn't counted; repeated rows are documents of their own; null ids
rank last among equals; repeated rows of an item count once, several texts of one item are one query; an item without a
scored document gives no row; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm import bisection, sampling, textops
from playtrace.shared import discard, written

#: Documents that the tree is fitted on; documents of a shard (twice as many at most); shards that an item visits in each
#: round but the last, which visits all whose bound is high enough; terms of a block of items.
FIT_ROWS, SHARD, ROUNDS, BLOCK_TERMS, TOP = 2000, 384, (4, 32), 1 << 20, 10

#: Bytes that belong to terms: ASCII letters and digits, and all of other characters.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def terms_of(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, times) of each text's distinct terms, in order of text and hash, and each text's number of terms.

    ``wanted``, sorted hashes, leaves out other terms from the first three.
    """
    words = textops.words_of(column, inside=INSIDE, lower=LOWER)
    hashes, text = words.hashes().view(np.int64), words.text
    if wanted is not None:
        held = within(hashes, wanted)
        hashes, text = hashes[held], text[held]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    return text[first], hashes[first], np.diff(np.append(first, len(hashes))), words.counts


def within(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which hashes are among ``wanted``. A bitmap passes few others on to the search."""
    bits = np.zeros(1 << 20, bool)
    bits[wanted & 0xFFFFF] = True
    maybe = np.flatnonzero(bits[hashes & 0xFFFFF])
    found = np.zeros(len(hashes), bool)
    if len(wanted) and len(maybe):
        place = np.minimum(np.searchsorted(wanted, hashes[maybe]), len(wanted) - 1)
        found[maybe[wanted[place] == hashes[maybe]]] = True
    return found


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> bisection.Tree:
    """The tree over a sample of ``rows`` documents of at most ``sampling.LONGEST`` characters."""
    short = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull() & F.col("key").isNotNull() & (F.length("text") <= sampling.LONGEST))
    texts = sampling.spread(short, "key", rows).toPandas().sort_values("key", kind="stable")["text"]
    doc, hashes, _, _ = terms_of(pa.array(texts, pa.string()))
    return bisection.fit(doc, hashes, len(texts))


def vectors(docs: DataFrame, tree: bisection.Tree, wanted: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, leaf, salt, terms, times) of documents with a term: their leaf in the tree and their distinct terms, or the wanted of them."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    both = None if wanted is None else np.union1d(wanted, tree.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() * 7919
        for whole in batches:
            for batch in textops.slices(whole):
                doc, hashes, times, n = terms_of(batch.column(1), both)
                led = within(hashes, tree.terms)
                leaf = tree.leaves(doc[led], np.searchsorted(tree.terms, hashes[led]), len(n))
                if wanted is not None:
                    kept = within(hashes, wanted)
                    doc, hashes, times = doc[kept], hashes[kept], times[kept]
                held = np.bincount(doc, minlength=len(n))
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(leaf, pa.int32()), pa.array(salt + np.arange(len(n)), pa.int64()), _lists(hashes, held, pa.int64()), _lists(times, held, pa.int64())],
                    ["key", "n", "leaf", "salt", "terms", "times"],
                )
                salt += len(n)
                yield out.filter(pa.array(n > 0))

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, n long, leaf int, salt long, terms array<long>, times array<long>")


@dataclass
class Index:
    """Rows (shard, keys, terms, ends, docs, parts, best), and the counts that the parts depend on."""

    shards: DataFrame
    n_docs: int


def index(docs: DataFrame, wanted: np.ndarray | None = None, key: str = "doc_id", text: str = "text", shard: int = SHARD, tree: bisection.Tree | None = None) -> Index:
    """Index every row of ``docs``; with ``wanted`` (sorted term hashes) only those terms' documents are written."""
    rows = written(vectors(docs, tree or fitted(docs, key, text), wanted, key, text), "vectors")
    # a row per leaf: their number is fixed
    counts = sorted((r.leaf, r.docs, r.words) for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).collect())
    n_docs, words = sum(c for _, c, _ in counts), sum(w for _, _, w in counts)
    dealt, base, room = [], 0, 0
    for leaf, n, _ in counts:
        # small neighbours share a shard, a large leaf has several of its own
        if room + n > shard and room:
            base, room = base + 1, 0
        many = -(-n // shard)
        dealt.append((leaf, base, many))
        base, room = (base, room + n) if many == 1 else (base + many, 0)
    places = docs.sparkSession.createDataFrame(dealt, "leaf int, base int, many int")
    placed = rows.join(F.broadcast(places), "leaf").select(  # a row per leaf
        (F.col("base") + F.pmod(F.xxhash64("salt"), F.col("many"))).cast("int").alias("shard"), "key", "n", "terms", "times"
    )
    kind = rows.schema["key"].dataType.simpleString()

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending")]).combine_chunks()
        lists = group["terms"].combine_chunks(), group["times"].combine_chunks()
        terms, times = (np.asarray(x.flatten()) for x in lists)
        doc = np.repeat(np.arange(len(group)), np.diff(np.asarray(lists[0].offsets)))
        n = np.asarray(group["n"])
        m = 100 - 75 + (75 * n * n_docs) // max(words, 1)
        part = (1_000_000_000 * times) // (1000 * times + 8 * m[doc])
        order = np.lexsort((doc, terms))
        terms, doc, part = terms[order], doc[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        best = np.maximum.reduceat(part, first) if len(first) else part
        ends = np.append(first[1:], len(terms)) if len(first) else first
        one = {"keys": group["key"].combine_chunks(), "terms": pa.array(terms[first]), "ends": pa.array(ends, pa.int32()), "docs": pa.array(doc, pa.int32()), "parts": pa.array(part, pa.int32()), "best": pa.array(best, pa.int32())}
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in one.values()]
        return pa.Table.from_arrays([pa.array([group["shard"][0].as_py()], pa.int32()), *arrays], ["shard", *one])

    built = placed.groupBy("shard").applyInArrow(build, f"shard int, keys array<{kind}>, terms array<long>, ends array<int>, docs array<int>, parts array<int>, best array<int>")
    shards = written(built, "index")
    discard(rows)
    return Index(shards, n_docs)


@dataclass
class Block:
    """Some items: the distinct terms of all, and for each item the places of its terms among them and their times."""

    items: list
    terms: np.ndarray
    first: np.ndarray
    at: np.ndarray
    times: np.ndarray


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """The items in blocks of about ``terms`` terms. One block at a time is on the driver."""
    rows = items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text")).groupBy("item").agg(F.array_join(F.sort_array(F.collect_set("text")), " ").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, -(-chars // (4 * terms)))
    for i in range(many):
        got = rows.filter(F.pmod(F.xxhash64("item"), F.lit(many)) == i).orderBy("item").collect()
        doc, hashes, times, _ = terms_of(pa.array([r.text for r in got], pa.string()))
        known, at = np.unique(hashes, return_inverse=True)
        yield Block([r.item for r in got], known, np.searchsorted(doc, np.arange(len(got) + 1)), at, times)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as numpy arrays, and Arrow arrays for the keys."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {f.name: (c[i].as_py() if not pa.types.is_list(f.type) else c[i].values if f.name == "keys" else np.asarray(c[i].values)) for f, c in zip(batch.schema, batch.columns, strict=True)}


def document_counts(held: Index, block: Block) -> np.ndarray:
    """How many documents hold each term of the block. Each task sends one count for each term it met."""
    terms = block.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for row in _rows(batches):
            found = within(row["terms"], terms)
            total[np.searchsorted(terms, row["terms"][found])] += np.diff(row["ends"], prepend=0)[found]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "df"])

    got = held.shards.select("terms", "ends").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(len(terms), np.int64)
    df[got["at"].to_numpy(np.int64)] = got["df"].to_numpy(np.int64)
    return df


def _bounds(row: dict, block: Block, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bound of each item's scores in a shard, and the place in the shard of each term of the block, or -1."""
    place = np.full(len(block.terms), -1, np.int64)
    if len(row["terms"]):
        near = np.minimum(np.searchsorted(row["terms"], block.terms), len(row["terms"]) - 1)
        same = row["terms"][near] == block.terms
        place[same] = near[same]
    most = np.where(place >= 0, row["best"][place] if len(row["best"]) else 0, 0)
    total = np.concatenate([[0], np.cumsum(gains * most[block.at])])
    return np.diff(total[block.first]), place


def bounds(held: Index, block: Block, gains: np.ndarray) -> DataFrame:
    """(item, shard, bound) of all pairs with a bound above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            bound, _ = _bounds(row, block, gains)
            some = np.flatnonzero(bound > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), row["shard"], np.int32)), pa.array(bound[some])], ["item", "shard", "bound"])

    return held.shards.select("shard", "terms", "best").mapInArrow(run, "item int, shard int, bound long")


def visits(held: Index, block: Block, gains: np.ndarray, least: np.ndarray, below: np.ndarray, enough: np.ndarray, top: int) -> DataFrame:
    """(item, key, score): each shard's best documents for the items that visit it now, which are those with least <= bound < below.

    Documents that score less than ``enough``, the item's last place so far, are left out.
    """
    kind = held.shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            bound, place = _bounds(row, block, gains)
            items, docs, scores = [], [], []
            for i in np.flatnonzero((bound >= least) & (bound < below) & (bound > 0)):
                span = slice(block.first[i], block.first[i + 1])
                where, gain = place[block.at[span]], gains[span]
                gain, where = gain[where >= 0], where[where >= 0]
                ends = row["ends"][where].astype(np.int64)
                begins = np.where(where > 0, row["ends"][where - 1], 0).astype(np.int64)
                size = ends - begins
                taken = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                score = np.zeros(len(row["keys"]), np.int64)
                np.add.at(score, row["docs"][taken], np.repeat(gain, size) * row["parts"][taken])
                good = np.flatnonzero(score >= max(1, enough[i]))
                # places in a shard are in the order of ids
                good = good[np.argsort(-score[good], kind="stable")[:top]]
                items.append(np.full(len(good), i, np.int32))
                docs.append(good)
                scores.append(score[good])
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), row["keys"].take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["item", "key", "score"])

    return held.shards.mapInArrow(run, f"item int, key {kind}, score long")


def best(rows: DataFrame, top: int) -> DataFrame:
    """(item, key, score, rank) of each item's ``top`` rows; Spark cuts each task's rows to as many before it sends them."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(held: Index, block: Block, top: int = TOP, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(item, key, score, rank): the exact best documents of each item of the block, by its place there."""
    n = len(block.items)
    gains = block.times * weights(held.n_docs, document_counts(held, block))[block.at]
    known = written(bounds(held, block, gains), "bounds")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    below, enough, found, tables = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), None, [known]
    for many in (*rounds, None):
        least = enough.copy()
        if many is not None:
            # one number for each item: the bound of the last shard that it visits in this round
            cut = known.withColumn("i", F.row_number().over(by_bound)).filter(F.col("i") <= many).groupBy("item").agg(F.min("bound").alias("bound")).toPandas()
            least[cut["item"].to_numpy(np.int64)] = np.maximum(enough[cut["item"].to_numpy(np.int64)], cut["bound"].to_numpy(np.int64))
        new = visits(held, block, gains, least, below, enough, top)
        found = written(best(new if found is None else new.unionByName(found.drop("rank")), top), "found")
        tables.append(found)
        last = found.filter(F.col("rank") == top).select("item", "score").toPandas()
        enough[last["item"].to_numpy(np.int64)] = last["score"].to_numpy(np.int64)
        below = np.minimum(below, least)
    discard(*tables[:-1])
    return found


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, shard: int = SHARD, rounds: tuple[int, ...] = ROUNDS, terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, key, score): each item's ``top`` documents with a score above 0, ties by ascending key."""
    spark, parts = docs.sparkSession, []
    tree = fitted(docs, key, text)
    kind = items.schema[item].dataType.simpleString()
    for block in blocks(items, item, item_text, terms):
        held = index(docs, block.terms, key, text, shard, tree)
        found = search(held, block, top, rounds)
        discard(held.shards)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.items)], f"item int, name {kind}")
        parts.append(found.join(F.broadcast(names), "item").select(F.col("name").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"))  # a block's items
    return reduce(DataFrame.unionByName, parts)


#: ``ranked`` over the tables documents and benchmark.
ORACLE = """
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), docs AS (
  SELECT d, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM words WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS total_docs, CAST(sum(n) AS BIGINT) AS total_terms FROM docs
), postings AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term
), items AS (
  SELECT item_id, string_agg(text, ' ' ORDER BY text) AS text FROM (SELECT DISTINCT item_id, text FROM benchmark) GROUP BY item_id
), wanted AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM items) GROUP BY item_id, term
), weighed AS (
  SELECT p.term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(total_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings AS p, totals WHERE p.term IN (SELECT term FROM wanted) GROUP BY p.term
), scored AS (
  SELECT item_id, doc_id, d, CAST(sum(w * times * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total_docs) // total_terms)))) AS BIGINT) AS score
  FROM totals, wanted JOIN weighed USING (term) JOIN postings USING (term) JOIN docs USING (d) GROUP BY item_id, doc_id, d
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
