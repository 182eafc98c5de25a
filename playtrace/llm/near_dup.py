"""MinHash near-dedup of whole texts: BagMinHash signatures of five-word shingle multisets, banding, exact verification.

BagMinHash. A shingle that occurs w times is a Poisson process over the weights up to w. The weights are cut at whole
numbers; the process runs over a ladder of dyadic intervals, (0, 1], (1, 2], (2, 4], (4, 8] and so on, each with the rate of
its width, and inside an interval a point falls on a unit cell and is rejected above w. The ladder and the rejection stand in
for processes that are split level by level; they draw points of the same distribution. Points come in ascending order, each on one of M
components, which keeps the least; a process ends at the first point above the text's largest component. Two texts agree
in a component with a probability equal to their weighted Jaccard similarity.

Search. Equal texts are one node. Nodes that share a band of the signature share a bucket. No bucket is gathered:
each node is compared with leaders of its buckets, and verified links join nodes to components; then every pair of
one bucket that is still in different components, and whose signatures don't exclude a link, is verified too. So pairs
within a component are not expanded. Links between components are left out with the probabilities that the README states:
those of banding, and 4.3e-8 at a similarity of exactly 0.8 by the comparison of signatures. Before that, the shingles that only one
text of the remaining buckets has are counted: they can't be part of an overlap, so they bound each text's similarity; and
parities of each multiset bound the difference of two. Neither bound excludes a link, and variants of one text that differ
too much for one are never paired. Verification counts both multisets.

A class is a component of links of similarity 0.8 or more; its id is the least key of its documents.

Defined results: a null text is in a class of its own; texts without words are copies only of equal texts; a text of one to
four words has one shingle; repeated rows are in one class; a null key sorts first, so its class has a null id; an empty
table gives no rows; extra columns are kept by ``deduped``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm import textops
from playtrace.shared import discard, release, written

#: Words of a shingle; similarity of a link; components of a signature; components of a band.
SHINGLE, SIMILARITY, COMPONENTS, BAND = 5, 0.8, 128, 4
#: Rounds against leaders before the remaining pairs are compared.
ROUNDS = 2
#: Two bits of each component are compared first. At the least similarity 19 of 128 differ on average, with a deviation of 4; a link has more than this many with a probability of 4.3e-8, less than that of sharing no band (4.7e-8).
MOST_DIFFERENT = 43
#: 64-bit words of parities that bound the difference of two texts; they tell most for texts of up to as many shingles as they have bits.
PARITIES = 16
SUMS = [f"p{j}" for j in range(PARITIES)]
#: A leader is tried first only up to this many; a pair beyond is left to the comparison of what remains.
LIKELY = 32
#: About so many pairs of one text are verified in one task, and so many nodes of one bucket compared with the rest of it; others go to further slices.
PAIR_SLICE, BUCKET_SLICE = 512, 512
#: Keys over which the pairs of one text are spread to learn its number of slices.
SALTS = 64


def bag(words: textops.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count), distinct."""
    text, shingle = textops.shingles(words, hashes, SHINGLE)
    if not len(text):
        return text, shingle, np.zeros(0, np.int64)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(fresh)
    return text[at], shingle[at], np.diff(np.append(at, len(text)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(n_texts: int, text: np.ndarray, element: np.ndarray, count: np.ndarray, components: int = COMPONENTS) -> np.ndarray:
    """BagMinHash: texts x components of 32-bit values; zeros for a text without elements."""
    least = np.full(n_texts * components, np.inf)
    blocks = []
    start = 0
    while len(count) and (above := count > start).any():
        width = max(start, 1)
        k = int(above.sum())
        blocks.append((text[above], textops.mix(element[above] + np.uint64(start * 0x9E3779B97F4A7C15 % (1 << 64))), count[above], np.full(k, start, np.int64), np.full(k, width, np.int64)))
        start += width
    if blocks:
        where, seed, most, low, wide = (np.concatenate(x) for x in zip(*blocks, strict=True))
        x, step = np.zeros(len(where)), 0
        while len(where):
            points = int(np.clip(30_000 // len(where), 1, 64))
            draws = textops.mix(seed[:, None] + np.arange(step + 1, step + points + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            # one sum from left to right, however the points are cut into chunks: the last bits of a point are hashed below
            at = np.cumsum(np.concatenate([x[:, None], -np.log(_uniform(draws)) / wide[:, None]], axis=1), axis=1)[:, 1:]
            more = textops.mix(draws ^ np.uint64(0xA0761D6478BD642F))
            # the low half chooses the component, the high half the unit cell of the interval
            component = (more & np.uint64(0xFFFFFFFF)) % np.uint64(components)
            cell = low[:, None] + 1 + ((more >> np.uint64(32)).astype(np.float64) * 2.0**-32 * wide[:, None]).astype(np.int64)
            fits = cell <= most[:, None]
            place = where[:, None] * components + component.astype(np.int64)
            np.minimum.at(least, place[fits], at[fits])
            x, step = at[:, -1], step + points
            go = x < least.reshape(n_texts, components).max(1)[where]
            where, seed, most, low, wide, x = (v[go] for v in (where, seed, most, low, wide, x))
    out = (textops.mix(least.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(n_texts, components)
    out[np.bincount(text, minlength=n_texts) == 0] = 0
    return out


def planes(signature: np.ndarray) -> list[np.ndarray]:
    """The two lowest bits of each of 128 components, as four 64-bit columns: (bit 0, bit 1) of each half."""
    out = []
    for half in (slice(0, 64), slice(64, 128)):
        for bit in (0, 1):
            flags = ((signature[:, half] >> np.uint32(bit)) & 1).astype(np.uint8)
            out.append(np.packbits(flags, axis=1).view(">i8").astype(np.int64).ravel())
    return out


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, words, signature, q0..q3, text): node names the text; words says whether it has any; null texts have no node."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole):
                column = batch.column(1)
                words = textops.words_of(column)
                value = signatures(words.n_texts, *bag(words, words.hashes()))
                nulls = column.is_null().to_pylist()
                data, at = words.data, words.bounds
                nodes = [None if n else hashlib.blake2b(data[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i, n in enumerate(nulls)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(nodes, pa.binary()), pa.array(words.counts > 0), pa.array([x.tobytes() for x in value.astype("<u4")], pa.binary()), *(pa.array(x) for x in planes(value)), column],
                    ["key", "node", "words", "signature", "q0", "q1", "q2", "q3", "text"],
                )

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, node binary, words boolean, signature binary, q0 long, q1 long, q2 long, q3 long, text string")


def similarities(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of rows (a, b, text_a, text_b): the exact weighted Jaccard similarity of the shingle multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text_a", textops.SLICE_BYTES // 2):
                n = batch.num_rows
                sides = []
                for j in (2, 3):
                    words = textops.words_of(batch.column(j))
                    row, shingle, count = bag(words, words.hashes())
                    sides.append((row, textops.mix(shingle) ^ textops.mix(row.astype(np.uint64) + np.uint64(1)), count, np.bincount(row, count, minlength=n)))
                (row, ka, ca, ta), (_, kb, cb, tb) = sides
                _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                both = np.bincount(row[i], np.minimum(ca[i], cb[j]), minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both / np.maximum(ta + tb - both, 1))], ["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def parities(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_texts: int) -> np.ndarray:
    """texts x PARITIES 64-bit words: each bit is the parity of the occurrences that fall on it, so that multisets that differ in d occurrences differ in at most d bits."""
    again = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = textops.mix(np.repeat(shingle, count) + again.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(64 * PARITIES)
    cell, times = np.unique(np.repeat(text, count) * (64 * PARITIES) + place.astype(np.int64), return_counts=True)
    flags = np.zeros(n_texts * 64 * PARITIES, np.uint8)
    flags[cell[times % 2 == 1]] = 1
    return np.packbits(flags.reshape(n_texts, -1), axis=1).view(">i8").astype(np.int64)


def reach(texts: DataFrame) -> DataFrame:
    """(node, n, common, p0, p1, ..) of rows (node, text), one per node: shingles, those of them that another node has too, and parities."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole):
                words = textops.words_of(batch.column(1))
                row, shingle, count = bag(words, words.hashes())
                bits = parities(row, shingle, count, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, count, minlength=batch.num_rows).astype(np.int64)), *(pa.array(x) for x in bits.T.copy())], ["node", "n", *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole):
                words = textops.words_of(batch.column(1))
                row, shingle, count = bag(words, words.hashes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(shingle.view(np.int64)), pa.array(count)], ["node", "shingle", "count"])

    bags = texts.select("node", "text").mapInArrow(run, "node binary, shingle long, count long")
    alone = bags.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes"), F.min(F.struct("node", "count")).alias("x")).filter("nodes = 1")
    own = alone.groupBy("x.node").agg(F.sum("x.count").alias("own"))
    sizes = texts.select("node", "text").mapInArrow(measure, "node binary, n long, " + ", ".join(f"{x} long" for x in SUMS))
    return sizes.join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"), *SUMS)


def possible(a: str, b: str):
    """Whether two texts can be a link: neither bound of their overlap, by shared shingles and by parities, forbids it."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    overlap = F.least(f"{a}.common", f"{b}.common")
    apart = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in SUMS[1:]), F.bit_count(F.col(f"{a}.{SUMS[0]}").bitwiseXOR(F.col(f"{b}.{SUMS[0]}"))))
    # a link's multisets differ in (1 - s) / (1 + s) of all their shingles at most
    return (overlap >= SIMILARITY * (total - overlap)) & (apart <= total * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6)


def different(a: str, b: str):
    """Components whose two low bits differ."""
    x = [F.col(f"{a}.q{i}").bitwiseXOR(F.col(f"{b}.q{i}")) for i in range(4)]
    return F.bit_count(x[0].bitwiseOR(x[1])) + F.bit_count(x[2].bitwiseOR(x[3]))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link: the least node of its component, by label passing and pointer jumping."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(label.withColumnsRenamed({"node": "b", "root": "r"}), "b").select(F.col("a").alias("node"), "r", F.lit(None).cast("binary").alias("old"))
        step = near.union(label.select("node", F.col("root").alias("r"), F.col("root").alias("old"))).groupBy("node").agg(F.min("r").alias("new"), F.max("old").alias("old"))
        jump = label.select(F.col("node").alias("new"), F.col("root").alias("far"))
        fresh = written(step.join(jump, "new").select("node", "old", F.least("new", "far").alias("root")), "labels")
        discard(label)
        label = fresh
        if fresh.filter("root <> old").isEmpty():
            discard(both)
            return fresh.select("node", "root")


def contracted(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) of all nodes in links so far: new links only join the components that there are, each pair of them once."""
    if roots is None:
        return components(links)
    side = roots.withColumnRenamed("node", "n")
    between = links.join(side.withColumnsRenamed({"n": "a", "root": "ra"}), "a", "left").join(side.withColumnsRenamed({"n": "b", "root": "rb"}), "b", "left")
    between = between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    between = written(between, "links-between")
    if between.isEmpty():
        return roots
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("to"))
    fresh = moved.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
    return written(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).union(fresh), "roots")


def _rooted(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _led(members: DataFrame, order, more=None) -> DataFrame:
    """(a, b): each node with the likeliest of its buckets' leaders in other components. A leader is the least node of a bucket and travels with its values."""
    values = [x for x in members.columns if x != "bucket"]
    leaders = members.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), *values)).alias("l")).select("bucket", "l.*")
    pairs = members.alias("o").join(leaders.alias("i"), (F.col("o.bucket") == F.col("i.bucket")) & (F.col("o.root") != F.col("i.root")) & (different("o", "i") <= LIKELY) & (F.lit(True) if more is None else more))
    near = pairs.select(F.col("o.node").alias("a"), F.col("i.node").alias("b"), different("o", "i").alias("d"))
    best = near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x"))
    return best.select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()


def with_texts(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of pairs (a, b) whose nodes have a text in ``held``.

    A text in more than PAIR_SLICE pairs, such as a leader's, is copied once for each slice of about as many of them, so that
    its pairs spread over tasks.
    """
    node = F.explode(F.array("a", "b")).alias("node")
    hot = written(pairs.select(node).groupBy("node").agg(F.ceil(F.count(F.lit(1)) / PAIR_SLICE).cast("int").alias("slices")).filter("slices > 1"), "hot-texts")
    plain = hot.isEmpty()
    texts = held.select("node", "text", F.lit(0).alias("slice")) if plain else held.join(hot, "node", "left").select("node", "text", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"))
    for x, other in ("ab", "ba"):
        if plain:
            pairs = pairs.withColumn(f"slice_{x}", F.lit(0))
            continue
        told = hot.select(F.col("node").alias(x), "slices", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(told, [x, "salt"], "left")
        # hashed with another seed than the salt, so that a salt's pairs spread over all slices
        pairs = salted.withColumn(f"slice_{x}", F.coalesce(F.pmod(F.xxhash64(other, F.lit(1)), "slices").cast("int"), F.lit(0))).drop("salt", "slices")
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(x), F.col("slice").alias(f"slice_{x}"), F.col("text").alias(f"text_{x}")), [x, f"slice_{x}"])
    return pairs.select("a", "b", "text_a", "text_b")


def link_nodes(prints: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(node, root) of all nodes in links, or None. ``prints``: one row per node; ``texts``: (node, text), repeats allowed.

    Rounds against leaders of all buckets, then of the buckets that still hold several components, then all pairs that are
    left. Each round ends in written tables, so that no plan carries the one before.
    """
    bits = ["q0", "q1", "q2", "q3"]
    n_bands, width = COMPONENTS // BAND, 4 * BAND
    banded = prints.select("node", *bits, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda j: F.xxhash64(j, F.substring(F.col("signature"), j * width + 1, F.lit(width))))).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = written(banded.join(shared, "bucket"), "buckets")
    held = written(texts.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "held-texts")
    release(held.sparkSession)
    roots = None

    def check(pairs: DataFrame, name: str) -> None:
        nonlocal roots
        pairs = written(pairs, name)
        links = written(similarities(with_texts(pairs, held)).filter(F.col("similarity") >= SIMILARITY).select("a", "b"), "near-links")
        if not links.isEmpty():
            roots = contracted(links, roots)
        discard(pairs, links)
        release(held.sparkSession)

    for turn in range(ROUNDS):
        check(_led(_rooted(buckets, roots), F.xxhash64("node", F.lit(turn))), "led-pairs")
    # what is left: pairs of a bucket in different components
    members = written(_rooted(buckets, roots), "members")
    discard(buckets)
    mixed = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = written(members.join(mixed, "bucket", "left_semi"), "mixed-buckets")
    discard(members)
    bounds = reach(held.join(open_.select("node").distinct(), "node", "left_semi"))
    # a text whose similarity to any other is below the least has no link here
    left = written(open_.join(bounds.filter(F.col("common") >= SIMILARITY * F.col("n")), "node").drop("root"), "open-buckets")
    discard(open_)
    release(held.sparkSession)
    may = possible("o", "i")
    # variants of one text are nearest to those with least of their own
    own = F.col("common") / F.col("n")
    for order in (own * -1, F.floor(own * -16) * (1 << 30) + F.hash("node")):
        check(_led(_rooted(left, roots), order, may), "led-pairs")
    open_ = written(_rooted(left, roots), "open-buckets")
    discard(left)
    # of each bucket's components the one with most nodes is only compared with the others
    sizes = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("x"), F.count(F.lit(1)).alias("roots"), F.sum("k").alias("all")).filter("roots > 1").select("bucket", F.col("x.root").alias("main"), F.ceil(F.col("all") / BUCKET_SLICE).cast("int").alias("slices"))
    inner = written(open_.join(largest, "bucket"), "rest-buckets")
    discard(open_)
    once = (F.col("i.root") == F.col("i.main")) | (F.col("o.node") < F.col("i.node"))
    # one side of a bucket is dealt to slices, the other meets every slice
    dealt = inner.filter("root <> main").withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    whole = inner.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rest = dealt.alias("o").join(whole.alias("i"), (F.col("o.bucket") == F.col("i.bucket")) & (F.col("o.slice") == F.col("i.slice")) & (F.col("o.root") != F.col("i.root")) & (different("o", "i") <= MOST_DIFFERENT) & may & once)
    check(rest.select(F.least("o.node", "i.node").alias("a"), F.greatest("o.node", "i.node").alias("b")).distinct(), "rest-pairs")
    discard(inner, held)
    return roots


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id, class_size, text_id (hex name of its text; null for a null text)."""
    return _classes(docs, key, text).select(F.col("key").alias(key), "class_id", "class_size", F.lower(F.hex("node")).alias("text_id"))


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, th, root, class_id, class_size): th is a hash of the text that needs no Python."""
    every = written(fingerprints(docs, key, text), "fingerprints")
    usable = every.filter("node IS NOT NULL AND words")
    one = written(usable.groupBy("node").agg(F.min(F.struct("signature", "q0", "q1", "q2", "q3")).alias("s")).select("node", "s.*"), "nodes")
    roots = link_nodes(one, usable.select("node", "text"))
    discard(one)
    rooted = _rooted(every.select("key", "node", F.xxhash64("text").alias("th")), roots)
    sizes = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rooted.join(sizes, "root", "left").select(
        "key", "node", "th", "root", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that with the least key, then the least hash of its text. Rows with null texts all stay.

    Only keys and hashes decide; the texts move once, to meet the decision. A row travels as one struct, so no column of
    ``docs`` can clash with ours.
    """
    found = written(_classes(docs, key, text), "classes")
    named = found.filter("root IS NOT NULL")
    chosen = named.groupBy("root").agg(F.min(F.struct("key", "th")).alias("x"))
    # rows that go are often few: written down, their size is known, so Spark can broadcast them and leave the texts where they are
    gone = named.join(chosen, "root").filter(~(F.col("key").eqNullSafe(F.col("x.key")) & (F.col("th") == F.col("x.th")))).select(F.col("key").alias("gone_key"), F.col("th").alias("gone_th"))
    gone = written(gone.distinct(), "near-copies")
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("th"), body.isNull().alias("none"))
    kept = rows.filter("NOT none").join(gone, F.col("key").eqNullSafe(F.col("gone_key")) & (F.col("th") == F.col("gone_th")), "left_anti")
    if not named.groupBy("key", "th").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["key", "th"])
    return kept.union(rows.filter("none")).select("row.*")
