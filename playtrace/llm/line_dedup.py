"""Line dedup as an exact set-similarity join, with DataFrame operations only.

A line is the set of its words (runs of bytes other than ASCII white space). Two lines match if their Jaccard similarity is
at least NUM / DEN. Equal sets are first folded into one, with the place of its first line. Each set's tokens are ordered
by rarity and only its prefix is indexed: two matching sets share a token of the longer one's prefix and of the first half
or so of the shorter one's. The join on that token keeps pairs that pass the length filter, the positional filter and a
bound from the parity bitmaps of the sets; what remains is verified on the token sets themselves. A line goes if an earlier
line (by key, then line number) matches it.

Where all links are counted, sets that have a candidate are first told from the many that have none, without a row for a
pair, and each of them joins the group of the most frequent set that it matches. Within a group links are counted by what
its sets have other than the group's first; only sets of different groups are paired.

Rarity comes from counts of all words in 2^17 hash buckets, so what the driver gathers and the plan carries has a fixed
size; the result doesn't depend on it, as any order of tokens is exact. Words rarer than a bucket's noise (a 2^17th of all
words) are ordered by hash.

Defined results: null and empty texts have no lines with words; lines without words always stay and match nothing;
repeated rows (same key and text) share one result, so their lines stay or go together; rows of one key with different
texts are told apart by the text's hash; ties don't arise in the order of lines; extra columns are kept by ``deduped``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace import shared
from playtrace.shared import discard

written = partial(shared.written, tidy=True)

#: The least similarity as a fraction.
NUM, DEN = 4, 5
#: Buckets of the rarity counts.
SKETCH_BITS = 17
#: Low bits of a token that hold its hash; the bits above hold its rarity class.
HASH_BITS = 55
SPACE = r"[\x20\x09-\x0D]+"
#: White space that split_words and worded don't expect.
ODD = "\t\x0b\x0c\r"
SET = ["k", "sig"]
#: Rarity classes, even steps of the logarithm of counts.
CLASSES = 64
#: Words from which a line is long: shorter ones don't fill a bitmap.
LONG = 64
#: Lengths of one band differ by less than this factor, which is over DEN / NUM, so that sets that match lie in one band or in neighbouring ones.
BAND = 1.26
#: Tokens of buckets with over so many words are dealt to bands; others have few sets to meet.
FULL = 2048
#: A hot token is in the prefixes of more sets than HOT and than one set in HOT_SHARE, or of more than MOST_HOT whatever the table's size.
HOT, HOT_SHARE, MOST_HOT = 128, 256, 8192
#: Sets of a hot token are compared in chunks of about CHUNK; tokens of over CHUNKS chunks have larger ones, up to MOST_CHUNK.
CHUNK, CHUNKS, MOST_CHUNK = 128, 16, 1024


def rarity(docs: DataFrame, text: str) -> tuple[Column, float]:
    """An array with a class under CLASSES for each bucket of words, growing with the number of its words in all documents; and the logarithm of class CLASSES.

    The array is one constant of 2^SKETCH_BITS small numbers, whatever the table's size; classes are even steps of the
    logarithm, up to the fullest bucket's.
    """
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("body"))
    words = lines.select(F.explode(split_words(F.col("body"))).alias("w")).filter("w <> ''").select(F.xxhash64("w").bitwiseAND((1 << SKETCH_BITS) - 1).alias("bucket"))
    counts = written(words.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "word-buckets")
    most = counts.agg(F.log2(F.max("n") + 2).alias("most"))  # one row
    classes = counts.crossJoin(most).select("bucket", F.floor(CLASSES * F.log2(F.col("n") + 1) / F.col("most")).alias("class"))
    every = spark.range(1 << SKETCH_BITS).withColumnRenamed("id", "bucket").join(classes, "bucket", "left").select("bucket", F.coalesce("class", F.lit(0)).alias("class"))
    top = most.first()["most"] or 1.0
    listed = every.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "class"))), lambda x: x["class"].cast("string")), ",").alias("classes")).first()
    discard(counts)
    return F.split(F.lit(listed["classes"]), ",").cast("array<bigint>"), top


def split_words(line: Column) -> Column:
    """A line's words, and empty strings between some. Most lines have no white space but blanks, which are found without a regular expression."""
    odd = reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in f"\n{ODD}"])
    return F.when(odd, F.split(line, SPACE)).otherwise(F.split(line, " "))


def worded(text: Column) -> Column:
    """The number of lines with a word. Where no line begins with white space, they are the lines that aren't empty."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in [*ODD, "\n "]]) | F.startswith(text, F.lit(" "))
    return F.when(odd, F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*"))).otherwise(F.size(F.array_remove(F.split(text, "\n"), "")))


def hashes(line: Column) -> Column:
    """The set of a line's words, as 64-bit hashes."""
    return F.array_remove(F.array_distinct(F.transform(split_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def token(h: Column, classes: Column) -> Column:
    """Rarity class above, hash below, in one long, of a word's hash."""
    # never null, as the class of every bucket is known; an array that may hold nulls is sorted and searched as objects
    level = F.coalesce(F.get(classes, h.bitwiseAND((1 << SKETCH_BITS) - 1).cast("int")), F.lit(0).cast("long"))
    return F.shiftleft(level, HASH_BITS).bitwiseOR(h.bitwiseAND((1 << HASH_BITS) - 1))


def tokens(line: Column, classes: Column) -> Column:
    """The sorted distinct tokens of a line's words, the rarest first."""
    return F.sort_array(F.transform(hashes(line), lambda h: token(h, classes)))


def parity(items: Column, one) -> Column:
    """64 bits, each the parity of the tokens that fall on it by their low bits; sets that differ in d tokens differ in at most d bits."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one(x), x.bitwiseAND(63).cast("int"))))


def bitmaps(items: Column) -> list[Column]:
    """One bitmap of all tokens; for long lines, which fill it, one more of the tokens without bit 6. The two differ in that of the tokens with bit 6."""
    half = F.when(F.size(items) >= LONG, parity(items, lambda x: (x.bitwiseAND(64) == 0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return [parity(items, lambda x: F.lit(1).cast("long")).alias("sig"), half.alias("sig1")]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, text): the key and the text's hash identify a row."""
    body = F.col(text).cast("string")
    return docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("th"), body.alias("text"))


def sets(rows: DataFrame, classes: Column, ends: bool) -> DataFrame:
    """One row per distinct set of words of a line: k, sig, n, the other bitmaps, prefix, lines, first (id, th, line); with ``ends`` its least and greatest hash."""
    # a filter on the tokens themselves would be moved below them and compute them anew
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line", "body")).filter(F.ltrim("body", F.lit(f" \n{ODD}")) != "")
    # used more than once, so the optimizer keeps the tokens in a projection of their own, which is generated code but for the functions of each word
    lines = lines.select("id", "th", "line", tokens(F.col("body"), classes).alias("items"))
    n = F.size("items")
    # the low bits of a token are the word's hash
    low = F.transform("items", lambda x: x.bitwiseAND((1 << HASH_BITS) - 1))
    more = {"lo": F.array_min(low), "hi": F.array_max(low)} if ends else {}
    measured = lines.select(
        "id", "th", "line", *[x.alias(name) for name, x in more.items()], F.xxhash64("items").alias("k"), *bitmaps(F.col("items")), n.alias("n"),
        F.slice("items", F.lit(1), n - F.floor((n * NUM + DEN - 1) / DEN).cast("int") + 1).alias("prefix"),
    )
    return measured.groupBy(*SET).agg(*[F.min(x).alias(x) for x in ("n", "sig1", *more)], F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("lines"), F.min(F.struct("id", "th", "line")).alias("first"))


def postings(found: DataFrame, *more: str) -> DataFrame:
    """(token, at, k, sig, sig1, n, more): the prefix of each set that can match another; one of under DEN - 1 words can't."""
    return found.filter(F.col("n") >= DEN - 1).select(*SET, "sig1", "n", *more, F.posexplode("prefix").alias("at", "token"))


def leads(n: Column, at: Column) -> Column:
    """Whether a token at this place can be the first that a set shares with a longer one: with na <= nb at most na / 9 tokens of a are outside b."""
    return (at + 1) * (NUM + DEN) <= n * (DEN - NUM) + NUM + DEN


def rarest(least: int, most: float) -> int:
    """The least token of the class of buckets with ``least`` words."""
    return min(CLASSES - 1, int(CLASSES * math.log2(least + 1) / most)) << HASH_BITS


def banded(index: DataFrame, most: float) -> DataFrame:
    """``index`` with a key in place of its tokens: that, and for tokens of full buckets a band of lengths too.

    A posting lies in its set's band, and low in the next one if it can lead there, so that few sets of other lengths meet.
    """
    band = F.floor(F.log(F.col("n")) / math.log(BAND)).cast("int")
    keys = [F.xxhash64("token", x) for x in (band, band + 1)]
    full = F.col("token") >= rarest(FULL, most)
    places = F.when(full & leads(F.col("n"), F.col("at")), F.array(*keys)).otherwise(F.array(F.when(full, keys[0]).otherwise(F.col("token"))))
    return index.select("*", F.posexplode(places).alias("low", "key")).drop("token")


def sharing(index: DataFrame) -> tuple[Column, Column]:
    """For postings a and b of one index: whether they share a token, and what filters that don't ask for an order say."""
    na, nb, ia, ib = F.col("a.n"), F.col("b.n"), F.col("a.at"), F.col("b.at")
    reach = F.least(ia, ib) + F.least(na - ia, nb - ib) >= need(na, nb)
    # the test that most pairs fail stands first
    alike = F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))) * (NUM + DEN) <= (na + nb) * (DEN - NUM)
    key = "key" if "key" in index.columns else "token"
    return F.col(f"a.{key}") == F.col(f"b.{key}"), alike & near(side("a"), side("b")) & reach


def shorter() -> Column:
    """Whether a is the shorter set, or the lesser of two of one length."""
    na, nb = F.col("a.n"), F.col("b.n")
    return (na < nb) | ((na == nb) & ((F.col("a.k") < F.col("b.k")) | ((F.col("a.k") == F.col("b.k")) & (F.col("a.sig") < F.col("b.sig")))))


def paired(index: DataFrame) -> DataFrame:
    """(k, sig) of the sets of a banded ``index`` that are in a pair of ``candidates``. A set's search ends with the first, and no row is made for a pair."""
    a, b = index.alias("a"), index.alias("b")
    same, passed = sharing(index)
    other = (F.col("a.k") != F.col("b.k")) | (F.col("a.sig") != F.col("b.sig"))
    ordered = F.when(shorter(), leads(F.col("a.n"), F.col("a.at")) & (F.col("b.low") == 0)).otherwise(leads(F.col("b.n"), F.col("b.at")) & (F.col("a.low") == 0))
    return a.join(b, same & passed & other & ordered, "left_semi").select(*SET).distinct()


def candidates(index: DataFrame, left_out: Column | None = None) -> DataFrame:
    """Pairs of sets (a the shorter one) that share a token of ``index`` and pass all filters."""
    a, b = index.alias("a"), index.alias("b")
    same, passed = sharing(index)
    # one condition on both sides, so that both are read from one shuffle
    ordered = F.when(leads(F.col("a.n"), F.col("a.at")), shorter() & (F.col("b.low") == 0) if "low" in index.columns else shorter())
    if "cell" in index.columns:
        # two sets of one chunk meet in all cells of it, and count in that of the chunk with itself
        same = same & (F.col("a.cell") == F.col("b.cell")) & ((F.col("a.chunk") != F.col("b.chunk")) | (F.col("a.cell.lo") == F.col("a.cell.hi")))
    pairs = a.join(b, same & passed & ordered & (F.lit(True) if left_out is None else ~left_out))
    return pairs.select(*[F.col(f"{s}.{x}").alias(f"{s}_{x}") for s in "ab" for x in SET]).distinct()


def frequent(posts: DataFrame, least: int, most: float) -> DataFrame:
    """The postings of tokens that can have over ``least``: a bucket of words has at least as many as its token has sets, so tokens of rarer classes can't."""
    return posts.filter(F.col("token") >= rarest(least, most))


def hot_tokens(posts: DataFrame, least: int) -> DataFrame:
    """(token, sets) of tokens with over ``least`` postings."""
    return posts.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > least)


def celled(index: DataFrame, hot: DataFrame) -> DataFrame:
    """``index`` with a chunk and a cell: the sets of a hot token are dealt to chunks of about MOST_HOT, and each is in a cell for every chunk that it is compared with."""
    chunks = F.coalesce(F.ceil(F.col("sets") / MOST_HOT), F.lit(1)).cast("int")
    dealt = index.join(hot, "token", "left").withColumn("chunk", F.pmod(F.xxhash64(*SET), chunks).cast("int")).withColumn("o_chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.withColumn("cell", F.struct(F.least("chunk", "o_chunk").alias("lo"), F.greatest("chunk", "o_chunk").alias("hi"))).drop("sets", "o_chunk")


def need(na: Column, nb: Column) -> Column:
    """The least overlap of matching sets: (na + nb) * NUM / (NUM + DEN), in whole numbers."""
    return F.floor(((na + nb) * NUM + NUM + DEN - 1) / (NUM + DEN))


def side(name: str) -> Callable[[str], Column]:
    """The columns of one side of a join by name."""
    return lambda x: F.col(f"{name}.{x}")


def near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether lengths and bitmaps allow a match; ``a`` and ``b`` give a side's values by name."""
    na, nb = a("n"), b("n")
    most = na + nb - 2 * need(na, nb)
    whole, half = (a(x).bitwiseXOR(b(x)) for x in ("sig", "sig1"))
    # the halves of a long and a short line tell nothing
    return (na * NUM <= nb * DEN) & (nb * NUM <= na * DEN) & (F.bit_count(whole) <= most) & ((F.least(na, nb) < LONG) | (F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half)) <= most))


def first_candidates(found: DataFrame) -> DataFrame:
    """Each set (a) with the earliest and the most frequent set (b) of those with the same least or greatest hash, if it is earlier and can match: four pairs a set at most."""
    blocks = found.select(*SET, "sig1", "n", "lines", F.col("first").alias("place"), F.explode(F.array("lo", "hi")).alias("block"))
    leader = F.struct("place", *SET, "sig1", "n")
    leaders = F.array(F.min(leader), F.min(F.struct(-F.col("lines"), leader.alias("l")))["l"])
    first = blocks.groupBy("block").agg(leaders.alias("f")).select("block", F.explode(F.array_distinct("f")).alias("f")).select("block", "f.*")
    pairs = blocks.alias("a").join(first.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("b.place") < F.col("a.place")) & near(side("a"), side("b")))
    return pairs.select(*[F.col(f"{s}.{x}").alias(f"{s}_{x}") for s in "ab" for x in SET]).distinct()


def items_of(wanted: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """(k, sig, place, items) of the wanted sets: their first lines and those lines' hashed words."""
    places = found.join(wanted, SET, "left_semi").groupBy(F.col("first.id").alias("id"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), *SET)).alias("wanted"))
    once = rows.join(places, rows["id"].eqNullSafe(places["id"]) & (rows["th"] == places["th"])).select(rows["id"], rows["th"], F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    place = F.struct("id", "th", F.col("w.line").alias("line")).alias("place")
    items = once.select(*[F.col(f"w.{x}") for x in SET], place, hashes(F.element_at("lines", F.col("w.line") + 1)).alias("items"))
    # repeated rows would each give the same sets again
    return written(items.dropDuplicates(SET), "line-items")


def ends(pairs: DataFrame) -> DataFrame:
    """(k, sig) of both sides of pairs."""
    return pairs.select(F.explode(F.array(*[F.struct(*[F.col(f"{s}_{x}").alias(x) for x in SET]) for s in "ab"])).alias("s")).select("s.*")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose sets match, with both first places; those of two sets with a hot token in common, which ``tallied`` compares, are left out."""
    hots = "hots" in held.columns
    for s in "ab":
        known = held.select(*[F.col(x).alias(f"{s}_{x}") for x in SET], *[F.col(x).alias(f"{s}_{x}") for x in ("place", "items")], *([F.col("hots").alias(f"{s}_hots")] if hots else []))
        pairs = pairs.join(known, [f"{s}_{x}" for x in SET])
    if hots:
        pairs = pairs.filter(~F.coalesce(F.arrays_overlap("a_hots", "b_hots"), F.lit(False)))
    return pairs.filter(matches(F.col("a_items"), F.col("b_items"))).select(*[f"{s}_{x}" for s in "ab" for x in [*SET, "place"]])


def matches(a: Column, b: Column) -> Column:
    """Whether the Jaccard similarity of two sets is NUM / DEN or more."""
    return F.size(F.array_intersect(a, b)) * (NUM + DEN) >= (F.size(a) + F.size(b)) * NUM


def told_ends(links: DataFrame) -> DataFrame:
    """(k, sig, earliest, links) of linked pairs, at most one row for each end as either side: counted where the links lie, so no link is copied or joined."""
    sides = [
        links.groupBy(*[F.col(f"{mine}_{x}").alias(x) for x in SET]).agg(F.min(f"{other}_place").alias("earliest"), F.count(F.lit(1)).alias("links"))
        for mine, other in ("ab", "ba")
    ]
    return sides[0].union(sides[1])


def ended(told: DataFrame) -> DataFrame:
    """(k, sig, earliest, links): of each set the first place that matches it, and the number of its links."""
    return told.groupBy(*SET).agg(F.min("earliest").alias("earliest"), F.sum("links").alias("links"))


def tallied(sizes: DataFrame, members: DataFrame, carried: list[str], hit: Callable[[Column, Column], Column]) -> DataFrame:
    """(k, sig, earliest, links) of the links within each block of sets; ``hit`` says whether two different sets of a block match and count in it.

    ``sizes`` has (block, sets); ``members`` (block, k, sig, first) and the ``carried`` columns, which ``hit`` reads. The sets
    of a block are dealt to chunks by their hash, and each pair of chunks is one row, in which every set of one chunk is
    compared with every set of the other: links are counted there, and no row is made for a pair. The pairs of chunks are
    numbered before any set joins them, so that those of one block spread over tasks.
    """
    size = F.least(F.greatest(F.col("sets") / CHUNKS, F.lit(CHUNK)), F.lit(MOST_CHUNK))
    chunks = F.ceil(F.col("sets") / size).cast("int")
    dealt = members.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64(*SET), chunks).cast("int"))
    sides = dealt.groupBy("block", "chunk").agg(F.collect_list(F.struct("block", *SET, "first", *carried)).alias("side"))
    sides = written(sides, "line-chunks")
    other = sides.select("block", F.col("chunk").alias("o_chunk"), F.col("side").alias("o_side"))
    numbered = sizes.select("block", chunks.alias("chunks")).select("block", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    numbered = numbered.repartition(F.col("block"), F.col("chunk")).select("block", "chunk", F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("o_chunk"))
    pairs = numbered.repartition(F.col("block"), F.col("chunk"), F.col("o_chunk")).join(sides, ["block", "chunk"]).join(other, ["block", "o_chunk"])

    def against(mine: Column, theirs: Column) -> Column:
        def one(a: Column) -> Column:
            hits = F.filter(theirs, lambda b: hit(a, b) & ((a["k"] != b["k"]) | (a["sig"] != b["sig"])))
            return F.struct(a["k"].alias("k"), a["sig"].alias("sig"), F.array_min(F.transform(hits, lambda b: b["first"])).alias("earliest"), F.size(hits).cast("long").alias("links"))

        return F.filter(F.transform(mine, one), lambda x: x["links"] > 0)

    told = F.concat(against(F.col("side"), F.col("o_side")), F.when(F.col("chunk") < F.col("o_chunk"), against(F.col("o_side"), F.col("side"))).otherwise(F.array()))
    return pairs.select(F.explode(told).alias("t")).select("t.*")


def hot_hit(a: Column, b: Column) -> Column:
    """Whether two sets of different groups match and count at this hot token, the least that both have; the cheap tests stand first."""
    same = a["least"] == b["least"]
    here = same | (F.array_min(F.array_intersect(a["hots"], b["hots"])) == a["block"])
    alike = F.bit_count(a["sig"].bitwiseXOR(b["sig"])) * (NUM + DEN) <= (a["n"] + b["n"]) * (DEN - NUM)
    apart = (a["g_k"] != b["g_k"]) | (a["g_sig"] != b["g_sig"])
    return (~same | (a["least"] == a["block"])) & (a["n"] * NUM <= b["n"] * DEN) & (b["n"] * NUM <= a["n"] * DEN) & alike & apart & here & matches(a["items"], b["items"])


def group_hit(a: Column, b: Column) -> Column:
    """Whether two sets of a group match. They differ in size(a.diff) + size(b.diff) - 2 * common words, at most (na + nb) / 9 if they match; ``over`` is by how much a set's part exceeds its share."""
    over, most = a["over"] + b["over"], 2 * (NUM + DEN)
    return (over <= 0) | ((F.least(F.size(a["diff"]), F.size(b["diff"])) * most >= over) & (F.size(F.array_intersect(a["diff"], b["diff"])) * most >= over))


def chosen(index: DataFrame) -> DataFrame:
    """(k, sig, g_k, g_sig): for each set the most frequent of the sets that stand first by frequency among those with one of its tokens, if it can match."""
    first = index.groupBy("token").agg(F.max(F.struct("lines", *SET, "sig1", "n")).alias("f")).select("token", "f.*")
    pairs = index.alias("a").join(first.alias("b"), (F.col("a.token") == F.col("b.token")) & near(side("a"), side("b")))
    best = pairs.groupBy(*[F.col(f"a.{x}").alias(x) for x in SET]).agg(F.max(F.struct(*[F.col(f"b.{x}") for x in ("lines", *SET)])).alias("g"))
    return best.select(*SET, *[F.col(f"g.{x}").alias(f"g_{x}") for x in SET])


def grouped(some: DataFrame, held: DataFrame) -> DataFrame:
    """``held`` with n, first, group (g_k, g_sig), diff and over: a set joins the group of the set that is ``chosen`` for it if the two match, and is alone in its own otherwise."""
    picked = chosen(postings(some, "lines"))
    of = held.select(*[F.col(x).alias(f"g_{x}") for x in SET], F.col("items").alias("g_items"))
    mine = some.select(*SET, "n", "first").join(held.drop("place"), SET).join(picked, SET, "left").join(of, [f"g_{x}" for x in SET], "left")
    fits = F.coalesce(matches(F.col("items"), F.col("g_items")), F.lit(False))
    diff = F.when(fits, F.concat(F.array_except("items", "g_items"), F.array_except("g_items", "items"))).otherwise(F.array().cast("array<bigint>"))
    told = mine.select(*SET, "n", "first", "items", *[F.when(fits, F.col(f"g_{x}")).otherwise(F.col(x)).alias(f"g_{x}") for x in SET], diff.alias("diff"))
    return written(told.withColumn("over", F.size("diff") * (NUM + DEN) - F.col("n") * (DEN - NUM)), "line-groups")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", every: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sets, ends): every distinct line set with its first place; of those with links the earliest match and the number of links.

    All links with ``every``; otherwise as many as tell which sets have an earlier match: each set is first compared with
    the earliest and the most frequent of those with its least or greatest hash, and two sets that both have an earlier match are left unpaired.
    The sets of a token in over MOST_HOT prefixes are then joined by cells, so that no task has more than a cell's pairs.
    """
    rows = keyed(docs, key, text)
    classes, most = rarity(rows, "text")
    found = written(sets(rows, classes, not every), "line-sets")
    if every:
        return found, every_link(found, rows, most)

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "line-pairs")
        held = items_of(ends(pairs).distinct(), found, rows)
        links = written(verified(pairs, held), "line-links")
        discard(pairs, held)
        return links

    links = checked(first_candidates(found))
    done = written(links.select(F.col("a_k").alias("k"), F.col("a_sig").alias("sig"), F.lit(True).alias("closed")).distinct(), "line-matched")
    index = postings(found.join(done, SET, "left").withColumn("closed", F.coalesce("closed", F.lit(False))), "closed")
    hot = written(hot_tokens(frequent(index, MOST_HOT, most), MOST_HOT), "hot-tokens")
    index = index if hot.isEmpty() else celled(index, hot)
    return found, ended(told_ends(links.union(checked(candidates(index, F.col("a.closed") & F.col("b.closed"))))))


def every_link(found: DataFrame, rows: DataFrame, most: float) -> DataFrame:
    """(k, sig, earliest, links) over all links: those within a group and those at a hot token in blocks, others by a join. ``most`` is as from ``rarity``.

    A token is hot that is in the prefixes of over HOT sets and of one set in HOT_SHARE, so that few tokens of a small table
    are; the bound never exceeds MOST_HOT, so that no token of a large one has more than MOST_HOT^2 / 2 pairs in a task.
    """
    posts = postings(found)
    least = min(MOST_HOT, max(HOT, found.count() // HOT_SHARE))
    often = frequent(posts, least, most)
    hot = written(hot_tokens(often, least), "hot-tokens")
    marked = written(often.join(hot.select("token"), "token").groupBy(*SET).agg(F.sort_array(F.collect_list("token")).alias("hots")), "hot-sets")
    linkable = written(paired(banded(posts.join(hot.select("token"), "token", "left_anti"), most)).union(marked.select(*SET)).distinct(), "line-linkable")
    some = written(found.join(linkable, SET, "left_semi"), "line-some")
    held = items_of(linkable, some, rows)
    members = grouped(some, held)
    groups = members.select(*SET, "first", "diff", "over", F.struct("g_k", "g_sig").alias("block"))
    sizes = written(groups.groupBy("block").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"), "line-group-sizes")
    inside = written(tallied(sizes, groups, ["diff", "over"], group_hit), "line-group-links")

    index = postings(some.join(members.select(*SET, "g_k", "g_sig"), SET), "g_k", "g_sig").join(hot.select("token"), "token", "left_anti")
    pairs = written(candidates(banded(index, most), (F.col("a.g_k") == F.col("b.g_k")) & (F.col("a.g_sig") == F.col("b.g_sig"))), "line-pairs")
    links = written(verified(pairs, held.join(marked, SET, "left")), "line-links")
    out = told_ends(links).unionByName(inside)
    if not hot.isEmpty():
        named = members.join(marked, SET).join(found.select(*SET, "sig1"), SET).withColumn("block", F.explode("hots")).withColumn("least", F.get("hots", F.lit(0)))
        blocks = hot.withColumnRenamed("token", "block")
        out = out.unionByName(written(tallied(blocks, named, ["n", "items", "hots", "least", "g_k", "g_sig"], hot_hit), "hot-links"))
    told = written(ended(out), "line-ends")
    discard(hot, marked, linkable, some, held, members, sizes, inside, pairs, links)
    return told


def kept_lines(found: DataFrame, linked_ends: DataFrame) -> DataFrame:
    """(id, th, kept, n_links): for each document the lines that stay because they come first, and links of its first lines."""
    judged = found.select(*SET, F.col("first").alias("place")).join(linked_ends, SET, "left")
    stays = F.col("earliest").isNull() | (F.col("place") < F.col("earliest"))
    return judged.groupBy(F.col("place.id").alias("id"), F.col("place.th").alias("th")).agg(
        F.sort_array(F.collect_list(F.when(stays, F.col("place.line")))).alias("kept"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links")
    )


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_lines (with a word), n_removed, n_links, kept (line numbers, from 0)."""
    marks = kept_lines(*linked(docs, key, text))
    body = F.col(text).cast("string")
    counted = docs.select(F.col(key).alias(key), F.xxhash64(body).alias("th"), F.when(body.isNull(), 0).otherwise(worded(body)).alias("n_lines"))
    out = counted.alias("d").join(marks.alias("m"), F.col(f"d.{key}").eqNullSafe(F.col("m.id")) & (F.col("d.th") == F.col("m.th")), "left")
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    return out.select(F.col(f"d.{key}").alias(key), "n_lines", (F.col("n_lines") - F.size(kept)).alias("n_removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"))


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut from the text, all other columns as they were; no row goes."""
    marks = kept_lines(*linked(docs, key, text, every=False))
    body = F.col(f"d.{text}").cast("string")
    kept = F.coalesce(F.col("m.kept"), F.array().cast("array<int>"))
    stays = F.filter(F.split(body, "\n"), lambda x, i: F.array_contains(kept, i) | ~x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.alias("d").join(marks.alias("m"), F.col(f"d.{key}").eqNullSafe(F.col("m.id")) & (F.xxhash64(body) == F.col("m.th")), "left")
    return out.select(*[F.array_join(stays, "\n").alias(x) if x == text else F.col(f"d.`{x}`").alias(x) for x in docs.columns])


#: The same join in SQL: exact word counts order the tokens, so only the candidates differ, not the result.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line, unnest(parts) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
), sets AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))) AS items FROM lines
), folded AS (
  SELECT items, len(items) AS n, min({'doc_id': doc_id, 'line': line}) AS place FROM sets WHERE len(items) > 0 GROUP BY items
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY place) AS id FROM folded
), words AS (
  SELECT id, n, unnest(items) AS w FROM numbered
), ranked AS (
  SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS rank FROM words JOIN (SELECT w, count(*) AS df FROM words GROUP BY w) USING (w)
), prefixes AS (
  SELECT * FROM ranked WHERE rank <= n - (n * 4 + 4) // 5 + 1
), pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefixes a JOIN prefixes b ON a.w = b.w AND a.id < b.id AND a.n * 4 <= b.n * 5 AND b.n * 4 <= a.n * 5
), links AS (
  SELECT a, b FROM pairs JOIN numbered x ON x.id = a JOIN numbered y ON y.id = b WHERE len(list_intersect(x.items, y.items)) * 9 >= (x.n + y.n) * 4
), ends AS (
  SELECT id, count(*) AS links, min(other) AS first_other FROM (SELECT a AS id, b AS other FROM links UNION ALL SELECT b, a FROM links) GROUP BY id
), judged AS (
  SELECT place.doc_id AS doc_id, place.line AS line, coalesce(links, 0) AS links, first_other IS NULL OR n.id < first_other AS stays FROM numbered n LEFT JOIN ends e ON n.id = e.id
), marks AS (
  SELECT doc_id, list(CAST(line AS INTEGER) ORDER BY line) FILTER (stays) AS kept, sum(links) AS n_links FROM judged GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) FILTER (len(items) > 0) AS n_lines FROM sets GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_lines, 0) - len(coalesce(kept, [])) AS INTEGER) AS n_removed,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(kept, []) AS kept
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN marks m USING (doc_id)
"""
