"""Repeated passages by sparse suffix arrays over words.

Suffixes are kept only at content-selected positions: in each window of WINDOW word positions, the one whose GRAM-word
hash is least (a minimiser). A passage of LEAST_WORDS words or more that two texts share holds such a position at the same
place in both, as WINDOW + GRAM - 1 = LEAST_WORDS. The kept suffixes are sorted by their words across the cluster, and each
is compared with its neighbours in that order; a match is extended to the right and left word by word, up to REACH words,
and counts if the extended match has LEAST_WORDS words. These matches name a passage's partner.

Neighbours alone don't show every passage: a text that shares the gram and what follows, but not what precedes, may stand
between two that share all. So what is repeated is decided by runs of LEAST_WORDS words ("runs" below). Each run has one
minimiser, and a kept position has up to WINDOW neighbouring runs, its block. Blocks of equal words are counted; where all
blocks with a gram are equal, all their runs are repeated and the first holder (least key, name, position) owns them. The
blocks of other grams tell the hash of each run, once for each different block, and those are sorted by range of hash and
holder: a run is repeated if a neighbour has its hash, and the first of equals owns it. An occurrence is later if another
owns the run. Longer passages are the union of such runs.

Equal texts are folded first; a text with copies is one passage from end to end. Only positions whose gram occurs more than
once are sorted. Sorting is by range of the whole suffix with the text's name, so that a passage shared by any number of
texts spreads over tasks; each task hands its first suffix to the task before it.

Defined results: null texts and texts of fewer than LEAST_WORDS words have no passage; copies keep their first text (least
key) as origin; a passage repeated within one text counts too; repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm import textops
from playtrace.shared import discard, release, written

#: Fewest words of a passage; words of a gram; positions of a window; words that a match is extended by on each side.
LEAST_WORDS, GRAM = 50, 25
WINDOW = LEAST_WORDS - GRAM + 1
REACH = LEAST_WORDS - GRAM


def minimisers(words: textops.Words, hashes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word position, gram hash, first window, windows): of each window of ``window`` grams the least, the leftmost of equals; texts apart.

    The windows that choose a position follow each other; the third and fourth column are the first one's word position and their number.
    """
    n = len(hashes)
    last = np.repeat(words.first[1:], words.counts)
    at = np.flatnonzero(np.arange(n) + gram <= last)
    if not len(at):
        return at, np.zeros(0, np.uint64), at, at
    rolled = np.zeros(len(at), np.uint64)
    for j in range(gram):
        rolled += hashes[at + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    rolled = textops.mix(rolled)
    text = words.text[at]
    # least of each window by doubling: a window is covered by two overlapping runs of the largest power of two
    best, size = np.arange(len(at)), 1
    while size * 2 <= window:
        best = _lesser(best[:-size], best[size:], rolled)
        size *= 2
    starts = np.flatnonzero(text[: len(at) - window + 1] == text[window - 1 :]) if len(at) >= window else np.zeros(0, np.int64)
    chosen, begin, times = np.unique(_lesser(best[starts], best[starts + window - size], rolled) if len(starts) else np.zeros(0, np.int64), return_index=True, return_counts=True)
    return at[chosen], rolled[chosen], at[starts[begin]], times


def _word_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums over words, for ``textops.span_hashes``."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(textops.mix(hashes) * textops._power("up", len(hashes)), out=out[1:])
    return out


def _lesser(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.where(value[b] < value[a], b, a)


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h1, h2, text) of all non-null texts; the two hashes name the text."""
    body = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    return body.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")


def _grams(rows: DataFrame) -> DataFrame:
    """(id, h1, h2, n_words, at, gram, low, runs, block) of every kept suffix: its block's first word, runs and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                words = textops.words_of(batch.column(3))
                hashes = words.hashes()
                at, gram, low, runs = minimisers(words, hashes)
                block = textops.span_hashes(_word_sums(hashes), low, low + runs + LEAST_WORDS - 1)
                of = words.text[at]
                ids = [batch.column(j).take(pa.array(of)) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(words.counts[of].astype(np.int32)), pa.array((at - words.first[of]).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array((low - words.first[of]).astype(np.int32)), pa.array(runs.astype(np.int32)), pa.array(block.view(np.int64))], ["id", "h1", "h2", "n_words", "at", "gram", "low", "runs", "block"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, h1 long, h2 long, n_words int, at int, gram long, low int, runs int, block long")


def _runs(rows: DataFrame) -> DataFrame:
    """(run, first, h1, h2, block, place, many) of rows (first, h1, h2, text, blocks): the hash of each run of each listed block (low, runs, block, many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                words = textops.words_of(batch.column(3))
                blocks = batch.column(4)
                of = np.repeat(np.arange(batch.num_rows), np.diff(blocks.offsets.to_numpy()))
                low, runs, block, many = (x.to_numpy(zero_copy_only=False) for x in blocks.flatten().flatten())
                times = np.repeat(np.arange(len(of)), runs)
                place = np.arange(len(times)) - np.repeat(np.cumsum(runs) - runs, runs)
                begin = words.first[of][times] + low[times] + place
                hashed = textops.span_hashes(_word_sums(words.hashes()), begin, begin + LEAST_WORDS)
                ids = [batch.column(j).take(pa.array(of[times])) for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), *ids, pa.array(block[times]), pa.array(place.astype(np.int32)), pa.array(many[times])], ["run", "first", "h1", "h2", "block", "place", "many"])

    kind = rows.schema["first"].dataType.simpleString()
    return rows.select("first", "h1", "h2", "text", "blocks").mapInArrow(run, f"run long, first {kind}, h1 long, h2 long, block long, place int, many boolean")


def _flagged(rows: DataFrame) -> DataFrame:
    """(edge, run, block, bit, again, late, before, after) of sorted runs: again says that a neighbour is equal, late that the one before is.

    ``before`` and ``after`` are the first keys of the equal neighbours. As in ``_neighbours``, the first and last row of
    each partition come once more as edges; their neighbour in another partition is settled on the driver.
    """
    kind = rows.schema["first"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, names = TaskContext.get().partitionId(), None, ["run", "block", "place", "many", "first"]

        def out(table: pa.Table, again, late, before, after, edge: int = 0) -> pa.RecordBatch:
            n = table.num_rows
            columns = [pa.array(np.full(n, edge, np.int32)), table["run"], table["block"], pa.array(np.int64(1) << table["place"].to_numpy().astype(np.int64)), pa.array(again), pa.array(late), before, after, table["first"]]
            columns = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns]
            columns = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns]
            return pa.RecordBatch.from_arrays(columns, FLAGGED)

        def told(table: pa.Table, begin: int, end: int) -> pa.RecordBatch:
            """Flags of rows begin..end of the table, whose other rows are their neighbours."""
            value = table["run"].to_numpy()
            same = value[1:] == value[:-1]
            up, down = np.append(False, same)[begin:end], np.append(same, False)[begin:end]
            at = np.arange(begin, end)
            first = table["first"].combine_chunks()
            before, after = (first.take(pa.array(x, mask=~m)) for x, m in ((at - 1, up), (at + 1, down)))
            part_ = table.slice(begin, end - begin)
            return out(part_, up | down | part_["many"].to_numpy(zero_copy_only=False), up, before, after)

        def edge(row: pa.Table, sign: int) -> pa.RecordBatch:
            none = pa.nulls(1, row.schema.field("first").type)
            return out(row, np.array([False]), np.array([False]), none, none, sign * (part + 1))

        held = None  # the row before the last one that is still to be told, and that one
        for whole in batches:
            if not whole.num_rows:
                continue
            table = pa.Table.from_batches([whole]).select(names)
            if held is None:
                yield edge(table.slice(0, 1), 1)
            else:
                table = pa.concat_tables([held, table])
            skip = 0 if held is None else held.num_rows - 1
            if table.num_rows - 1 > skip:
                yield told(table, skip, table.num_rows - 1)
            held = table.slice(max(0, table.num_rows - 2))
        if held is not None:
            yield told(held, held.num_rows - 1, held.num_rows)
            yield edge(held.slice(held.num_rows - 1), -1)

    return rows.select("run", "first", "block", "place", "many").mapInArrow(run, f"edge int, run long, block long, bit long, again boolean, late boolean, before {kind}, after {kind}, mine {kind}")


FLAGGED = ["edge", "run", "block", "bit", "again", "late", "before", "after", "mine"]


def _spans(rows: DataFrame) -> DataFrame:
    """(h1, h2, later, begin, end, partner) of rows (h1, h2, low, kept, late, partner): maximal spans of the runs whose bits are set."""
    kind = rows.schema["partner"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, kept, late = (batch.column(j).to_numpy() for j in (2, 3, 4))
            for later, bits in ((False, kept & ~late), (True, kept & late)):
                on = ((bits[:, None] >> np.arange(WINDOW)) & 1).astype(np.int8)
                step = np.diff(on, axis=1, prepend=0, append=0)
                (row, begin), (_, end) = np.nonzero(step == 1), np.nonzero(step == -1)
                take = pa.array(row)
                spans = (pa.array((low[row] + x).astype(np.int32)) for x in (begin, end - 1 + LEAST_WORDS))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(row), later)), *spans, batch.column(5).take(take)], ["h1", "h2", "later", "begin", "end", "partner"])

    return rows.select("h1", "h2", "low", "kept", "late", "partner").mapInArrow(run, f"h1 long, h2 long, later boolean, begin int, end int, partner {kind}")


def _contexts(rows: DataFrame) -> DataFrame:
    """(h1, h2, item, suffix, left) of rows (h1, h2, text, items): big-endian word hashes to the right from the position, and to the left, nearest first.

    An item is a position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, "text"):
                words = textops.words_of(batch.column(2))
                short = (words.hashes() >> np.uint64(32)).astype(">u4")
                items = batch.column(3)
                of = np.repeat(np.arange(batch.num_rows), np.diff(items.offsets.to_numpy()))
                item = items.flatten().to_numpy(zero_copy_only=False)
                at = words.first[of] + item
                low, high = np.maximum(words.first[of], at - REACH), np.minimum(words.first[of + 1], at + GRAM + REACH)
                right = [short[a:b].tobytes() for a, b in zip(at, high, strict=True)]
                left = [short[a:b][::-1].tobytes() for a, b in zip(low, at, strict=True)]
                ids = [batch.column(j).take(pa.array(of)) for j in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(item.astype(np.int32)), pa.array(right, pa.binary()), pa.array(left, pa.binary())], ["h1", "h2", "item", "suffix", "left"])

    return rows.select("h1", "h2", "text", "items").mapInArrow(run, "h1 long, h2 long, item int, suffix binary, left binary")


def _common(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Equal leading words of rows of a and b (padded); padding is never equal."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), width, np.argmin(same, axis=1))


def _padded(column: pa.Array, width: int) -> np.ndarray:
    data, at = textops.buffers(column)
    out = np.zeros((len(column), width), np.uint32)
    size = np.diff(at) // 4
    inside = np.arange(width)[None, :] < size[:, None]
    out[inside] = np.frombuffer(data.tobytes(), ">u4").astype(np.uint32) | np.uint32(1)
    return out


COLUMNS = ["h1", "h2", "item", "suffix", "left"]
MATCH = "h1 long, h2 long, at int, begin int, end int, o1 long, o2 long, edge int, item int, suffix binary, left binary"
NAMES = [x.split()[0] for x in MATCH.split(", ")]


def matches(table: pa.Table) -> pa.RecordBatch:
    """Matches of each row of a sorted table of suffixes with the next row, told from both sides."""
    column = [x.combine_chunks() for x in table.select(COLUMNS).columns]
    column = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in column]
    h1, h2, at = (x.to_numpy() for x in column[:3])
    s, t = _padded(column[3], GRAM + REACH), _padded(column[4], REACH)
    ahead, behind = _common(s[:-1], s[1:], GRAM + REACH), _common(t[:-1], t[1:], REACH)
    # a row that comes twice, because its document does, is no match of itself
    apart = (h1[:-1] != h1[1:]) | (h2[:-1] != h2[1:]) | (at[:-1] != at[1:])
    hit = np.flatnonzero(apart & (ahead >= GRAM) & (ahead + behind >= LEAST_WORDS))
    mine, other = np.concatenate([hit, hit + 1]), np.concatenate([hit + 1, hit])
    reach, past = np.tile(ahead[hit], 2), np.tile(behind[hit], 2)
    n = len(mine)
    arrays = [pa.array(x) for x in (h1[mine], h2[mine], at[mine].astype(np.int32), (at[mine] - past).astype(np.int32), (at[mine] + reach).astype(np.int32), h1[other], h2[other], np.zeros(n, np.int32), at[mine].astype(np.int32))]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], NAMES)


def _neighbours(rows: DataFrame) -> DataFrame:
    """Matches of neighbours within each partition of sorted suffixes; and each partition's first and last suffix.

    An edge row has the partition's number plus 1 as ``edge``, negative for the last suffix; a match has 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried = TaskContext.get().partitionId(), None

        def edge(row: pa.Table, sign: int) -> pa.RecordBatch:
            h1, h2, item, suffix, left = (x.combine_chunks() if not isinstance(x.combine_chunks(), pa.ChunkedArray) else x.combine_chunks().chunk(0) for x in row.select(COLUMNS).columns)
            whole = pa.array([0], pa.int32())
            return pa.RecordBatch.from_arrays([h1, h2, whole, whole, whole, h1, h2, pa.array([sign * (part + 1)], pa.int32()), item, suffix, left], NAMES)

        for whole in batches:
            for begin in range(0, whole.num_rows, 20_000):
                table = pa.Table.from_batches([whole.slice(begin, 20_000)])
                if carried is None:
                    yield edge(table.slice(0, 1), 1)
                else:
                    table = pa.concat_tables([carried, table])
                carried = table.slice(table.num_rows - 1, 1)
                if table.num_rows > 1:
                    yield matches(table)
        if carried is not None:
            yield edge(carried, -1)

    return rows.select(*COLUMNS).mapInArrow(run, MATCH)


def _repeated(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, at, low, kept, late, partner) of every kept position with a repeated run: bits of its block's repeated runs, and of those that another place owns."""
    spark = rows.sparkSession
    place = F.struct("first", "h1", "h2", "at")
    blocks = wanted.groupBy("block").agg(F.min(place).alias("own"), F.max("first").alias("other"), F.count(F.lit(1)).alias("n"), *[F.first(x).alias(x) for x in ("gram", "runs")], F.min(F.struct(place.alias("p"), "low")).alias("l"))
    blocks = written(blocks.select("block", "own", "other", F.col("l.low").alias("low"), (F.col("n") > 1).alias("many"), "gram", "runs"), "blocks")
    unlike = blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1").select("gram")
    mixed = blocks.join(unlike, "gram", "left_semi")
    listed = mixed.groupBy(F.col("own.h1").alias("h1"), F.col("own.h2").alias("h2")).agg(F.first("own.first").alias("first"), F.collect_list(F.struct("low", "runs", "block", "many")).alias("blocks"))
    held = rows.join(listed, ["h1", "h2"]).filter(F.col("id").eqNullSafe(F.col("first"))).dropDuplicates(["h1", "h2"])
    runs = written(_runs(held), "runs")
    release(spark)
    # equal runs of one text are in the order of their blocks, which is the same for all
    starts = runs.join(mixed.select("block", "low"), "block").withColumn("start", F.col("low") + F.col("place"))
    ordered = starts.repartitionByRange("run", "first", "h1", "h2", "start").sortWithinPartitions("run", "first", "h1", "h2", "start")
    flagged = written(_flagged(ordered), "flagged-runs")
    discard(runs)
    release(spark)
    told = flagged.filter("edge = 0").select("block", "bit", "again", "late", "before", "after")
    edges = flagged.filter("edge <> 0").select("edge", "run", "block", "bit", "mine").collect()  # two rows per partition
    edges = sorted(edges, key=lambda x: (abs(x["edge"]), -x["edge"]))
    across = []
    for left, right in zip(edges[1::2], edges[2::2]):
        if left["run"] == right["run"]:
            across += [(left["block"], left["bit"], True, False, None, right["mine"]), (right["block"], right["bit"], True, True, left["mine"], None)]
    if across:
        told = told.union(spark.createDataFrame(across, told.schema))
    set_ = lambda flag: F.bit_or(F.when(F.col(flag), F.col("bit")).otherwise(F.lit(0)))
    told = told.groupBy("block").agg(set_("again").alias("kept"), set_("late").alias("late"), F.min(F.coalesce("before", "after")).alias("beside"))
    whole = F.expr("shiftleft(1L, runs) - 1")
    judged = blocks.join(told, "block", "left").select("block", "own", F.when(F.col("many"), whole).otherwise(F.coalesce("kept", F.lit(0))).cast("long").alias("kept"), F.coalesce("late", F.lit(0)).cast("long").alias("owner_late"), "beside", "other")
    judged = judged.filter("kept <> 0")
    mine = (F.col("h1") == F.col("own.h1")) & (F.col("h2") == F.col("own.h2")) & (F.col("at") == F.col("own.at"))
    late = F.when(mine, F.col("owner_late")).otherwise(F.col("kept"))
    partner = F.when(mine, F.coalesce("beside", "other")).otherwise(F.col("own.first"))
    return wanted.join(judged, "block").select("h1", "h2", "at", "low", "kept", late.alias("late"), partner.alias("partner"))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and repeated passage: key, begin, end (words), n_words of the text, partner, later.

    ``partner`` is the least key of those texts (or of a copy) that were found to hold part of the passage, next in order;
    ``later`` says that an earlier place holds each of the passage's runs of LEAST_WORDS words, so that this occurrence may go.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, key, text)
    grams = written(_grams(rows), "grams")
    name = F.xxhash64("h1", "h2", "at")
    shared = grams.groupBy("gram").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).filter("lo <> hi").select("gram")
    nodes = written(rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "texts")
    wanted = grams.join(shared, "gram").groupBy("h1", "h2", "at").agg(F.min("id").alias("first"), *[F.first(x).alias(x) for x in ("gram", "low", "runs", "block")])
    wanted = written(wanted, "repeated-grams")
    discard(grams)
    release(spark)
    listed = wanted.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("at")).alias("items"))
    placed = listed.join(nodes.select("h1", "h2", "first"), ["h1", "h2"])
    held = rows.join(placed, ["h1", "h2"]).filter(F.col("id").eqNullSafe(F.col("first")))
    ordered = _contexts(held).repartitionByRange("suffix", "h1", "h2", "item").sortWithinPartitions("suffix", "left", "h1", "h2", "item")
    found = written(_neighbours(ordered), "matches")
    release(spark)
    inner = found.filter("edge = 0").select(*NAMES[:7])
    edges = found.filter("edge <> 0").select("edge", *COLUMNS).toPandas()  # two rows per partition
    edges["part"] = edges["edge"].abs()
    edges = edges.sort_values(["part", "edge"], ascending=[True, False])
    across = []
    for left, right in zip(edges.iloc[1::2].itertuples(), edges.iloc[2::2].itertuples()):
        pair = pa.table({x: pa.array([getattr(left, x), getattr(right, x)], pa.binary() if x in ("suffix", "left") else pa.int32() if x == "item" else pa.int64()) for x in COLUMNS})
        across += matches(pair).to_pylist()
    if across:
        extra = spark.createDataFrame([tuple(x[n] for n in NAMES[:7]) for x in across], ", ".join(MATCH.split(", ")[:7]))
        inner = inner.union(extra)
    others = nodes.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("partner"))
    met = inner.join(others, ["o1", "o2"]).groupBy("h1", "h2", "at").agg(F.min("partner").alias("near"))
    spans = _spans(_repeated(rows, wanted).join(met, ["h1", "h2", "at"], "left").withColumn("partner", F.coalesce("near", "partner")))
    # overlapping or touching spans of one text become one passage
    line = Window.partitionBy("h1", "h2", "later").orderBy("begin", "end")
    opened = spans.withColumn("fresh", F.coalesce((F.col("begin") > F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    merged = opened.withColumn("island", F.sum("fresh").over(line)).groupBy("h1", "h2", "later", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("partner").alias("partner"))
    names = rows.select("id", "h1", "h2", F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("n_words")).join(nodes, ["h1", "h2"])
    inside = names.join(merged, ["h1", "h2"]).select("id", "begin", "end", "n_words", "partner", (F.col("later") | ~F.col("id").eqNullSafe(F.col("first"))).alias("later"))
    copy = names.filter((F.col("copies") > 1) & (F.col("n_words") >= LEAST_WORDS)).select("id", F.lit(0).alias("begin"), F.col("n_words").alias("end"), "n_words", F.col("first").alias("partner"), (~F.col("id").eqNullSafe(F.col("first"))).alias("later"))
    return inside.union(copy).withColumnRenamed("id", key)


def without_later(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words of later occurrences cut from the text; other columns as they were, no row goes."""
    spans = passages(docs, key, text).filter("later").groupBy(F.col(key).alias("cut_key")).agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for body, spans in zip(texts, cuts, strict=True):
            if body is None or spans is None or not len(spans):
                out.append(body)
                continue
            words = textops.words_of(pa.array([body], pa.string()), hashed=False)
            keep = np.ones(len(words.data), bool)
            for span in spans:
                if span["begin"] < len(words.starts):
                    keep[words.starts[span["begin"]] : words.ends[min(span["end"], len(words.ends)) - 1]] = False
            out.append(words.data[keep].tobytes().decode())
        return pd.Series(out)

    # the row travels as one struct, so that no column of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    joined = rows.join(spans, F.col(f"row.`{key}`").eqNullSafe(F.col("cut_key")), "left")
    return joined.select(*[cut(F.col(f"row.`{x}`").cast("string"), F.col("cuts")).alias(x) if x == text else F.col(f"row.`{x}`").alias(x) for x in docs.columns])
