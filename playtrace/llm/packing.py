"""Packing: all documents' token streams joined end to end and cut into windows of a fixed length.

Two passes. The first tokenizes each document once, where it lies, and writes ids with each document's place in its
partition's stream; the totals of all partitions, one number each, are prefix-summed into global offsets. The second adds
them and cuts at every multiple of the window: one row for each document and window that it touches.

Defined results: a null text is an empty text, which still has its end id; repeated rows are packed as often as they occur;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm import textops
from playtrace.shared import written

#: Length of a window, and the id that ends each document.
WINDOW, END_ID = 1024, 0

_encoders: dict[str, object] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary file.

    The ids are those of the ``tokenizers`` file. Its ranks file gives the same ids several times faster, so that one is
    used where a text has none of the special tokens' strings; other texts go through ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.special = [x.content for x in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> Encoder:
    """One encoder for each worker; names are of the public vocabulary files, which are read where they are installed."""
    if vocabulary not in _encoders:
        import public_tokenizers

        _encoders[vocabulary] = Encoder(public_tokenizers.path(vocabulary), ranks and public_tokenizers.path(ranks), public_tokenizers.PATTERN)
    return _encoders[vocabulary]


def token_stream(docs: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(key, part, place, doc_tokens, ids): each document's ids as little-endian 32-bit values and its place in its partition's stream."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, place = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in textops.slices(whole):
                ids = [np.array([*held.ids(x or ""), end_id], "<u4") for x in batch.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(places), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["key", "part", "place", "doc_tokens", "ids"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, part int, place long, doc_tokens long, ids binary")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (the piece's ids, 4 bytes each).

    Only the last sequence can be shorter than the window. The one table that is gathered holds a row per partition.
    """
    stream = written(token_stream(docs, key, text, vocabulary=vocabulary), "tokens")
    totals = stream.groupBy("part").agg(F.max(F.col("place") + F.col("doc_tokens")).alias("tokens"))
    before = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    begin, end = F.col("base") + F.col("place"), F.col("base") + F.col("place") + F.col("doc_tokens")
    pieces = stream.join(F.broadcast(before), "part").select(
        "*", begin.alias("begin"), end.alias("end"), F.explode(F.sequence((begin / window).cast("long"), ((end - 1) / window).cast("long"))).alias("sequence_id")
    )
    low = F.greatest(F.col("begin"), F.col("sequence_id") * window)
    cut = pieces.withColumn("low", low).withColumn("length", F.least(F.col("end"), (F.col("sequence_id") + 1) * window) - F.col("low"))
    ids = F.substring(F.col("ids"), ((F.col("low") - F.col("begin")) * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return cut.withColumn("ids", ids).select(
        F.col("key").alias(key), (F.col("low") - F.col("begin")).alias("start"), "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", (F.col("low") - F.col("sequence_id") * window).alias("offset"), "ids",
    )
