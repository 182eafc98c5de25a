"""Byte-level BPE: whole texts to ids by a local rank file, and ids back to bytes.

The ids are those of the ``tiktoken`` library. Texts longer than ``PIECE`` characters are cut before they reach it, at places
where the vocabulary's split pattern ends a match whatever stands around them: before white space after other text, before
the last of several white-space characters, and between ASCII or common CJK letters, digits and marks (never after an
apostrophe, which may begin a contraction). So the matches, and with them the ids, are those of the whole text, while the
library sees a bounded piece. A long run of white space, on which the library's regular expressions overflow, is one match
and goes straight to the merges; so does every run without a safe place, whose merges the library does in n log n.

Defined results: a null text is an empty text and has no ids; repeated rows are encoded each; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm import textops

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a piece, and of a run of white space that is taken as one match.
PIECE, RUN = 1 << 16, 1 << 12

_MARK = r"!-/:-@\[-`{-~"
_CJK, _CJK_MARK = r"一-龥ぁ-ゔァ-ヺ", r"、。！？"
#: Two or three characters; the place after the first is safe.
SAFE = regex.compile(
    rf"\P{{White_Space}}\p{{White_Space}}|\p{{White_Space}}{{2}}\P{{White_Space}}|[A-Za-z{_CJK}][0-9{_MARK}{_CJK_MARK}]|[0-9][A-Za-z{_MARK}]|[!-&(-/:-@\[-`{{-~][A-Za-z0-9{_CJK}]|[{_CJK_MARK}][A-Za-z0-9{_CJK}]"
)
_RUNS: dict[int, regex.Pattern] = {}


def pieces(text: str, piece: int = PIECE, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is one match) in order; joined they are the text."""
    runs = _RUNS.setdefault(run, regex.compile(rf"\p{{White_Space}}{{{max(run, 2)},}}"))
    begin = 0
    for m in runs.finditer(text):
        # the last white space before other text starts the next match
        stop = m.end() - (m.end() < len(text))
        yield from _cut(text, begin, m.start(), piece)
        yield text[m.start() : stop], True
        begin = stop
    yield from _cut(text, begin, len(text), piece)


def _cut(text: str, begin: int, end: int, piece: int) -> Iterator[tuple[str, bool]]:
    while end - begin > piece:
        m = SAFE.search(text, begin + piece - 1, end)
        if not m:
            break
        yield text[begin : m.start() + 1], False
        begin = m.start() + 1
    if begin < end:
        yield text[begin:end], False


class Codec:
    """The library's encoding from a rank file: a line per token, its bytes in base 64 and its rank."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str, piece: int = PIECE, run: int = RUN) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if len(text) <= min(piece, run):
            return np.array(self.encoding.encode_ordinary(text), "<u4")
        parts = [np.array(self.encoding._core_bpe.encode_single_piece(x.encode()) if single else self.encoding.encode_ordinary(x), "<u4") for x, single in pieces(text, piece, run)]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def decode(self, ids: np.ndarray, at_once: int = 1 << 16) -> bytes:
        """The bytes of all ids, which need not be whole characters."""
        return b"".join(self.encoding.decode_bytes(ids[i : i + at_once].tolist()) for i in range(0, len(ids), at_once))


_codecs: dict[tuple[str, str | None], Codec] = {}


def codec(ranks: str = RANKS, pattern: str | None = None) -> Codec:
    """One codec for each worker; ``ranks`` names a public vocabulary file, read where it is installed, or is a path."""
    if (ranks, pattern) not in _codecs:
        import public_tokenizers

        _codecs[ranks, pattern] = Codec(ranks if "/" in ranks else public_tokenizers.path(ranks), pattern or public_tokenizers.PATTERN)
    return _codecs[ranks, pattern]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, back: bool = False) -> DataFrame:
    """(key, n_tokens, ids) of each row, ids as little-endian 32-bit values; with ``back`` also ``decoded``, the bytes that these ids stand for."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = codec(ranks)
        for whole in batches:
            for batch in textops.slices(whole):
                ids = [held.encode(x or "") for x in batch.column(1).to_pylist()]
                columns = {"key": batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
                if back:
                    stored = columns["ids"].to_pylist()
                    columns["decoded"] = pa.array([held.decode(np.frombuffer(x, "<u4")) for x in stored], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long, ids binary" + ", decoded binary" * back).withColumnRenamed("key", key)


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """(key, bytes) of rows of ids as ``encoded`` writes them; null ids give no bytes."""
    source = rows.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = codec(ranks)
        for whole in batches:
            for batch in textops.slices(whole, "ids"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()], pa.binary())], ["key", "bytes"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, bytes binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the round trip of each text as checksums."""
    rows = encoded(docs, key, text, ranks, back=True)
    return rows.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
