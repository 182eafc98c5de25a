"""Whole Arrow batches of texts as numpy arrays: word bounds, word hashes, n-word shingles.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D) of the UTF-8 text. Nulls count as empty texts.
All functions work on any number of texts at once, so that no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are expanded into numpy arrays at a time; a longer text comes alone.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = _BASE if which == "up" else _BASE_INVERSE
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and each text's bounds in them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, so that memory doesn't follow the batch size."""
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = int(np.searchsorted(at, at[begin] + limit, side="right")) - 1
        end = min(n, max(end, begin + 1), begin + 4096)
        yield batch.slice(begin, end - begin)
        begin = end


@dataclass
class Words:
    """The words of some texts: text index, byte bounds and hash of each; ``first`` bounds each text's words."""

    n_texts: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray
    prefix: np.ndarray | None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit content hashes of byte ranges, by default of the words."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        return span_hashes(self.prefix, starts, ends)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends] from the prefix sums of all data; equal bytes, equal hashes, wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix((prefix[ends] - prefix[starts]) * _power("down", len(prefix))[starts] + (ends - starts).astype(np.uint64))


def runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of ``inside`` bytes that don't cross a text's bounds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    stops[:-1] &= ~inside[1:] | fresh[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words_of(column: pa.Array, hashed: bool = True, inside: np.ndarray | None = None, lower: np.ndarray | None = None) -> Words:
    """All words of all texts. ``inside`` says which bytes make words, ``lower`` maps bytes before hashing."""
    data, bounds = buffers(column)
    return words_in(data, bounds, hashed, inside, lower)


def words_in(data: np.ndarray, bounds: np.ndarray, hashed: bool = True, inside: np.ndarray | None = None, lower: np.ndarray | None = None) -> Words:
    starts, ends = runs(data, bounds, (~SPACE if inside is None else inside)[data])
    first = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    prefix = prefix_sums(data if lower is None else lower[data]) if hashed else None
    return Words(len(bounds) - 1, data, bounds, starts, ends, text, first, prefix)


def shingles(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of ``n`` words within a text; a text of 1 to n-1 words gives one run of all its words."""
    total = len(hashes)
    rolled = np.zeros(total, np.uint64)
    last = np.repeat(words.first[1:], words.counts)
    short = np.repeat(words.counts < n, words.counts)
    at = np.arange(total)
    for j in range(n):
        there = at + j < last
        step = np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        rolled[there] += (hashes[at[there] + j] + np.uint64(j)) * step
    whole = at + n <= last
    keep = whole | (short & (at == np.repeat(words.first[:-1], words.counts)))
    return words.text[keep], mix(rolled[keep])


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of ``flags`` within each pair of neighbouring bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])
