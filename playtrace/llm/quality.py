"""Quality rules: lines labelled content or boilerplate by a linear-chain conditional random field.

A line's features are binned measures of its form (symbols, capitals, words, repeats within the document). The field is
fitted on a bounded sample of documents with a quality label: lines of low-quality documents and lines that stood in the
same document before are boilerplate, others content. Viterbi decoding labels the lines of every whole document; the words in content lines, as a share of all words,
decide whether it stays.

Defined results: a null or empty text has no words and fails the base rules; lines without a word are not labelled;
repeated rows get equal results; without labels of both kinds every line is content; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm import crf, sampling, textops

#: Documents that the field is fitted on at most.
FIT_ROWS = 3000
#: A document stays if at least this share of its words is in content lines.
LEAST_CONTENT = 0.5
#: Base rules: fewest words, window of words, and percent of words that repeated windows may cover.
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEAT = 20, 8, 30

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
HIGH = np.arange(256) >= 128
MARKS = np.isin(np.arange(256), np.frombuffer(b"!?\"'()[]{}=+/\\~^_@", np.uint8))
STOPS = np.isin(np.arange(256), np.frombuffer(b".!?:", np.uint8))
CONTINUES = (np.arange(256) & 0xC0) == 0x80

#: Upper bounds of the bins of each measure, in the order in which ``line_features`` computes them.
BINS = (
    np.array([0.005, 0.03, 0.08, 0.2]),  # symbols by bytes
    np.array([0.1, 0.3, 0.6, 0.85]),  # capitals by ASCII letters
    np.array([0.01, 0.05, 0.12]),  # marks by bytes
    np.array([0.02, 0.1, 0.3]),  # digits by bytes
    np.array([1.5, 4.5, 9.5, 20.5, 60.5]),  # words
    np.array([2.5, 4.0, 9.0, 14.0]),  # mean bytes of a word
    np.array([0.3, 0.6, 0.85]),  # distinct words by words
    np.array([0.5]),  # equal to an earlier line of the document
    np.array([0.5]),  # ends as a sentence does
)
OFFSETS = np.cumsum([0, *(len(x) + 1 for x in BINS)])
N_FEATURES = int(OFFSETS[-1])


class Lines:
    """The lines with a word of some texts, with measures of each."""

    def __init__(self, words: textops.Words, hashes: np.ndarray):
        data, bounds = words.data, words.bounds
        starts, ends = textops.runs(data, bounds, data != 10)
        first = np.searchsorted(words.starts, starts)
        n = np.searchsorted(words.starts, ends) - first
        has = n > 0
        self.starts, self.ends, self.first, self.n_words = starts[has], ends[has], first[has], n[has]
        self.text = np.searchsorted(bounds, self.starts, side="right") - 1
        self.words, self.hashes = words, hashes
        self.repeated = self._repeated()

    def _repeated(self) -> np.ndarray:
        """Whether an earlier line of the same text is equal, byte for byte (by a 64-bit hash)."""
        if not len(self.starts):
            return np.zeros(0, bool)
        content = self.words.hashes(self.starts, self.ends)
        order = np.lexsort((np.arange(len(content)), content, self.text))
        same = (content[order][1:] == content[order][:-1]) & (self.text[order][1:] == self.text[order][:-1])
        out = np.zeros(len(content), bool)
        out[order[1:][same]] = True
        return out

    def features(self) -> np.ndarray:
        """Active features: one bin of each measure for each line."""
        data, size = self.words.data, np.maximum(self.ends - self.starts, 1)

        def count(table: np.ndarray) -> np.ndarray:
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(table[data], out=total[1:])
            return total[self.ends] - total[self.starts]

        capitals, small, blank = count(UPPER), count(LOWER), count(textops.SPACE)
        line = np.repeat(np.arange(len(self.starts)), self.n_words)
        inside = np.repeat(self.first - np.cumsum(self.n_words) + self.n_words, self.n_words) + np.arange(int(self.n_words.sum()))
        pairs = textops.mix(self.hashes[inside]) ^ textops.mix(line.astype(np.uint64))
        order = np.lexsort((pairs, line))
        fresh = np.ones(len(pairs), bool)
        fresh[1:] = (pairs[order][1:] != pairs[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order][fresh], minlength=len(self.starts))
        last = self.words.ends[self.first + self.n_words - 1] - 1 if len(self.starts) else np.zeros(0, int)
        measures = (
            count(SYMBOLS) / size, capitals / np.maximum(capitals + small, 1), count(MARKS) / size, count(DIGIT) / size, self.n_words,
            (size - blank) / self.n_words, distinct / self.n_words, self.repeated, STOPS[data[last]] if len(last) else np.zeros(0),
        )
        return np.stack([OFFSETS[j] + np.searchsorted(BINS[j], np.asarray(x, float)) for j, x in enumerate(measures)], 1)


def repeated_windows(words: textops.Words, hashes: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window of ``width`` words found twice or more in that text."""
    at = np.flatnonzero(np.arange(len(hashes)) + width <= np.repeat(words.first[1:], words.counts))
    if not len(at):
        return np.zeros(words.n_texts, np.int64)
    rolled = np.zeros(len(at), np.uint64)
    for j in range(width):
        rolled += hashes[at + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    rolled = textops.mix(rolled ^ textops.mix(words.text[at].astype(np.uint64)))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + width, -1)
    return textops.sums(np.cumsum(change[:-1]) > 0, words.first)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> crf.Chain:
    """The field, from at most ``most`` documents with a quality label; zero weights if one label is missing."""
    rows = sampling.labelled(docs, labels, "quality", most)
    if len({y for _, _, y in rows}) < 2:
        return crf.Chain.zero(N_FEATURES)
    marks = 1 - np.array([y for _, _, y in rows])
    sample, begin = pa.RecordBatch.from_arrays([pa.array([x for _, x, _ in rows], pa.string())], ["text"]), 0
    features, label, lengths = [], [], []
    for piece in textops.slices(sample):  # the driver holds the words of one slice at a time
        words = textops.words_of(piece.column(0))
        lines = Lines(words, words.hashes())
        features.append(lines.features())
        # in a good document too, a line that stood there before is boilerplate
        label.append(np.maximum(marks[lines.text + begin], lines.repeated))
        lengths.append(np.bincount(lines.text, minlength=piece.num_rows))
        begin += piece.num_rows
    return crf.fit(np.concatenate(features), np.concatenate(label), np.concatenate(lengths), N_FEATURES)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"


def judged(column: pa.Array, chain: crf.Chain, least_content: float = LEAST_CONTENT) -> dict[str, np.ndarray]:
    """All output columns for an array of texts."""
    words = textops.words_of(column)
    hashes = words.hashes()
    lines = Lines(words, hashes)
    n = words.counts
    letters = (~textops.SPACE & ~CONTINUES)[words.data]
    repeats = repeated_windows(words, hashes)
    label = crf.viterbi(chain, chain.emissions(lines.features()), np.bincount(lines.text, minlength=words.n_texts))
    good = np.bincount(lines.text, lines.n_words * (label == 0), minlength=words.n_texts)
    share = good / np.maximum(n, 1)
    failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEAT * n)
    return {
        "n_words": n, "word_chars": textops.sums(letters, words.bounds), "n_symbols": textops.sums(SYMBOLS[words.data], words.bounds),
        "n_dup_lines": np.bincount(lines.text, lines.repeated, minlength=words.n_texts).astype(np.int64), "n_repeat_words": repeats,
        "base_failed": failed, "kept": ~failed & (share >= least_content), "n_lines": np.bincount(lines.text, minlength=words.n_texts),
        "n_content_lines": np.bincount(lines.text, label == 0, minlength=words.n_texts).astype(np.int64), "content_share": share,
    }


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least_content: float = LEAST_CONTENT) -> DataFrame:
    """One row per document with the measures, ``base_failed`` and ``kept``."""
    chain = fit(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole):
                got = judged(batch.column(1), chain, least_content)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[x]) for x in names)], ["key", *names])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", least_content: float = LEAST_CONTENT) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; decided row by row, without a join."""
    chain = fit(docs, labels)

    @F.pandas_udf("boolean")
    def stays(texts: pd.Series) -> pd.Series:
        whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
        parts = [judged(x.column(0), chain, least_content)["kept"] for x in textops.slices(whole)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.filter(stays(F.col(text).cast("string")))
