"""Toxic spans tagged by a linear-chain conditional random field; forward-backward marginals give document scores.

Tokens are runs of letters and digits, ASCII capitals lowered. Documents have labels, tokens don't, so the first step makes
labelled tokens: a token is toxic if its document is labelled toxic and the token, or its first four to six bytes, occurs
significantly more often in toxic documents (likelihood ratio) and in hardly any other. The field, with token, prefix and
suffix features, is fitted on lines of those documents. Each line of every whole document is one sequence; a document's
score is fitted to its largest marginal and its expected number of toxic tokens.

Defined results: a null or empty text, or one without tokens, has the lowest score and no offsets; repeated rows get equal
results; without toxic labels every score is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm import crf, sampling, textops

#: Labelled documents that are fitted on at most, and lines of them that the field sees at most.
FIT_ROWS, FIT_LINES = 4000, 4000
#: Folds by crc32 of the document's key, and the one that is never learned from.
FOLDS, HELD_OUT = 3, 1
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Likelihood ratio and precision that make a token or prefix a sign of toxicity.
LEAST_RATIO, LEAST_PRECISION = 15.0, 0.9
#: Weights of the field: hashed feature indices.
BITS = 20

_LETTER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Tokens:
    """Tokens of some texts with hashed features; sequences are lines."""

    def __init__(self, column: pa.Array):
        data, bounds = textops.buffers(column)
        self.words = textops.words_in(data, bounds, inside=_LETTER, lower=_LOWER)
        w = self.words
        size = w.ends - w.starts
        spans = [w.hashes()]
        for k in (4, 5, 6):
            end = w.starts + np.minimum(size, k)
            spans.append(textops.mix(w.hashes(w.starts, end) + np.uint64(k)) * (size >= k))
        self.signs = np.stack(spans, 1)
        line = np.cumsum(data == 10)[w.starts] if len(data) else np.zeros(0, np.int64)
        fresh = np.ones(len(line), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (w.text[1:] != w.text[:-1])
        self.lines = np.diff(np.append(np.flatnonzero(fresh), len(line)))

    def features(self) -> np.ndarray:
        """Indices of the active features, after feature 0, which is always active."""
        hashed = (self.signs >> np.uint64(64 - BITS)).astype(np.int64) | 1
        hashed[self.signs == 0] = 0
        return np.concatenate([np.zeros((len(hashed), 1), np.int64), hashed], 1)


@dataclass
class Tagger:
    """The field's weights by feature, kept only for features seen in fitting, and the score's three coefficients."""

    index: np.ndarray
    chain: crf.Chain
    coefficients: np.ndarray

    def marginal(self, tokens: Tokens) -> np.ndarray:
        if not len(self.index):
            return np.zeros(len(tokens.signs))
        active = tokens.features()
        place = np.searchsorted(self.index, active)
        place[place == len(self.index)] = 0
        place = np.where(self.index[place] == active, place, len(self.index))
        return crf.marginals(self.chain, self.chain.emissions(place), tokens.lines, moves=False)[0][:, 1]

    def score(self, p: np.ndarray, tokens: Tokens) -> np.ndarray:
        x = evidence(p, tokens)
        return np.where(x[:, 0] > 0, 1 / (1 + np.exp(-(x @ self.coefficients))), 0.0) if len(self.index) else np.zeros(len(x))


def evidence(p: np.ndarray, tokens: Tokens) -> np.ndarray:
    """For each text: 1 if it has tokens, the logit of the largest marginal, log(1 + expected toxic tokens among likely ones)."""
    n = tokens.words.n_texts
    most = np.zeros(n)
    np.maximum.at(most, tokens.words.text, p)
    likely = np.bincount(tokens.words.text, p * (p > 0.2), minlength=n)
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([(tokens.words.counts > 0).astype(float), np.log(most / (1 - most)), np.log1p(likely)], 1)


def signs_of_toxicity(pairs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """For each kind of sign, the significant ones, sorted. ``pairs``: for each kind (sign, text) without repeats.

    ``group`` joins near copies, which count as one document.
    """
    groups, place = np.unique(group, return_inverse=True)
    bad = np.zeros(len(groups), bool)
    np.logical_or.at(bad, place, y == 1)
    n_bad, n_good = max(int(bad.sum()), 1), max(int((~bad).sum()), 1)
    out = []
    for sign, text in pairs:
        names, inverse = np.unique(sign, return_inverse=True)
        pair = np.unique(inverse.astype(np.int64) * len(groups) + place[text])
        in_bad = bad[pair % len(groups)]
        a = np.bincount((pair // len(groups))[in_bad], minlength=len(names)).astype(float)
        b = np.bincount((pair // len(groups))[~in_bad], minlength=len(names)).astype(float)
        rate = (a + b) / (n_bad + n_good)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(a > 0, a * np.log(a / (n_bad * rate)), 0) + np.where(b > 0, b * np.log(b / (n_good * rate)), 0))
        out.append(names[(ratio >= LEAST_RATIO) & (a / n_bad > b / n_good) & (a >= LEAST_PRECISION * (a + b)) & (names != 0)])
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Tagger:
    """The tagger, from at most ``most`` labelled documents outside the held-out fold.

    The sample is gone through three times in slices, so that the driver holds tokens of one slice at a time: for the
    signs, for the lines that the field is fitted on, and for the score.
    """
    rows = sampling.labelled(docs, labels, "toxic", most, lambda key: F.coalesce(sampling.fold(key, folds) != held_out, F.lit(False)))
    y = np.array([y for _, _, y in rows], int)
    if not y.any():
        return Tagger(np.zeros(0, np.int64), crf.Chain.zero(1), np.zeros(3))
    sample = pa.RecordBatch.from_arrays([pa.array([x for _, x, _ in rows], pa.string())], ["text"])

    def slices() -> Iterator[tuple[int, Tokens]]:
        begin = 0
        for x in textops.slices(sample):
            yield begin, Tokens(x.column(0))
            begin += x.num_rows

    least = np.full(len(rows), np.iinfo(np.uint64).max, np.uint64)
    found: list[list[np.ndarray]] = [[] for _ in range(4)]
    of: list[list[np.ndarray]] = [[] for _ in range(4)]
    for begin, tokens in slices():
        text, shingle = textops.shingles(tokens.words, tokens.signs[:, 0], 5)
        np.minimum.at(least, text + begin, shingle)
        for j in range(4):
            _, first = np.unique(textops.mix(tokens.signs[:, j]) ^ textops.mix(tokens.words.text.astype(np.uint64)), return_index=True)
            found[j].append(tokens.signs[first, j])
            of[j].append(tokens.words.text[first] + begin)
    signs = signs_of_toxicity([(np.concatenate(a), np.concatenate(b)) for a, b in zip(found, of, strict=True)], y, least)
    del found, of
    active, label, lengths, hot_lines, cold_lines = [], [], [], 0, 0

    def marked(begin: int, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens with a sign in toxic documents, each token's line, lines with such a token."""
        hit = (y[tokens.words.text + begin] == 1) & np.logical_or.reduce([np.isin(tokens.signs[:, j], signs[j]) for j in range(4)])
        line = np.repeat(np.arange(len(tokens.lines)), tokens.lines)
        return hit, line, np.bincount(line[hit], minlength=len(tokens.lines)) > 0

    # both kinds of lines are taken evenly over the whole sample
    total = sum(int(marked(begin, tokens)[2].sum()) for begin, tokens in slices())
    every, every_hot = (max(1, -(-n // (FIT_LINES // 2))) for n in (sum(x.count("\n") + 1 for _, x, _ in rows), total))
    for begin, tokens in slices():
        hit, line, hot = marked(begin, tokens)
        chosen = (hot & ((hot_lines + np.cumsum(hot)) % every_hot == 0)) | (~hot & ((cold_lines + np.cumsum(~hot)) % every == 0))
        hot_lines, cold_lines = hot_lines + int(hot.sum()), cold_lines + int((~hot).sum())
        active.append(tokens.features()[chosen[line]])
        label.append(hit[chosen[line]].astype(int))
        lengths.append(tokens.lines[chosen])
    index, place = np.unique(np.concatenate(active), return_inverse=True)
    chain = crf.fit(place.reshape(-1, active[0].shape[1]), np.concatenate(label), np.concatenate(lengths), len(index) + 1, rounds=40, rate=0.5, ridge=1e-6)
    tagger = Tagger(index, chain, np.zeros(3))
    x = np.concatenate([evidence(tagger.marginal(tokens), tokens) for _, tokens in slices()])
    held = x[:, 0] > 0
    tagger.coefficients = logistic(x[held], y[held])
    return tagger


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Penalised logistic regression by Newton steps, damped so that separable data stay finite."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
    return w


SCHEMA = "held_out boolean, score double, predicted int, offsets array<struct<start:int,length:int,p:double>>"


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least_p: float = 0.5) -> DataFrame:
    """One row per document: key, held_out, score, predicted, offsets (byte offsets and lengths of tokens likely toxic)."""
    tagger = fit(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels)
    held = F.coalesce(sampling.fold(key, FOLDS) == HELD_OUT, F.lit(False))
    source = docs.select(F.col(key).alias("key"), held.alias("held_out"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole, limit=1 << 19):
                tokens = Tokens(batch.column(2))
                p = shared.value.marginal(tokens)
                scores = shared.value.score(p, tokens)
                hit = np.flatnonzero(p >= least_p)
                of = tokens.words.text[hit]
                values = pa.StructArray.from_arrays(
                    [pa.array((tokens.words.starts[hit] - tokens.words.bounds[of]).astype(np.int32)), pa.array((tokens.words.ends - tokens.words.starts)[hit].astype(np.int32)), pa.array(p[hit])], ["start", "length", "p"]
                )
                places = np.append(0, np.cumsum(np.bincount(of, minlength=batch.num_rows))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.ListArray.from_arrays(pa.array(places), values).cast(spans)],
                    ["key", "held_out", "score", "predicted", "offsets"],
                )

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
