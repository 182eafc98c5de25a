"""Quality classifier from weak labels: overlapping heuristics vote, expectation-maximisation weighs them, a hashed linear
scorer learns the posterior labels.

Each heuristic votes good, bad or nothing on every whole document. The votes of all documents are counted by pattern (a
table of at most 3^11 rows), and EM on those counts estimates each heuristic's vote probabilities given the hidden label.
The posterior of each pattern labels a bounded sample of documents, on which logistic regression over hashed words and
measures is fitted. Every document is scored by it. No given label is used.

Defined results: a null or empty text gets no good vote and scores by its measures alone; repeated rows get equal results;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm import quality, sampling, textops

#: Documents that the scorer is fitted on at most.
FIT_ROWS = 3000
#: Hashed word features, and the measures that follow them.
BITS = 16
#: Score from which a document is kept.
LEAST_SCORE = 0.5

#: Each heuristic: name, measure, bad if below, bad if above, good from, good to (None: that side doesn't vote).
HEURISTICS = (
    ("length", "n_words", 20, None, 40, None),
    ("symbols", "symbols", None, 0.06, None, 0.01),
    ("capitals", "capitals", None, 0.45, None, 0.2),
    ("marks", "marks", None, 0.08, None, 0.03),
    ("word_length", "word_length", 2.2, 11.5, 3.0, 9.5),
    ("variety", "variety", 0.2, None, 0.3, None),
    ("repeats", "repeats", None, 0.3, None, 0.1),
    ("sentences", "sentences", 0.008, None, 0.03, 0.4),
    ("plain", "plain", 0.7, None, 0.9, None),
    ("letters", "letters", 0.92, None, 0.95, None),
    ("echo", "echo", None, 0.2, None, 0.05),
)
MEASURES = ("n_words", "symbols", "capitals", "marks", "word_length", "variety", "repeats", "sentences", "plain", "letters", "echo")
#: Bounds by which the scorer bins each measure.
STEPS = {
    "n_words": [20, 50, 100, 400, 2000], "symbols": [0.005, 0.02, 0.06, 0.15], "capitals": [0.1, 0.2, 0.45, 0.7], "marks": [0.01, 0.03, 0.08],
    "word_length": [2.2, 3.0, 6.0, 9.5, 11.5], "variety": [0.1, 0.2, 0.3, 0.6], "repeats": [0.02, 0.1, 0.3, 0.6], "sentences": [0.003, 0.008, 0.03, 0.1, 0.4],
    "plain": [0.3, 0.7, 0.9], "letters": [0.8, 0.92, 0.95], "echo": [0.05, 0.2, 0.5],
}
N_BINS = sum(len(x) + 1 for x in STEPS.values())


class Measured:
    """Measures and hashed words of an array of texts."""

    def __init__(self, column: pa.Array):
        words = self.words = textops.words_of(column)
        hashes = words.hashes()
        n = self.n = words.counts
        data, bounds = words.data, words.bounds
        size = np.maximum(np.diff(bounds), 1)

        def share(table: np.ndarray) -> np.ndarray:
            return textops.sums(table[data], bounds) / size

        upper, lower = textops.sums(quality.UPPER[data], bounds), textops.sums(quality.LOWER[data], bounds)
        self.bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        tagged = textops.mix(hashes) ^ textops.mix(words.text.astype(np.uint64))
        kept, self.pair = np.unique(tagged, return_index=True)
        distinct = np.bincount(words.text[self.pair], minlength=len(n))
        ends = np.zeros(len(hashes), bool) if not len(hashes) else quality.STOPS[data[words.ends - 1]]
        some = np.maximum(n, 1)
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum((quality.SYMBOLS | quality.MARKS)[data], out=odd[1:])
        echo = np.zeros(len(hashes), bool)
        echo[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
        plain = odd[words.ends] == odd[words.starts]
        solid = textops.sums(~textops.SPACE[data], bounds)
        # long texts repeat common words, so variety is taken against the square root of their length beyond 400 words
        self.values = {
            "n_words": n, "symbols": share(quality.SYMBOLS), "capitals": upper / np.maximum(upper + lower, 1), "marks": share(quality.MARKS),
            "word_length": solid / some, "variety": distinct / np.minimum(some, np.sqrt(some * 400.0)),
            "repeats": quality.repeated_windows(words, hashes) / some, "sentences": np.bincount(words.text, ends, minlength=len(n)) / some,
            "plain": np.bincount(words.text, plain, minlength=len(n)) / some, "letters": textops.sums((quality.UPPER | quality.LOWER | quality.HIGH)[data], bounds) / np.maximum(solid, 1),
            "echo": np.bincount(words.text, echo, minlength=len(n)) / some,
        }

    def votes(self) -> np.ndarray:
        """texts x heuristics: 1 good, 2 bad, 0 no vote."""
        out = np.zeros((len(self.n), len(HEURISTICS)), np.int64)
        for j, (_, measure, low, high, good_from, good_to) in enumerate(HEURISTICS):
            x = self.values[measure]
            good = (self.n > 0) & (x >= (-np.inf if good_from is None else good_from)) & (x <= (np.inf if good_to is None else good_to))
            bad = (x < (-np.inf if low is None else low)) | (x > (np.inf if high is None else high))
            out[:, j] = np.where(bad, 2, np.where(good, 1, 0))
        return out

    def patterns(self) -> np.ndarray:
        return self.votes() @ (3 ** np.arange(len(HEURISTICS)))

    def bins(self) -> np.ndarray:
        columns, begin = [], 0
        for name in MEASURES:
            columns.append(begin + np.searchsorted(STEPS[name], self.values[name], side="right"))
            begin += len(STEPS[name]) + 1
        return np.stack(columns, 1)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """The linear score: mean weight of distinct words, and the weights of the measures' bins."""
        text = self.words.text[self.pair]
        total = np.bincount(text, weights[self.bucket[self.pair]], minlength=len(self.n))
        total /= np.sqrt(np.maximum(np.bincount(text, minlength=len(self.n)), 1))
        return 1 / (1 + np.exp(-np.clip(total + weights[(1 << BITS) + self.bins()].sum(1), -30, 30)))


def estimate(counts: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: P(vote | label) as labels x heuristics x votes, posterior of good by pattern, share of good.

    It starts from the majority of votes, which also fixes which label means good.
    """
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[int(x)] for x in patterns], float)
    votes = patterns[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3
    good = ((votes == 1).sum(1) + 1) / ((votes > 0).sum(1) + 2)
    table = np.full((2, len(HEURISTICS), 3), 1 / 3)
    prior = 0.5
    for _ in range(rounds):
        both = np.stack([weight * (1 - good), weight * good])
        for v in range(3):
            table[:, :, v] = both @ (votes == v) + 1
        table /= table.sum(2, keepdims=True)
        prior = (both[1].sum() + 1) / (weight.sum() + 2)
        log = np.log(table[:, np.arange(len(HEURISTICS)), votes]).sum(2)
        odds = log[1] - log[0] + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return table, dict(zip(patterns.tolist(), good.tolist(), strict=True)), prior


def learn(texts: list[str], target: np.ndarray, rounds: int = 60, rate: float = 0.2, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the scorer, by Adam on the logistic loss against soft labels."""
    weights = np.zeros((1 << BITS) + N_BINS)
    if not texts:
        return weights
    m = Measured(pa.array(texts, pa.string()))
    text, bucket, bins = m.words.text[m.pair], m.bucket[m.pair], m.bins() + (1 << BITS)
    norm = 1 / np.sqrt(np.maximum(np.bincount(text, minlength=len(texts)), 1))
    a, b = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, rounds + 1):
        miss = (target - m.score(weights)) / len(texts)
        slope = np.bincount(bucket, miss[text] * norm[text], len(weights)) + np.bincount(bins.ravel(), np.repeat(miss, bins.shape[1]), len(weights))
        slope -= ridge * weights
        a = 0.9 * a + 0.1 * slope
        b = 0.99 * b + 0.01 * slope * slope
        weights += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-5)
    return weights


def _map(source: DataFrame, run, columns: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textops.slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), *run(Measured(batch.column(1)))], ["key", *(x.split()[0] for x in columns.split(", "))])

    return source.mapInArrow(each, f"key {source.schema['key'].dataType.simpleString()}, {columns}")


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = FIT_ROWS, least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per document: key, n_votes, n_bad_votes, posterior (of good, from its votes alone), score, kept."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    counted = _map(source, lambda m: [pa.array(m.patterns())], "pattern long").groupBy("pattern").count()
    counts = {r["pattern"]: r["count"] for r in counted.collect()}
    if not counts:
        return source.select(F.col("key").alias(key), *(F.lit(None).cast(t).alias(n) for n, t in (("n_votes", "int"), ("n_bad_votes", "int"), ("posterior", "double"), ("score", "double"), ("kept", "boolean"))))
    _, good, _ = estimate(counts)
    eligible = source.filter(F.col("text").isNotNull() & (F.length("text") <= sampling.LONGEST))
    picked = sampling.spread(eligible, "key", most, sum(counts.values()))
    texts = sorted(picked.select("text").toPandas()["text"].tolist())
    patterns = Measured(pa.array(texts, pa.string())).patterns() if texts else np.zeros(0, np.int64)
    weights = learn(texts, np.array([good.get(int(x), 0.5) for x in patterns]))
    shared = docs.sparkSession.sparkContext.broadcast((weights, good))

    def run(m: Measured) -> list[pa.Array]:
        weights, good = shared.value
        votes, score = m.votes(), m.score(weights)
        by_votes = np.array([good.get(int(x), 0.5) for x in m.patterns()])
        return [pa.array((votes > 0).sum(1).astype(np.int32)), pa.array((votes == 2).sum(1).astype(np.int32)), pa.array(by_votes), pa.array(score), pa.array((score >= least_score) & (m.n > 0))]

    return _map(source, run, "n_votes int, n_bad_votes int, posterior double, score double, kept boolean").withColumnRenamed("key", key)
