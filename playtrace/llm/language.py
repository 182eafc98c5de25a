"""Language identification with a string kernel: blended-spectrum presence kernel, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the number of byte n-grams (n from 1 to 3, ASCII capitals lowered, hashed to 2^15 buckets) that
both have, divided by the geometric mean of their own numbers. Landmarks and the ridge solution come from a bounded sample;
one-versus-rest scores of a batch of texts are two matrix products of their presence rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from every text is
``und``; ties take the language first in order; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm import sampling, textops

#: Documents that are fitted on at most, and landmarks among them.
FIT_ROWS, LANDMARKS = 2000, 96
#: Buckets of hashed n-grams, longest n-gram, ridge.
BITS, LONGEST_GRAM, RIDGE = 15, 3, 1e-2
#: Folds by crc32 of the document's key, and the one that is never learned from.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Texts that share one presence matrix.
ROWS = 128

_FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if c < 65 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256)], np.uint64)


def presence(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """texts x buckets: 1 where the text has an n-gram of the bucket. Digits, marks and white space all count as blanks."""
    n = len(bounds) - 1
    out = np.zeros(n << BITS, np.uint8)
    codes, row = _FOLD[data], np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(bounds))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    gram = np.zeros(len(data), np.uint64)
    for k in range(1, LONGEST_GRAM + 1):
        gram = gram[: len(data) - k + 1] if k > 1 else gram
        gram = (gram << np.uint64(8)) | codes[k - 1 :] if len(data) >= k else gram[:0]
        bucket = ((gram + np.uint64(k << 24)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        whole = left[: len(gram)] >= k
        out[(row[: len(gram)] + bucket.astype(np.int64))[whole]] = 1
    return out.reshape(n, 1 << BITS)


@dataclass
class Model:
    languages: list[str]
    #: Presence rows of the landmarks, divided by the roots of their sizes; scores by landmark and language; intercepts.
    landmarks: np.ndarray
    solution: np.ndarray
    base: np.ndarray

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """texts x languages: near 1 for the text's language, near 0 for others."""
        rows = seen.astype(np.float32)
        size = np.sqrt(np.maximum(rows.sum(1), 1))
        return (rows @ self.landmarks.T) / size[:, None] @ self.solution + self.base


def fit(rows: list[tuple[str, str]], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """From (text, language) pairs. Landmarks are dealt over the languages in turn; None without a row."""
    if not rows:
        return None
    languages = sorted({y for _, y in rows})
    data, bounds = textops.buffers(pa.array([x for x, _ in rows], pa.string()))
    parts = [presence(data[bounds[i] : bounds[min(i + ROWS, len(rows))]], bounds[i : min(i + ROWS, len(rows)) + 1] - bounds[i]) for i in range(0, len(rows), ROWS)]
    turn: dict[str, int] = {}
    order = []
    for i, (_, y) in enumerate(rows):
        order.append((turn.setdefault(y, 0), i))
        turn[y] += 1
    chosen = [i for _, i in sorted(order)[:n_landmarks]]
    marks = np.stack([parts[i // ROWS][i % ROWS] for i in chosen]).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
    kernel = np.concatenate([(x.astype(np.float32) @ marks.T) / np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1))[:, None] for x in parts]).astype(float)
    values, vectors = np.linalg.eigh(kernel[chosen])
    use = values > 1e-6 * values.max(initial=1e-9)
    whiten = vectors[:, use] / np.sqrt(values[use])
    z = kernel @ whiten
    target = np.array([[float(y == x) for x in languages] for _, y in rows])
    # languages weigh the same, however many rows each has
    weight = (1 / target.sum(0))[target.argmax(1)] * len(rows) / len(languages)
    centre, mean = np.average(z, 0, weight), np.average(target, 0, weight)
    zc = (z - centre) * weight[:, None]
    inner = np.linalg.solve(zc.T @ (z - centre) + ridge * len(rows) / z.shape[1] * np.eye(z.shape[1]), zc.T @ (target - mean))
    return Model(languages, marks, (whiten @ inner).astype(np.float32), (mean - centre @ inner).astype(np.float32))


def sample(docs: DataFrame, most: int = FIT_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> list[tuple[str, str]]:
    """At most ``most`` (text, language) pairs outside the held-out fold, spread over all documents."""
    may = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sampling.LONGEST))
    may = may.filter(F.coalesce(sampling.fold("doc_id", folds) != held_out, F.lit(False)))
    got = sampling.spread(may, "doc_id", most).toPandas().sort_values(["doc_id", "text"], kind="stable")
    return list(zip(got["text"].tolist(), got["lang"].tolist(), strict=True))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: key, held_out, lang_pred, score, margin (over the second language)."""
    model = fit(sample(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))))
    held = F.coalesce(sampling.fold(key, FOLDS) == HELD_OUT, F.lit(False))
    letters = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col(key).alias("key"), held.alias("held_out"), letters.alias("letters"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in textops.slices(whole):
                for begin in range(0, piece.num_rows, ROWS):
                    batch = piece.slice(begin, ROWS)
                    n, model = batch.num_rows, shared.value
                    if model is None:
                        names, score, margin = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
                    else:
                        s = model.scores(presence(*textops.buffers(batch.column(3)))).astype(float)
                        best, known = s.argmax(1), pc.fill_null(batch.column(2), False).to_numpy(zero_copy_only=False)
                        top = np.sort(np.concatenate([s, np.full((n, 1), -1.0)], 1), 1)
                        names = [model.languages[j] if k else UNKNOWN for j, k in zip(best, known, strict=True)]
                        score, margin = np.where(known, np.clip(top[:, -1], 0, 1), 0.0), np.where(known, top[:, -1] - top[:, -2], 0.0)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(margin)], ["key", "held_out", "lang_pred", "score", "margin"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, held_out boolean, lang_pred string, score double, margin double").withColumnRenamed("key", key)
