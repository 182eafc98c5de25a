"""The weak-label classifier against plain versions: measures, EM over documents instead of patterns, the linear score."""

import bisect
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from test_scores import ODD, base_rules, prose

from playtrace.llm import weak_labels

SPACE = b" \t\n\x0b\x0c\r"


def texts():
    draw = random.Random(41)
    mixed = [" ".join(draw.choice(["ab", "Cd.", "$$", "(e)", "é", "x9!", "ab", "no?"]) for _ in range(draw.randrange(1, 700))) for _ in range(25)]
    return [*ODD, *mixed, *("\n".join(prose(draw, 30) for _ in range(3)) for _ in range(10))]


def measures(text):
    raw = (text or "").encode()
    words = raw.split()
    n, size, some = len(words), max(len(raw), 1), max(len(words), 1)
    symbols, marks = b"#*$%&|<>", b"!?\"'()[]{}=+/\\~^_@"
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    solid = sum(c not in SPACE for c in raw)
    return {
        "n_words": n, "symbols": sum(c in symbols for c in raw) / size, "capitals": upper / max(upper + lower, 1), "marks": sum(c in marks for c in raw) / size,
        "word_length": solid / some, "variety": len(set(words)) / min(some, math.sqrt(some * 400)), "repeats": base_rules(text)[4] / some,
        "sentences": sum(w[-1] in b".!?:" for w in words) / some, "plain": sum(not any(c in symbols + marks for c in w) for w in words) / some,
        "letters": (upper + lower + sum(c >= 128 for c in raw)) / max(solid, 1), "echo": sum(a == b for a, b in zip(words, words[1:])) / some,
    }


def test_measures_equal_plain_python():
    every = texts()
    got = weak_labels.Measured(pa.array(every, pa.string())).values
    for i, text in enumerate(every):
        assert {x: float(got[x][i]) for x in got} == pytest.approx(measures(text))


def test_estimate_equals_plain_em_over_documents():
    """One document at a time, no patterns."""
    draw, k = random.Random(43), len(weak_labels.HEURISTICS)
    truth = [draw.random() < 0.6 for _ in range(300)]
    votes = [[(1 if t == (draw.random() < 0.5 + j / 25) else 2) if draw.random() < 0.8 else 0 for j in range(k)] for t in truth]
    keys = [sum(v * 3**j for j, v in enumerate(row)) for row in votes]
    _, got, prior = weak_labels.estimate({x: keys.count(x) for x in keys}, rounds=12)

    good = [(row.count(1) + 1) / (k - row.count(0) + 2) for row in votes]
    for _ in range(12):
        table = {}
        for j in range(k):
            for label in (0, 1):
                share = [1 + sum(g if label else 1 - g for g, row in zip(good, votes) if row[j] == v) for v in range(3)]
                table[label, j] = [x / sum(share) for x in share]
        plain_prior = (sum(good) + 1) / (len(votes) + 2)
        both = [(math.prod(table[1, j][v] for j, v in enumerate(row)) * plain_prior, math.prod(table[0, j][v] for j, v in enumerate(row)) * (1 - plain_prior)) for row in votes]
        good = [a / (a + b) for a, b in both]
    assert prior == pytest.approx(plain_prior)
    assert [got[x] for x in keys] == pytest.approx(good)


def test_score_equals_plain_sum():
    every = texts()
    weights = np.random.default_rng(45).normal(size=(1 << weak_labels.BITS) + weak_labels.N_BINS)
    got = weak_labels.Measured(pa.array(every, pa.string())).score(weights)
    for i, text in enumerate(every):
        alone = weak_labels.Measured(pa.array([text], pa.string()))
        of = dict(zip((text or "").encode().split(), alone.bucket.tolist()))
        total = sum(weights[b] for b in of.values()) / math.sqrt(max(len(of), 1))
        begin, values = 1 << weak_labels.BITS, measures(text)
        for name in weak_labels.MEASURES:
            steps = weak_labels.STEPS[name]
            total += weights[begin + bisect.bisect_right(steps, float(alone.values[name][0]))]
            assert values[name] == pytest.approx(float(alone.values[name][0]))
            begin += len(steps) + 1
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)))
