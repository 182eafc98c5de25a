"""A two-label linear-chain conditional random field over sparse indicator features, for many sequences at once.

An item has ``k`` active features (indices into the weights). Sequences lie one after the other; ``lengths`` tells them
apart. All recursions step through positions, not sequences: one numpy operation handles position t of every sequence
that reaches it, so the number of operations is the longest sequence's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Emission weights (features x 2), transition scores (from x to) and start scores."""

    weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    @staticmethod
    def zero(n_features: int) -> Chain:
        return Chain(np.zeros((n_features, 2)), np.zeros((2, 2)), np.zeros(2))

    def emissions(self, active: np.ndarray) -> np.ndarray:
        """Scores of both labels for each item; ``active`` is items x k."""
        out = np.zeros((len(active), 2))
        for j in range(active.shape[1]):
            out += self.weights[active[:, j]]
        return out


def _steps(lengths: np.ndarray):
    """For each position: the items at it and at the one before, longest sequences first."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, ordered = first[order], lengths[order]
    live = len(ordered) - np.searchsorted(ordered[::-1], np.arange(int(ordered[0]) if len(ordered) else 0), side="right")
    return first, live


def marginals(chain: Chain, scores: np.ndarray, lengths: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(label) of each item, and the expected count of each move unless ``moves`` is false."""
    lengths = lengths[lengths > 0]
    n = len(scores)
    if not n:
        return np.zeros((0, 2)), np.zeros((2, 2))
    top = scores.max(1)
    e = np.exp(scores - top[:, None])
    t = np.exp(chain.moves)
    first, live = _steps(lengths)
    forward, backward, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    a = e[first] * np.exp(chain.begin)
    for step, m in enumerate(live):
        at = first[:m] + step
        if step:
            a = (forward[at - 1] @ t) * e[at]
        s = a.sum(1)
        forward[at], scale[at] = a / s[:, None], s
    for step in range(len(live) - 1, 0, -1):
        at = first[: live[step]] + step
        backward[at - 1] = ((e[at] * backward[at]) @ t.T) / scale[at][:, None]
    p = forward * backward
    p /= p.sum(1, keepdims=True)
    if not moves:
        return p, np.zeros((2, 2))
    later = np.ones(n, bool)
    later[first] = False
    at = np.flatnonzero(later)
    pairs = forward[at - 1][:, :, None] * t * (e[at] * backward[at] / scale[at][:, None])[:, None, :]
    pairs /= np.maximum(pairs.sum((1, 2), keepdims=True), 1e-300)
    return p, pairs.sum(0)


def viterbi(chain: Chain, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of each item in the best path of its sequence; label 0 wins ties."""
    lengths = lengths[lengths > 0]
    n = len(scores)
    best = np.zeros(n, np.int8)
    if not n:
        return best
    first, live = _steps(lengths)
    value, back = np.empty((n, 2)), np.zeros((n, 2), np.int8)
    for step, m in enumerate(live):
        at = first[:m] + step
        if not step:
            value[at] = scores[at] + chain.begin
            continue
        for label in (0, 1):
            stay = value[at - 1] + chain.moves[:, label]
            back[at, label] = stay[:, 1] > stay[:, 0]
            value[at, label] = stay.max(1) + scores[at, label]
    ends = first + np.sort(lengths)[::-1] - 1
    best[ends] = value[ends, 1] > value[ends, 0]
    for step in range(len(live) - 1, 0, -1):
        at = first[: live[step]] + step
        best[at - 1] = back[at, best[at]]
    return best


def fit(active: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, rounds: int = 120, rate: float = 0.3, ridge: float = 1e-3) -> Chain:
    """Maximise the penalised conditional likelihood by Adam over the whole sample; without items, all scores are 0."""
    chain = Chain.zero(n_features)
    keep = lengths > 0
    lengths = lengths[keep]
    if not len(labels):
        return chain
    first = np.cumsum(lengths) - lengths
    later = np.ones(len(labels), bool)
    later[first] = False
    at = np.flatnonzero(later)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (labels[at - 1], labels[at]), 1)
    seen_begin = np.bincount(labels[first], minlength=2).astype(float)
    truth = np.eye(2)[labels]
    n, flat = len(labels), active.ravel()
    params = [chain.weights, chain.moves, chain.begin]
    m1, m2 = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for k in range(1, rounds + 1):
        p, moved = marginals(chain, chain.emissions(active), lengths)
        miss = np.repeat(truth - p, active.shape[1], axis=0)
        slope = np.stack([np.bincount(flat, miss[:, j], n_features) for j in (0, 1)], 1)
        begin = seen_begin - np.stack([p[first, 0].sum(), p[first, 1].sum()])
        for x, g, a, b in zip(params, (slope, seen_moves - moved, begin), m1, m2, strict=True):
            g = g / n - ridge * x
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            x += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)
    return chain
