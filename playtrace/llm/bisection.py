"""Recursive graph bisection: a tree that puts documents with the same terms near each other.

The tree is fitted on a bounded sample: at each level every node's documents are halved, and documents change sides in pairs
while that lowers the sum, over terms, of the logarithmic gaps between the documents that hold them. Each node keeps what
one more document costs on either side, term by term; every other document is led down by those costs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Levels of the tree (2 ** DEPTH leaves), passes over a level, most terms that the tree knows, documents a term must be in.
DEPTH, PASSES, TERMS, LEAST_DOCS = 6, 8, 1 << 14, 3


@dataclass
class Tree:
    """``terms`` sorted; ``costs[node, term]`` is positive where one more document is cheaper on the left."""

    terms: np.ndarray
    costs: np.ndarray
    depth: int

    def leaves(self, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of ``n`` documents, from pairs of a document and the place of a term in ``terms``."""
        node = np.zeros(n, np.int64)
        for _ in range(self.depth):
            gain = np.bincount(doc, self.costs[node[doc], at], n) if len(doc) else np.zeros(n)
            node = 2 * node + 1 + (gain < 0)
        return node - (2**self.depth - 1)


def _gaps(n, inside):
    """What the documents of one side cost: the gaps of a term that ``inside`` of its ``n`` documents hold."""
    return inside * np.log2(np.maximum(n, 1) / (inside + 1))


def fit(doc: np.ndarray, terms: np.ndarray, n: int, depth: int = DEPTH, passes: int = PASSES) -> Tree:
    """A tree over ``n`` sampled documents from pairs of a document and a term hash, each pair once."""
    known, counts = np.unique(terms, return_counts=True)
    frequent = np.flatnonzero((counts >= LEAST_DOCS) & (counts < n))
    # the terms that tell most documents apart; ties by hash
    frequent = frequent[np.argsort(-counts[frequent], kind="stable")[:TERMS]]
    known = np.sort(known[frequent])
    place = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
    held = known[place] == terms if len(known) else np.zeros(len(terms), bool)
    doc, at = doc[held], place[held]
    costs = np.zeros((2**depth - 1, len(known)), np.float32)
    node = np.zeros(n, np.int64)
    for level in range(depth):
        low = 2**level - 1
        side = np.zeros(n, np.int64)
        for x in range(low, 2 * low + 1):
            own = np.flatnonzero(node == x)
            side[own[len(own) // 2 :]] = 1
        for _ in range(passes):
            size, degree = _degrees(node, side, doc, at, low, len(known))
            d, m = degree[node[doc] - low, :, at], size[node[doc] - low]
            own, other = d[np.arange(len(doc)), side[doc]], d[np.arange(len(doc)), 1 - side[doc]]
            n_own, n_other = m[np.arange(len(doc)), side[doc]], m[np.arange(len(doc)), 1 - side[doc]]
            gain = np.bincount(doc, _gaps(n_own, own) + _gaps(n_other, other) - _gaps(n_own, own - 1) - _gaps(n_other, other + 1), n)
            moved = 0
            for x in range(low, 2 * low + 1):
                here = node == x
                left, right = (np.flatnonzero(here & (side == s)) for s in (0, 1))
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                pairs = min(len(left), len(right))
                swap = int(np.count_nonzero(gain[left[:pairs]] + gain[right[:pairs]] > 1e-9))  # a prefix: both gains fall
                side[left[:swap]], side[right[:swap]] = 1, 0
                moved += swap
            if not moved:
                break
        size, degree = _degrees(node, side, doc, at, low, len(known))
        for x in range(low, 2 * low + 1):
            (a, b), (na, nb) = degree[x - low], size[x - low]
            costs[x] = (_gaps(nb + 1, b + 1) - _gaps(nb, b)) - (_gaps(na + 1, a + 1) - _gaps(na, a))
        node = 2 * node + 1 + side
    return Tree(known, costs, depth)


def _degrees(node, side, doc, at, low, n_terms):
    """Documents of each (node, side), and of each (node, side, term)."""
    size = np.bincount((node - low) * 2 + side, minlength=2 * (low + 1)).reshape(-1, 2)
    key = ((node[doc] - low) * 2 + side[doc]) * max(n_terms, 1) + at
    return size, np.bincount(key, minlength=2 * (low + 1) * max(n_terms, 1)).reshape(low + 1, 2, -1)
