"""Ranked search against scoring every document, and the bisection tree."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from playtrace.llm import bisection, ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    held = [(key, Counter(terms(text))) for key, text in docs if terms(text)]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item in {k for k, _ in items}:
        query = Counter(terms(" ".join(sorted({t for k, t in items if k == item and t is not None}))))
        scores = []
        for key, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // words
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in query.items() if c[t])
            scores.append((-score, key is None, key))
        out |= {(item, i + 1, key, -score) for i, (score, _, key) in enumerate(sorted(x for x in scores if x[0] < 0)[:top])}
    return out


def some_docs(n=260, seed=2):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["Été", "漢字", "NAÏVE", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i * 3, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 60)))) for i in range(n)]
    docs += [(10_000 + i, docs[5][1]) for i in range(70)]  # copies: equal scores beyond a shard
    return docs + [(20_000, None), (20_001, ""), (20_002, "-- !"), (7, docs[9][1]), (7, docs[9][1]), (None, docs[11][1]), (20_003, " ".join(r.choices(vocabulary, k=40_000)))]


ITEMS = [(1, "w3 W7, w50 w50!"), (2, "Été et 漢字"), (2, "Été et 漢字"), (3, "nothing here"), (4, None), (5, "w1 w2 w3 w4 w5 w6 w90 w91 w92"), (6, "naÏve x9"), (6, "w8")]


@pytest.mark.parametrize("shard, rounds", [(16, (1, 3)), (64, ()), (384, (4, 32))])
def test_search_equals_scoring_all(spark, shard, rounds):
    docs = some_docs()
    # names that the operator uses inside as well
    table = spark.createDataFrame([(k, t, 1, "z", 2, 3) for k, t in docs], "doc_id long, text string, leaf int, terms string, shard int, n int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranking.ranked(table, items, shard=shard, rounds=rounds).collect()
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == plain(docs, ITEMS)


def test_items_in_blocks_and_text_keys(spark):
    docs = [(f"k{i % 1000:03}", t) for i, (_, t) in enumerate(some_docs())]
    r = random.Random(8)
    items = [(f"q{i}", " ".join(f"w{r.randrange(100)}" for _ in range(12))) for i in range(30)]
    got = ranking.ranked(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), terms=40, top=3, shard=32).collect()
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == plain(docs, items, 3)


@pytest.mark.parametrize("docs, items", [([], ITEMS), (some_docs(), []), ([(1, None)], ITEMS)])
def test_empty_tables(spark, docs, items):
    got = ranking.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_shards_hold_every_row_and_no_more_than_their_size(spark):
    docs = some_docs() + [(30_000 + i, "w1 w2 w3") for i in range(900)]
    held = ranking.index(spark.createDataFrame(docs, "doc_id long, text string"), shard=100)
    rows = held.shards.collect()
    assert sorted(k for r in rows for k in r["keys"] if k is not None) == sorted(k for k, t in docs if k is not None and terms(t))
    assert max(len(r["keys"]) for r in rows) <= 200
    for r in rows:
        assert r["keys"] == sorted(r["keys"], key=lambda x: (x is None, x or 0)) and len(r["terms"]) == len(r["ends"]) == len(r["best"]) and r["ends"][-1:] == [len(r["docs"])]


def test_bisection_brings_like_documents_together():
    r = np.random.default_rng(3)
    topics = r.permutation(np.repeat(np.arange(4), 100))
    pairs = {(d, int(t)) for d, topic in enumerate(topics) for t in np.concatenate([topic * 1000 + r.integers(0, 40, 15), 9000 + r.integers(0, 40, 5)])}
    doc, term = map(np.array, zip(*sorted(pairs), strict=True))
    tree = bisection.fit(doc, term, len(topics), depth=2)
    leaves = tree.leaves(doc[np.isin(term, tree.terms)], np.searchsorted(tree.terms, term[np.isin(term, tree.terms)]), len(topics))
    pure = sum(np.bincount(topics[leaves == x], minlength=4).max() for x in range(4) if (leaves == x).any())
    assert pure >= 0.9 * len(topics)
    empty = bisection.fit(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    assert empty.leaves(np.zeros(0, np.int64), np.zeros(0, np.int64), 3).tolist() == [0, 0, 0]
