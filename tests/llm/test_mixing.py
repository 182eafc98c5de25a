import pytest

from playtrace.llm import mixing


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by literally resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, done = {}, set()
    rest = share * sum(sizes.values())
    while True:
        live = [s for s in order if s not in done]
        total = sum(weight[s] for s in live)
        over = [s for s in live if rest * weight[s] / total > most * sizes[s]]
        if not over:
            return goal | {s: rest * weight[s] / total for s in live}
        for s in over:
            goal[s] = most * sizes[s]
            rest -= goal[s]
            done.add(s)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, note string")


def corpus(n=600):
    return [(i, " ".join(["w"] * (i * 7 % 90)), ["a", "b", None, "ü", "hot", "hot", "hot"][i % 7], "x") for i in range(n)]


def test_targets_equal_literal_resharing(spark):
    got = mixing.plan(table(spark, corpus())).select("source", "source_size", "target").distinct().collect()
    sizes = {r["source"]: r["source_size"] for r in got}
    want = reshared(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_taken_is_near_target_and_bounded(spark):
    rows = mixing.plan(table(spark, corpus(4000))).collect()
    assert all(0 <= r["copies"] <= 2 for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 180
    assert rows == mixing.plan(table(spark, corpus(4000))).collect() or sorted(rows) == sorted(mixing.plan(table(spark, corpus(4000))).collect())


def test_mixed_emits_rows_as_planned(spark):
    docs = table(spark, corpus()).withColumnRenamed("note", "size")
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: v for k, v in plan.items() if v}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(1, "", "a", None), (1, "", "a", None)], [(1, "x y", "a", None)] * 3])
def test_edge_tables(spark, rows):
    got = mixing.plan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] == r["copies"] * r["size"] for r in got)


def test_words(spark):
    from pyspark.sql import functions as F

    texts = ["", None, " ", "a", " a\tb c\n", "\x0b\x0ca\r", "a b "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(mixing.n_words(F.col("t"))).collect()]
    assert got == [0, 0, 0, 1, 2, 1, 2]
