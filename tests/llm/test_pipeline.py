"""The pipeline end to end over planted rows: each stage is judged on its own input, by a plain version."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from test_dedup import bag, lines_kept, similarity
from test_scores import base_rules, prose

from playtrace.llm import mixing, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """(texts, clean): clean documents, junk, exact copies, copies with an edited word, the same words in other lines, null and empty texts."""
    draw = random.Random(30)
    good = ["\n".join(prose(draw, 14) for _ in range(5)) for _ in range(60)]
    bad = ["\n".join(f"### {prose(draw, 3).upper()} | $ {i} %%" for i in range(12)) for _ in range(40)]
    edited = [x.replace(x.split()[20], "other", 1) for x in good[4:7]]
    wrapped = ["\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) for w in (x.split() for x in good[8:12])]
    return [*good, *bad, *good[:3], *edited, *wrapped, None, "", "\n"], len(good)


def kept_of_classes(rows):
    """Brute force: the least doc_id of each class of texts whose similarities reach 0.8."""
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = {i: bag(x) for i, x in rows.items()}
    for j in rows:
        for i in rows:
            if i < j and similarity(bags[i], bags[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {root(i) for i in rows}


def test_every_stage_equals_its_plain_version(spark, tmp_path):
    texts, n_clean = corpus()
    rows = [(i, x, "en", ["a", "b", "hot", "hot", None][i % 5], len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(i, int(i < n_clean), 0) for i in range(0, 100, 2)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")

    docs, taken, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), [], {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        taken.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert name == "packing" or out.columns == docs.columns
        outs[name], before, docs = out, docs, out

    # quality rules: the operator's verdicts, none against the base rules; clean documents stay
    kept = {r["doc_id"] for r in outs["quality_rules"].collect()}
    assert kept == {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{tmp_path}/documents.parquet"), marks).filter("kept").collect()}
    assert set(range(n_clean)) <= kept and not kept & set(range(n_clean, n_clean + 40))
    for i in kept:
        n_words, *_, repeated = base_rules(texts[i])
        assert n_words >= 20 and 100 * repeated <= 30 * n_words

    # line dedup: lines that match an earlier one go, documents without a word too
    ids = sorted(taken[1])
    want, _ = lines_kept([taken[1][i] for i in ids])
    left = {}
    for at, i in enumerate(ids):
        lines = [x for j, x in enumerate(taken[1][i].split("\n")) if j in want[at][0] or not x.split()]
        if any(x.split() for x in lines):
            left[i] = "\n".join(lines)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in outs["line_dedup"].collect()} == {i: (x, len(x)) for i, x in left.items()}
    assert len(ids) > len(left) >= n_clean

    # near dedup: one document of each class; the same words in other lines are a copy
    near = {r["doc_id"] for r in outs["near_dedup"].collect()}
    assert near == kept_of_classes(taken[2]) and len(near) < len(taken[2]) and set(range(n_clean)) <= near

    # mixing: copies as planned, rows as they were
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(outs["near_dedup"]).collect()}
    mixed = [(r["doc_id"], r["text"]) for r in outs["mixing"].collect()]
    assert Counter(i for i, _ in mixed) == Counter({i: n for i, n in plan.items() if n})
    assert all(x == taken[3][i] for i, x in mixed)

    # packing: every id of every row once, windows full but the last
    encode = packing.encoder().exact.encode
    size, filled = defaultdict(int), defaultdict(int)
    for r in outs["packing"].collect():
        size[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]] += r["length"]
    expected = Counter()
    for i, x in mixed:
        expected[i] += len(encode(x, add_special_tokens=False).ids) + 1
    assert size == expected
    assert all(n == 1024 for s, n in filled.items() if s < max(filled)) and sorted(filled) == list(range(len(filled)))

    # the whole run gives the same documents with as many tokens
    whole = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        whole[r["doc_id"]] += r["length"]
    assert whole == size


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
