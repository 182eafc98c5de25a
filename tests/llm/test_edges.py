"""Every operator over documents with null, empty and very long texts, repeated rows, clashing columns, and over no documents."""

import random

import pytest
from test_scores import prose

from playtrace.llm import language, line_dedup, media, mixing, near_dup, passages, quality, toxicity, weak_labels

#: Columns that operators use inside.
CLASHING = ["key", "id", "th", "row", "node", "n", "k", "sig", "words", "size", "number", "place", "signature", "root", "bucket", "items", "first", "line", "kept", "score", "label", "token", "h1", "copy"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} string" for x in CLASHING)
LABELS = "doc_id long, quality int, toxic int"

OPERATORS = {
    "op1": quality.judge,
    "op2": lambda docs, _: line_dedup.line_report(docs),
    "op3": lambda docs, _: near_dup.classes(docs),
    "op4": lambda docs, _: weak_labels.classify(docs),
    "op5": toxicity.score,
    "op6": lambda docs, _: media.media_columns(docs),
    "op8": lambda docs, _: passages.passages(docs),
    "op9": lambda docs, _: mixing.plan(docs),
    "op10": lambda docs, _: language.identify(docs),
}


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], SCHEMA)


def documents():
    """Two long texts share a passage of 3 000 words; a text of 60 000 words has one line, another 20 000 lines."""
    draw = random.Random(21)
    passage = prose(draw, 3000)
    texts = [None, "", " \n\t", "é", prose(draw, 60_000) + " " + passage, passage + "\n" + "\n".join(prose(draw, 3) for _ in range(20_000)), prose(draw, 40), prose(draw, 40)]
    return [(i, x, ["en", "fr"][i % 2] if i else None, None if i == 3 else "s") for i, x in enumerate(texts)]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_repeated_rows(spark, name):
    """Each row is given twice: its two results are equal (where a result doesn't depend on a row's place), and as many as rows."""
    rows = documents()
    marks = spark.createDataFrame([(i, i % 2, i // 2 % 2) for i in range(8)], LABELS)
    got = OPERATORS[name](table(spark, rows * 2).repartition(3), marks).collect()
    if name == "op8":
        spans = {r["doc_id"] for r in got}
        assert {4, 5} <= spans and not spans & {0, 1, 2, 3}
        return
    assert sorted(r["doc_id"] for r in got) == sorted([i for i, *_ in rows] * 2)
    if name != "op9":
        assert all(len({str(r) for r in got if r["doc_id"] == i}) == 1 for i, *_ in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(spark, name):
    assert OPERATORS[name](table(spark, []), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("cut", [line_dedup.deduped, near_dup.deduped, passages.without_later, mixing.mixed])
def test_clashing_columns_stay_as_they_were(spark, cut):
    docs = table(spark, [(i, f"{i} {'a b c d e f g h ' * (i + 1)}", "en", "s") for i in range(6)])
    out = cut(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert {x for r in out.collect() for x in r[4:]} == {"x"}
