"""Byte-level BPE against the library on whole texts, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest

from playtrace.llm import bpe

ALPHABET = [
    "a", "Z", "é", "ß", "ж", "漢", "字", "か", "。", "、", "1", "9", "٣", "'", "'s", "'ll", "!", "#", "~", "_", " ", "  ", "\n", "\t", " ", "　", " ", "\x1c", "​", "🎉", "👍🏽", "ﬁ", "́", "ह", "ि", "Ⅷ", "½", " the", "<|endoftext|>",
]


def whole(text):
    return bpe.codec().encoding.encode_ordinary(text)


def test_cut_texts_have_the_ids_of_whole_texts():
    r = random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 24)))
        for piece, run in ((1, 2), (2, 2), (3, 5), (7, 3)):
            assert "".join(x for x, _ in bpe.pieces(text, piece, run)) == text
            assert bpe.codec().encode(text, piece, run).tolist() == whole(text), (text, piece, run)


def test_each_character_beside_every_safe_place():
    for point in [*range(1, 0x3400), *range(0xA000, 0xD800, 7), *range(0xF900, 0x11000), *range(0x1F300, 0x1FA00, 3)]:
        x = chr(point)
        text = f"a{x}1{x} x{x}!{x}漢{x}。{x}"
        assert bpe.codec().encode(text, 1, 2).tolist() == whole(text), hex(point)


def test_runs_that_the_library_cannot_take():
    text = " " * 1_200_000 + "x" + "a" * 300_000 + "漢字" * 60_000 + "\n" * 20_000
    ids = bpe.codec().encode(text)
    assert bpe.codec().decode(ids) == text.encode()
    assert bpe.codec().encode(" " * 5000 + "x" + "\n" * 5000).tolist() == whole(" " * 5000 + "x" + "\n" * 5000)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(6)
    return [None, "", " ", "plain words", "same", "same", *["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 3000))) for _ in range(40)], "ab " * 120_000]


def test_digests(spark, texts):
    docs = spark.createDataFrame([(i, x, 1, b"y") for i, x in enumerate(texts)], "doc_id long, text string, n_tokens int, ids binary").repartition(3)
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array(whole(text or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_decoding_written_ids(spark, texts):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    back = bpe.decoded(bpe.encoded(docs)).collect()
    assert {r.doc_id: bytes(r.bytes) for r in back} == {i: (x or "").encode() for i, x in enumerate(texts)}
    half = spark.createDataFrame([(1, np.array(whole("漢")[:1], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decoded(half).collect()} == {1: bpe.codec().decode(np.array(whole("漢")[:1])), 2: b""}


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing_has_the_ids_of_the_other_library():
    """Packing takes its ids from the ranks where a text has no special token; they are those of its vocabulary file."""
    from playtrace.llm import packing

    held, r = packing.encoder(), random.Random(9)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [f"a{chr(p)}b {chr(p)}1{chr(p)} {chr(p)}{chr(p)}!{chr(p)}" for p in [*range(1, 0x3400), *range(0xA000, 0xD800, 11), *range(0xF900, 0x11000), *range(0x1F300, 0x1FA00, 3)]]
    for text in texts:
        assert held.ids(text) == held.exact.encode(text, add_special_tokens=False).ids, text
