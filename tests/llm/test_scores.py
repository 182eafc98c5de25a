import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from playtrace.llm import crf, language, media, packing, quality, toxicity, weak_labels

SCHEMA = "doc_id long, text string, lang string, source string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n ", "#", "é" * 40, "a " * 50_000, "x\n\ny\nx"]


def table(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, x, y, "s", "k") for i, (x, y) in enumerate(zip(texts, langs, strict=True))], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def prose(draw, n, letters="abcdefgh"):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 8))) for _ in range(n)).capitalize() + "."


# the chain


def paths(chain, scores):
    for path in itertools.product((0, 1), repeat=len(scores)):
        yield path, chain.begin[path[0]] + sum(scores[i][y] for i, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in itertools.pairwise(path))


def test_chain_equals_enumeration():
    draw = np.random.default_rng(1)
    chain = crf.Chain(np.zeros((1, 2)), draw.normal(size=(2, 2)), draw.normal(size=2))
    lengths = np.array([3, 1, 6, 4])
    scores = draw.normal(size=(14, 2))
    p, _ = crf.marginals(chain, scores, lengths)
    best = crf.viterbi(chain, scores, lengths)
    for first, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        every = list(paths(chain, scores[first : first + n]))
        weight = np.exp([s for _, s in every])
        for i in range(n):
            assert p[first + i, 1] == pytest.approx(sum(w for (y, _), w in zip(every, weight, strict=True) if y[i]) / weight.sum())
        assert tuple(best[first : first + n]) == max(every, key=lambda x: x[1])[0]


# quality rules


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_base_rules_equal_plain_python(spark):
    draw = random.Random(2)
    texts = ODD + ["\n".join(draw.choice(["a b c", "d e f g h i j k l", "# $ %", "é ü", ""]) for _ in range(draw.randrange(30))) for _ in range(60)]
    got = {r["doc_id"]: r for r in quality.judge(table(spark, texts), labels(spark, [])).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, want = got[i], base_rules(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_field_learns_boilerplate(spark):
    draw = random.Random(4)
    good = ["\n".join(prose(draw, 12) for _ in range(6)) for _ in range(60)]
    bad = ["\n".join("CLICK | HERE $$$ *** BUY NOW" for _ in range(draw.randrange(1, 3))) + "\n" + "\n".join(f"### {prose(draw, 3).upper()} | $ {i} %%" for i in range(9)) for _ in range(60)]
    docs = table(spark, good + bad)
    marks = labels(spark, [(i, int(i < 60), 0) for i in range(0, 120, 2)])
    kept = {r["doc_id"] for r in quality.judge(docs, marks).filter("kept").collect()}
    assert kept == set(range(60))
    assert {r["doc_id"] for r in quality.keep(docs, marks).collect()} == kept
    assert quality.keep(docs, marks).columns == docs.columns


# quality classifier


def test_weak_labels_part_good_from_bad(spark):
    draw = random.Random(6)
    good = ["\n".join(prose(draw, 30) for _ in range(4)) for _ in range(80)]
    bad = ["$$ ## BUY NOW !!! " * draw.randrange(3, 30) for _ in range(40)]
    rows = weak_labels.classify(table(spark, good + bad + ODD)).collect()
    assert len(rows) == 120 + len(ODD)
    score = {r["doc_id"]: r for r in rows}
    assert all(score[i]["kept"] for i in range(80)) and not any(score[i]["kept"] for i in range(80, 120))
    assert not score[120]["kept"] and not score[121]["kept"]


def test_estimate_finds_the_accurate_voters():
    draw = np.random.default_rng(8)
    k = len(weak_labels.HEURISTICS)
    truth = draw.random(5000) < 0.7
    right = np.linspace(0.95, 0.6, k)
    votes = np.where(draw.random((5000, k)) < right, np.where(truth, 1, 2)[:, None], np.where(truth, 2, 1)[:, None])
    patterns = votes @ (3 ** np.arange(k))
    tables, good, prior = weak_labels.estimate(dict(Counter(patterns.tolist())))
    assert np.abs(tables[1, :, 1] - right).max() < 0.05
    assert abs(prior - 0.7) < 0.03
    assert np.mean([(good[int(x)] > 0.5) == t for x, t in zip(patterns, truth, strict=True)]) > 0.95


# toxicity


def test_toxic_words_score_high_and_are_tagged(spark):
    draw = random.Random(10)
    texts, marks = [], []
    for i in range(600):
        words = prose(draw, 30).split()
        toxic = i % 3 == 0
        if toxic:
            words[draw.randrange(30)] = draw.choice(["zorgvile", "murkfoul", "grimslag"])
        texts.append(" ".join(words))
        marks.append((i, 1, int(toxic)))
    rows = toxicity.score(table(spark, texts + ODD), labels(spark, marks)).collect()
    assert len(rows) == 600 + len(ODD)
    for r in rows:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if i < 600:
            assert r["predicted"] == int(i % 3 == 0)
            raw = texts[i].encode()
            found = {raw[x["start"] : x["start"] + x["length"]].decode() for x in r["offsets"]}
            assert bool(found & {"zorgvile", "murkfoul", "grimslag"}) == (i % 3 == 0)
        else:
            assert r["predicted"] == 0


def test_toxicity_without_labels(spark):
    assert {r["score"] for r in toxicity.score(table(spark, ["a b", None]), labels(spark, [])).collect()} == {0.0}


# media


@pytest.mark.parametrize("form", ["bmp", "netpbm"])
def test_media_round_trip(spark, form):
    texts = [*ODD, "x" * 575, "x" * 576, "x" * 577, "x" * 576]
    rows = {r["doc_id"]: r for r in media.media_columns(table(spark, texts), form=form, keep=("media", "tile")).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        raw, r = (text or "").encode(), rows[i]
        payload = media.padded(raw)
        assert len(payload) % 576 == 0 and payload and payload.rstrip(b"\xff") == raw.rstrip(b"\xff")
        assert media.decode(bytes(r["media"])).tobytes() == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
    assert rows[len(ODD) + 1]["feature"] == rows[len(ODD) + 3]["feature"]


def test_area_resize_equals_weighted_means():
    pixels = np.random.default_rng(3).integers(0, 256, (13, 24), dtype=np.uint8)
    fine = np.kron(pixels, np.ones((8, 9)))  # cells of the target are whole there
    want = fine.reshape(8, 13, 9, 24).mean((1, 3))
    assert np.allclose(media.area_resize(pixels), want)


# packing


def test_pieces_rebuild_every_document(spark):
    draw = random.Random(12)
    texts = [*ODD[:5], *(prose(draw, draw.randrange(1, 900)) for _ in range(40)), "<|endoftext|> x", "x" * 9000]
    docs = table(spark, texts).repartition(5)
    pieces = packing.pack(docs).collect()
    held = packing.encoder()
    for i, text in enumerate(texts):
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        ids = np.array([*held.exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(bytes(p["ids"]) for p in own) == ids.tobytes()
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and p["length"] * 4 == len(p["ids"]) for p in own)
        assert [p["start"] for p in own] == [int(x) for x in np.cumsum([0, *(p["length"] for p in own)])[:-1]]
    by_sequence = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == by_sequence.get(p["sequence_id"], 0)
        by_sequence[p["sequence_id"]] = p["offset"] + p["length"]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(n == 1024 for s, n in by_sequence.items() if s < len(by_sequence) - 1) and max(by_sequence.values()) <= 1024


def test_repeated_and_no_documents(spark):
    docs = table(spark, ["a b"]).select("*")
    assert packing.pack(docs.union(docs)).count() == 2
    assert packing.pack(table(spark, [])).count() == 0


# language


def test_languages_by_held_out_accuracy(spark):
    draw = random.Random(14)
    letters = {"en": "abcdefgh", "fr": "éàabcdei", "xx": "mnopqrst"}
    langs = [list(letters)[i % 3] for i in range(300)]
    texts = [prose(draw, 25, letters[x]) for x in langs]
    odd = [None, "", "12 #!", "é"]
    rows = {r["doc_id"]: r for r in language.identify(table(spark, texts + odd, langs + [None, "en", "en", None])).collect()}
    assert len(rows) == 304
    for i, x in enumerate(langs):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= rows[i]["score"] <= 1
    held = [i for i in range(300) if rows[i]["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == langs[i] for i in held]) > 0.97
    assert [rows[300 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and rows[303]["lang_pred"] in letters


def test_presence_kernel_equals_sets():
    texts = ["abcab", "bca", ""]
    raw = [x.encode() for x in texts]
    bounds = np.cumsum([0, *(len(x) for x in raw)])
    seen = language.presence(np.frombuffer(b"".join(raw), np.uint8), bounds)
    grams = [{x[i : i + k] for k in (1, 2, 3) for i in range(len(x) - k + 1)} for x in texts]
    assert [[int((seen[i] & seen[j]).sum()) for j in range(3)] for i in range(3)] == [[len(a & b) for b in grams] for a in grams]


def test_nothing_to_learn_from(spark):
    assert {r["lang_pred"] for r in language.identify(table(spark, ["a", "b"], [None, None])).collect()} == {"und"}
    assert language.identify(table(spark, [])).count() == 0


def test_samples_never_vanish_and_do_not_depend_on_partitions(spark):
    from playtrace.llm import sampling

    assert sampling.share(5 * 10**10, 2000) * 5 * 10**10 == pytest.approx(5000)
    rows = spark.range(20_000).selectExpr("id % 9000 AS doc_id", "concat('t', id) AS text")
    picks = [[tuple(r) for r in sampling.spread(rows.repartition(n), "doc_id", 50).collect()] for n in (1, 7)]
    assert picks[0] == picks[1] and len({k for k, _ in picks[0]}) == 50


def test_difference_hash_equals_plain_loops():
    rng = np.random.default_rng(2)
    tile = rng.integers(0, 256, (8, 9)).astype(np.uint8)
    bits = "".join(str(int(tile[y, x + 1] > tile[y, x])) for y in range(8) for x in range(8))
    assert media.difference_hash(media.read_npy(media.npy_bytes(tile))) == f"{int(bits, 2):016x}"
