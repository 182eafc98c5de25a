import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playtrace import shared
from playtrace.llm import line_dedup, near_dup, passages, textops

SCHEMA = "doc_id long, text string, root string, n int"


def table(spark, texts):
    return spark.createDataFrame([(i, x, "r", 1) for i, x in enumerate(texts)], SCHEMA)


def bag(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def variants(seed=3, n_texts=12, n_copies=6):
    """Texts with near copies of growing distance; similarities on both sides of 0.8."""
    draw = random.Random(seed)
    out = []
    for _ in range(n_texts):
        base = [f"w{draw.randrange(4000)}" for _ in range(150)]
        for k in range(n_copies):
            copy = list(base)
            for _ in range(k):
                copy[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("slices", [{}, {"PAIR_SLICE": 1, "BUCKET_SLICE": 1, "SALTS": 2}, {"PAIR_SLICE": 3, "BUCKET_SLICE": 2, "ROUNDS": 0}])
def test_near_classes_equal_brute_force(spark, monkeypatch, slices):
    """Also with texts and buckets dealt to many slices."""
    for name, value in slices.items():
        monkeypatch.setattr(near_dup, name, value)
    texts = [*variants(), "same text", "same text", "", "", None, None, "a b", "a b c d e", "#! ?"]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(table(spark, texts)).collect()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(x) if x is not None else None for x in texts]
    for j, y in enumerate(bags):
        for i in range(j):
            if bags[i] is None or y is None:
                continue
            if texts[i] == texts[j] or (bags[i] and y and similarity(bags[i], y) >= 0.8):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("most", [1, 4, 100])
def test_pairs_meet_their_texts_once_however_hot_one_is(spark, monkeypatch, most):
    monkeypatch.setattr(near_dup, "PAIR_SLICE", most)
    name = lambda i: bytes([i])
    pairs = [(name(0), name(i)) for i in range(1, 30)] + [(name(i), name(40)) for i in range(1, 20)] + [(name(41), name(42)), (name(1), name(99))]
    texts = [(name(i), f"text {i}") for i in range(60)]
    got = near_dup.with_texts(spark.createDataFrame(pairs, "a binary, b binary"), spark.createDataFrame(texts, "node binary, text string")).collect()
    # the last pair has a node without a text
    assert sorted((bytes(r["a"]), bytes(r["b"]), r["text_a"], r["text_b"]) for r in got) == sorted((a, b, f"text {a[0]}", f"text {b[0]}") for a, b in pairs[:-1])


def signed(texts):
    words = textops.words_of(pa.array(texts, pa.string()))
    return near_dup.signatures(words.n_texts, *near_dup.bag(words, words.hashes()))


def test_signature_is_the_same_in_every_slice():
    draw = random.Random(4)
    body = lambda n: " ".join(f"s{draw.randrange(3000)}" for _ in range(n))
    texts = [body(n) for n in (5, 24, 30, 40, 54, 54, 90, 200)] + ["again and " * 40]
    alone = np.concatenate([signed([x]) for x in texts])
    for extra in ([], [body(300) for _ in range(8)], [body(2000)], [body(12000), "x " * 5000], [body(40000)]):
        assert (signed([*texts, *extra])[: len(texts)] == alone).all()


def test_links_with_unlike_signatures_are_found(spark):
    """Pairs of similarity 89 / 111 of which 34 to 36 components differ in their two lowest bits."""
    texts = []
    for seed in (313, 606, 929):
        draw = random.Random(seed)
        base = [f"s{draw.randrange(10**6)}" for _ in range(104)]
        copy = list(base)
        for at in (30, 60, 103):
            copy[at] = f"x{draw.randrange(10**6)}"
        texts += [" ".join(base), " ".join(copy)]
        assert similarity(bag(texts[-2]), bag(texts[-1])) >= 0.8
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(table(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_one_of_each_class_stays(spark):
    texts = ["same text here"] * 3 + variants(n_texts=2, n_copies=2) + [None, None]
    docs = table(spark, texts)
    kept = near_dup.deduped(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 5, 7, 8]


@pytest.mark.parametrize("texts", [[], [None], ["", ""], ["x " * 30000] * 2])
def test_near_edge_tables(spark, texts):
    assert near_dup.classes(table(spark, texts)).count() == len(texts)


def lines_kept(texts):
    """Brute force: (doc_id, kept lines, links) with every pair of distinct word sets compared."""
    first, sets = {}, {}
    for i, text in enumerate(texts):
        for j, line in enumerate((text or "").split("\n")):
            words = frozenset(line.split())
            if words:
                first.setdefault(words, (i, j))
                sets[i, j] = words
    links = {w: [v for v in first if v != w and 9 * len(w & v) >= 4 * (len(w) + len(v))] for w in first}
    kept = {i: [] for i in range(len(texts))}
    counts = dict.fromkeys(kept, 0)
    for words, (i, j) in first.items():
        counts[i] += len(links[words])
        if all((i, j) < first[v] for v in links[words]):
            kept[i].append(j)
    return {i: (sorted(kept[i]), counts[i]) for i in kept}, sets


def some_lines(seed=5, n=60):
    draw = random.Random(seed)
    pool = [[f"t{draw.randrange(60)}" for _ in range(draw.randrange(1, 14))] for _ in range(25)]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(draw.randrange(0, 6)):
            line = list(draw.choice(pool))
            if line and draw.random() < 0.5:
                line[draw.randrange(len(line))] = f"t{draw.randrange(60)}"
            lines.append(" ".join(line))
        out.append("\n".join([*lines, *[""] * draw.randrange(2)]))
    return out


def test_line_report_equals_brute_force(spark):
    texts = [*some_lines(), None, "", " \n\t", "a b c d e\na b c d e f"]
    want, sets = lines_kept(texts)
    for r in line_dedup.line_report(table(spark, texts)).collect():
        i = r["doc_id"]
        assert (r["kept"], r["n_links"]) == want[i]
        assert r["n_lines"] == sum(k[0] == i for k in sets)
        assert r["n_removed"] == r["n_lines"] - len(r["kept"])


def test_deduped_cuts_lines_only(spark):
    texts = ["one two three\n\nfour five", "one two three\nsix seven", None, ""]
    docs = table(spark, texts)
    out = line_dedup.deduped(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: texts[0], 1: "six seven", 2: None, 3: ""}


def spans_of(texts, least=50):
    """Brute force: words of each text that lie in a run of ``least`` words found at two places."""
    places = {}
    words = [(x or "").split() for x in texts]
    for i, w in enumerate(words):
        for at in range(len(w) - least + 1):
            places.setdefault(tuple(w[at : at + least]), []).append((i, at))
    covered = {i: set() for i in range(len(texts))}
    for found in places.values():
        if len(found) > 1:
            for i, at in found:
                covered[i].update(range(at, at + least))
    return covered


def test_passages_equal_brute_force(spark):
    draw = random.Random(9)
    word = lambda: f"p{draw.randrange(5000)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 300)]
    texts = []
    for _ in range(40):
        body = [word() for _ in range(draw.randrange(0, 120))]
        if draw.random() < 0.7:
            at = draw.randrange(len(body) + 1)
            body[at:at] = draw.choice(shared)
        texts.append(" ".join(body))
    texts += [texts[0], None, "", " ".join(shared[3] * 2)]
    got = {i: set() for i in range(len(texts))}
    for r in passages.passages(table(spark, texts)).collect():
        got[r["doc_id"]].update(range(r["begin"], r["end"]))
    assert got == spans_of(texts)


def edited(seed, n_variants, n_edits, n_words=200):
    draw = random.Random(seed)
    base = [f"e{seed}-{i}" for i in range(n_words)]
    out = []
    for _ in range(n_variants):
        copy = list(base)
        for _ in range(n_edits):
            copy[draw.randrange(n_words)] = f"y{draw.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_passages_of_edited_variants_equal_brute_force(spark):
    """All repeated words, and those of them in runs of 50 words that an earlier place holds, or that no earlier one does."""
    texts = [*edited(1, 12, 1), *edited(2, 12, 2), *edited(3, 12, 4), " ".join(f"z{i % 70}" for i in range(260))]
    random.Random(2).shuffle(texts)
    places = {}
    for i, w in enumerate(x.split() for x in texts):
        for at in range(len(w) - 49):
            places.setdefault(tuple(w[at : at + 50]), []).append((i, at))
    want = {(i, x): set() for i in range(len(texts)) for x in (False, True)}
    for found in (x for x in places.values() if len(x) > 1):
        for i, at in found:
            want[i, (i, at) != min(found)].update(range(at, at + 50))
    got = {x: set() for x in want}
    for r in passages.passages(table(spark, texts)).collect():
        got[r["doc_id"], r["later"]].update(range(r["begin"], r["end"]))
    assert got == want


def test_a_part_in_an_earlier_document_makes_no_passage_later(spark):
    """Document k holds 40 words of a passage of 60 that documents 20 + k and 40 + k hold: the first of these keeps it."""
    passage = [[f"r{k}-{i}" for i in range(60)] for k in range(20)]
    texts = [" ".join(x[:40]) + f" a{k} b{k} " + " ".join(f"o{k}-{i}" for i in range(60)) for k, x in enumerate(passage)]
    texts += [" ".join(["head", str(n), *x, str(n), "tail"]) for n in (1, 2) for x in passage]
    out = {r["doc_id"]: r["text"].split() for r in passages.without_later(table(spark, texts)).collect()}
    for k in range(20):
        assert out[k] == texts[k].split() and out[20 + k] == texts[20 + k].split()
        assert out[40 + k] == ["head", "2", "2", "tail"]


def test_later_occurrences_go(spark):
    passage = " ".join(f"q{i}" for i in range(60))
    docs = table(spark, [f"{passage} a b", f"c {passage} d", "e f", None])
    out = {r["doc_id"]: r["text"] for r in passages.without_later(docs).collect()}
    assert out[0] == f"{passage} a b" and out[1].split() == ["c", "d"] and out[2] == "e f" and out[3] is None
    assert passages.without_later(docs).columns == docs.columns


@pytest.mark.parametrize("most_hot", [1, 4, 8192])
def test_deduped_equals_report(spark, monkeypatch, most_hot):
    """Also with the sets of a token dealt to cells: at 1 and 4 nearly all of them are."""
    monkeypatch.setattr(line_dedup, "MOST_HOT", most_hot)
    texts = [*some_lines(seed=11, n=80), None, ""]
    want = lines_kept(texts)[0]
    docs = table(spark, texts)
    kept = {r["doc_id"]: set(r["kept"]) for r in line_dedup.line_report(docs).collect()}
    assert kept == {i: set(x[0]) for i, x in want.items()}
    for r in line_dedup.deduped(docs).collect():
        text = texts[r["doc_id"]]
        want = None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if j in kept[r["doc_id"]] or not x.split())
        assert r["text"] == want


@pytest.mark.parametrize("bound", [{"HOT": 3, "CHUNK": 4}, {"MOST_HOT": 3, "CHUNK": 2, "CHUNKS": 5, "MOST_CHUNK": 4}])
def test_lines_that_share_hot_tokens_are_linked_in_blocks(spark, monkeypatch, bound):
    """A token is hot by the table's share of sets, and by MOST_HOT at any size of the table."""
    for name, value in bound.items():
        monkeypatch.setattr(line_dedup, name, value)
    base = [f"w{i}" for i in range(20)]
    texts = [" ".join(base[: j % 20] + [f"x{j}"] + base[j % 20 + 1 :]) for j in range(30)] + [" ".join(base), "a b c d", "a b c d e", "a b c d f"]
    sets = [frozenset(t.split()) for t in texts]
    links = {i: sum(len(a & b) * 9 >= (len(a) + len(b)) * 4 for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_links"], r["n_removed"]) for r in line_dedup.line_report(docs).collect()}
    assert got == {i: (links[i], int(any(len(sets[i] & b) * 9 >= (len(sets[i]) + len(b)) * 4 for b in sets[:i]))) for i in range(len(texts))}


def test_pairs_of_cells_are_the_pairs(spark, monkeypatch):
    """Each candidate pair of the plain join comes from exactly one cell."""
    monkeypatch.setattr(line_dedup, "MOST_HOT", 3)
    rows = line_dedup.keyed(table(spark, some_lines(seed=8, n=40)), "doc_id", "text")
    index = line_dedup.postings(line_dedup.sets(rows, line_dedup.rarity(rows, "text")[0], False))
    cells = line_dedup.celled(index, line_dedup.hot_tokens(index, 3))
    assert cells.count() > index.count()
    names = lambda x: sorted(map(tuple, line_dedup.candidates(x).collect()))
    assert names(cells) == names(index) != []


def test_parities_never_exceed_the_difference_of_two_multisets():
    rng = np.random.default_rng(5)
    for _ in range(50):
        bags = [rng.integers(0, 60, rng.integers(1, 300)) for _ in range(2)]
        parts = [np.unique(b, return_counts=True) for b in bags]
        text = np.concatenate([np.full(len(p[0]), j) for j, p in enumerate(parts)])
        element, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        bits = near_dup.parities(text, textops.mix(element.astype(np.uint64)), count, 2)
        counts = [np.bincount(b, minlength=60) for b in bags]
        assert sum(bin(int(x) & (2**64 - 1)).count("1") for x in bits[0] ^ bits[1]) <= np.abs(counts[0] - counts[1]).sum()


@pytest.mark.parametrize("text", ["a b", "  a  b ", "a\tb", "a\x0bb\x0cc\r", "\r", "", " ", "a\nb", "ä b c d", "\x1cb c", None])
def test_words_are_split_at_ascii_white_space_with_and_without_a_pattern(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(line_dedup.split_words(line_dedup.F.col("x"))).first()[0]
    want = None if text is None else [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    assert (got if got is None else [w for w in got if w]) == want


def family(n, seed=6, size=40):
    """Variants of one line, the line itself twice, and some lines that match a few of them or none."""
    draw = random.Random(seed)
    base = [f"v{i}" for i in range(size)]
    lines = [base, base]
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randrange(1, 6)):
            copy[draw.randrange(size)] = f"u{draw.randrange(30)}"
        lines.append(copy)
    return [" ".join(x) for x in [*lines, base[:34], base[4:], [*base[:20], *(f"o{i}" for i in range(20))], ["o1", "o2", "o3", "o4"]]]


@pytest.mark.parametrize("bound", [{}, {"FULL": 0}, {"CHUNK": 4}, {"HOT": 20}, {"FULL": 0, "MOST_HOT": 30, "CHUNK": 8}])
def test_links_within_a_family_are_counted_without_a_row_for_a_pair(spark, monkeypatch, bound):
    """Also with lengths dealt to bands, several chunks a group, and tokens of the family that are hot."""
    for name, value in bound.items():
        monkeypatch.setattr(line_dedup, name, value)
    rows, plain = {}, line_dedup.written

    def counting(df, name, *more):
        out = plain(df, name, *more)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", counting)
    texts = family(60)
    want = lines_kept(texts)[0]
    got = {r["doc_id"]: (r["kept"], r["n_links"]) for r in line_dedup.line_report(table(spark, texts)).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000 and rows["line-pairs"] < 100


def test_bands_and_the_search_for_one_partner_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FULL", 0)
    rows = line_dedup.keyed(table(spark, [*some_lines(seed=21, n=60), *family(12)]), "doc_id", "text")
    classes, most = line_dedup.rarity(rows, "text")
    index = line_dedup.postings(line_dedup.sets(rows, classes, False))
    bands = line_dedup.banded(index, most)
    assert bands.filter("low = 1").count() > 0
    pairs = sorted(map(tuple, line_dedup.candidates(index).collect()))
    assert sorted(map(tuple, line_dedup.candidates(bands).collect())) == pairs != []
    assert sorted(map(tuple, line_dedup.paired(bands).collect())) == sorted({x for p in pairs for x in (p[:2], p[2:])})


def test_tables_written_tidily_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    rows, before = spark.range(1000).groupBy(F.expr("id % 7").alias("x")).count(), shuffled()
    out = shared.written(rows, "tidy", tidy=True)
    assert shuffled() <= before
    assert out.count() == 7 and spark.conf.get(shared.TIDY, None) is None


@pytest.mark.parametrize("text", ["a\nb", "", "\n\n", "a\n\nb c\n", " \na", "a\n \nb", "a\n b", "a\r\n\r\nb", "\t\na", "ä\n\x0b", "\x1c\nb", None])
def test_lines_with_a_word_are_counted_with_and_without_a_pattern(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(line_dedup.worded(F.col("x"))).first()[0]
    assert got == (None if text is None else sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n")))


def test_counting_links_copies_and_joins_none(spark):
    sides = ", ".join(f"{s}_k long, {s}_sig long, {s}_place struct<id: long, th: long, line: int>" for s in "ab")
    links = spark.createDataFrame([(1, 1, (5, 0, 0), 2, 2, (7, 0, 1)), (3, 3, (6, 0, 0), 1, 1, (5, 0, 0))], sides)
    told = line_dedup.ended(line_dedup.told_ends(links))
    assert sorted((x["k"], x["earliest"]["id"], x["links"]) for x in told.collect()) == [(1, 6, 2), (2, 5, 1), (3, 5, 1)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_sets_are_made_of_tokens_that_are_never_null(spark):
    line = spark.createDataFrame([("b a  b",)], "body string")
    items = line.select(line_dedup.tokens(F.col("body"), F.split(F.lit("0,1"), ",").cast("array<bigint>")).alias("items"))
    assert not items.schema["items"].dataType.containsNull


def test_passages_leave_no_table_that_nothing_reads(spark):
    words = " ".join(f"w{i}" for i in range(80))
    found = passages.passages(table(spark, [words, f"{words} and more"]))
    assert found.count() == 2
    folder = found.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared.shared_folder(spark)}/tables/{spark.sparkContext.applicationId}")
    here = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    assert not [x.getPath().getName() for x in here if x.getPath().getName().startswith(("grams-", "runs-"))]
