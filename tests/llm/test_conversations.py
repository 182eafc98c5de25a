"""Conversation repair against plain enumeration, and its edge cases."""

import hashlib
import itertools
import random

import pytest

from playtrace.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(kinds):
    """The least (cost, audit) of all edit strings with at most two inserts in a row."""
    best = [(10**9, "")]

    def go(i, state, cost, audit, inserts):
        if cost > best[0][0]:
            return
        if i == len(kinds) and state in ("start", "answer"):
            best[0] = min(best[0], (cost, audit))
        if inserts < 2:
            go(i, "answer" if state == "user" else "user", cost + 2, audit + "I", inserts + 1)
        if i < len(kinds):
            kind, extra = kinds[i].lower(), int(kinds[i].isupper())
            go(i + 1, state, cost + 3, audit + "D", 0)
            if kind != "d":
                if kind in {"start": "us", "system": "u", "user": "a", "answer": "u"}[state]:
                    go(i + 1, {"s": "system", "u": "user", "a": "answer"}[kind], cost + extra, audit + "K", 0)
                go(i + 1, "answer" if state == "user" else "user", cost + 2 + extra, audit + "R", 0)

    go(0, "start", 0, "", 0)
    return best[0]


def test_chart_equals_enumeration():
    for n in range(4):
        for kinds in itertools.product(c.KINDS, repeat=n):
            assert c.chart("".join(kinds)) == cheapest("".join(kinds))
    r = random.Random(3)
    for _ in range(150):
        kinds = "".join(r.choice(c.KINDS) for _ in range(r.randint(4, 7)))
        assert c.chart(kinds) == cheapest(kinds)


def test_long_conversations_settle():
    r = random.Random(4)
    kinds = "".join(r.choice("uauauaxUAd") for _ in range(3000))
    cost, audit = c.chart(kinds)
    assert len(audit.replace("I", "")) == 3000
    assert cost == 3 * audit.count("D") + 2 * (audit.count("R") + audit.count("I")) + sum(k.isupper() for k, e in zip(kinds, audit.replace("I", ""), strict=True) if e != "D")
    whole, c.SETTLE = c.SETTLE, 10**9
    assert c.chart(kinds) == (cost, audit)
    c.SETTLE = whole


def repaired(spark, rows, **more):
    return {r.conv_id: r for r in c.repair(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_repairs(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."),  # sound
        (2, 0, "assistant", "Odd start."), (2, 1, "assistant", "Then this."),
        (3, 0, "user", "One?"), (3, 4, "user", "One?"), (3, 5, "assistant", "\t \n"), (3, 6, "assistant", "cut off"),
        (None, None, None, None), (4, None, "user", "No turn."), (4, 2, "tool", "An answer."),
    ]
    got = repaired(spark, rows)
    assert (got[1].cost, got[1].audit, got[1].illegal, got[1].repaired_sha256) == (0, "KKK", 0, sha("system:Be brief.\nuser:Hi!\nassistant:Hello."))
    assert (got[2].cost, got[2].audit, got[2].repaired_sha256) == (2, "RK", sha("user:Odd start.\nassistant:Then this."))
    assert (got[3].gaps, got[3].duplicate, got[3].blank, got[3].truncated, got[3].illegal) == (3, 1, 1, 1, 2)
    assert (got[3].cost, got[3].audit, got[3].repaired_sha256) == (7, "KDDK", sha("user:One?\nassistant:cut off"))
    assert (got[None].blank, got[None].gaps, got[None].cost, got[None].audit, got[None].repaired_sha256) == (1, 0, 3, "D", sha(""))
    assert (got[4].cost, got[4].audit, got[4].gaps, got[4].repaired_sha256) == (2, "KR", 0, sha("user:No turn.\nassistant:An answer."))


def test_repeated_rows_and_one_long_conversation(spark):
    long = [(9, i, ("user", "assistant")[i % 2], f"Turn {i}. " + "x" * 50 + ".") for i in range(2500)]
    got = repaired(spark, [(8, 0, "user", "Again.")] * 3 + [(8, 1, "assistant", "Yes.")] + long)
    assert (got[8].duplicate, got[8].audit, got[8].repaired_sha256) == (2, "KDDK", sha("user:Again.\nassistant:Yes."))
    assert (got[9].cost, got[9].audit, got[9].repaired_sha256) == (0, "K" * 2500, sha("\n".join(f"{r}:{t}" for _, _, r, t in long)))


def test_damage_returns_every_conversation(spark):
    rows = [(i, 0, "user", "Hi.") for i in range(200)]
    got = repaired(spark, rows, damage=True)
    assert set(got) == set(range(200))
    gone = [x for x in got.values() if x.audit == ""]
    assert gone and all((x.cost, x.gaps, x.blank, x.repaired_sha256) == (0, 0, 0, sha("")) for x in gone)
    assert {x.audit for x in got.values()} >= {"", "D", "KI"}


@pytest.mark.parametrize("damage", [True, False])
def test_empty_table_and_clashing_names(spark, damage):
    empty = spark.createDataFrame([], SCHEMA + ", conv long, head int, audit string, `copy` int, there int, digest int, code int")
    assert c.repair(empty, damage=damage).collect() == []
    row = spark.createDataFrame([(5, 1, "user", "Hi.", 1, 2, "x", 3, 4, 5, 6)], empty.schema)
    assert c.repair(row).collect()[0].audit == "KI"
