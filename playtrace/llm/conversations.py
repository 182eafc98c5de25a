"""Conversation repair: error-correcting Earley parsing of each conversation's roles.

A conversation should be nothing, or an optional system turn and then pairs of a user and an assistant turn. The grammar gives
each edit a production and a cost (k keeps a row with that initial, r keeps it under another role, d deletes it, i inserts):

    Start -> Pairs            Lead -> nothing | Lead d            System -> Lead k(s) | System d
    Pairs -> Lead | User k(a) | User r | User i | Pairs d         User -> (Pairs | System) (k(u) | r | i) | User d

Chart items keep the minimum (cost, audit) of their span, and the completed chart yields the repair. The grammar is left-linear,
so every item begins in column 0, a column follows from the one before it, and what all items have in common is settled.

Each conversation's rows are ordered by turn (nulls first), role and the text's MD5. One shuffle brings a conversation's faults, a
character for each row, to the parser; another streams the texts past the found edits. Neither holds a conversation's texts
in memory; its rows' kinds and edits, a byte each, are held. The digest of one conversation is a chain over its rows,
so one task streams them.

Defined results: nulls count as one space, a null conversation is one of its own; repeated rows are rows (the later is a
duplicate); a conversation without rows after damage has zeros, an empty audit and the hash of the empty string; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SPACES = r"[\x20\x09-\x0D]"
#: Costs of the edits, and of each truncated row that stays. Fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row's character: its role's initial (x for others), upper case if truncated; d must be deleted.
KINDS = "usaxUSAXd"

#: Productions: left side, right side. Small letters are terminals: u, a and s keep a row with that initial, r reroles, d deletes, i inserts.
RULES = (
    ("Start", ("Pairs",)), ("Lead", ()), ("Lead", ("Lead", "d")), ("System", ("Lead", "s")), ("System", ("System", "d")), ("Pairs", ("Lead",)), ("Pairs", ("User", "a")), ("Pairs", ("User", "r")), ("Pairs", ("User", "i")), ("Pairs", ("Pairs", "d")),
    ("User", ("Pairs", "u")), ("User", ("Pairs", "r")), ("User", ("Pairs", "i")), ("User", ("System", "u")), ("User", ("System", "r")), ("User", ("System", "i")), ("User", ("User", "d")),
)
_LEFT = [left for left, _ in RULES]
#: Column 0 predicts every production; those that wait there for each symbol.
_WAITING = {name: [n for n, (_, right) in enumerate(RULES) if right[:1] == (name,)] for name in set(_LEFT)}
_LETTER = {"u": "K", "a": "K", "s": "K", "r": "R", "d": "D", "i": "I"}
#: Rows after which the common beginning of all audits is set aside.
SETTLE = 256


def _cost(terminal: str, kind: str) -> int | None:
    """What reading a row of ``kind`` as a terminal costs; None if it can't be."""
    if terminal == "d":
        return DELETE
    if kind == "d" or terminal not in ("r", kind.lower()):
        return None
    return (REROLE if terminal == "r" else 0) + (TRUNCATED if kind.isupper() else 0)


#: For each kind of row: (production, cost, letter) of the terminals that can read it.
_READS = {kind: {n: (c, _LETTER[right[-1]]) for n, (_, right) in enumerate(RULES) if right[-1:] and right[-1] in "uasrd" and (c := _cost(right[-1], kind)) is not None} for kind in KINDS}
_INSERTS = frozenset(n for n, (_, right) in enumerate(RULES) if right[-1:] == ("i",))


def _column(agenda: list) -> dict:
    """The items of a column, (production, dot) to their least (cost, audit), from those that reach it.

    The cheapest item is taken first, so that its first value is final: completing costs nothing and an insertion does.
    """
    items: dict[tuple[int, int], tuple[int, str]] = {}
    heapify(agenda)
    while agenda:
        cost, audit, rule, dot = heappop(agenda)
        if (rule, dot) in items:
            continue
        items[rule, dot] = (cost, audit)
        if dot < len(RULES[rule][1]):
            if rule in _INSERTS:
                heappush(agenda, (cost + INSERT, audit + "I", rule, dot + 1))
            continue
        for other in _WAITING[_LEFT[rule]]:
            if (other, 1) not in items:
                heappush(agenda, (cost, audit, other, 1))
    return items


def chart(kinds: str) -> tuple[int, str]:
    """The least (cost, audit) of a completed parse of rows of these kinds, the audit least in ASCII order among equals."""
    settled, spent = [], 0
    items = _column([(0, "", 1, 0)])  # Lead -> nothing
    for k, kind in enumerate(kinds):
        reads = _READS[kind]
        items = _column([(cost + reads[rule][0], audit + reads[rule][1], rule, 2) for (rule, dot), (cost, audit) in items.items() if dot == 1 and rule in reads])
        if k % SETTLE == SETTLE - 1:
            known = commonprefix([audit for _, audit in items.values()])
            least = min(cost for cost, _ in items.values())
            settled.append(known)
            spent += least
            items = {item: (cost - least, audit[len(known) :]) for item, (cost, audit) in items.items()}
    cost, audit = items[0, 1]
    return spent + cost, "".join(settled) + audit


cached = lru_cache(1 << 16)(chart)


def parse(kinds: str) -> tuple[int, str]:
    """``chart``, remembered for short conversations."""
    return cached(kinds) if len(kinds) <= 64 else chart(kinds)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) that the edits make of ``rows``."""
    turn = 0  # 0: a user turn is next (a system turn only as the first), 1: an assistant turn
    first = True
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K" and first and role[:1] == "s":
            yield role, text
        else:
            yield (role if edit == "K" else ("user", "assistant")[turn]), text
            turn ^= 1
        first = False


def spaced(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def rows_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy, there) with nulls as one space; ``there`` is true."""
    return conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), F.lit(0).alias("copy"), F.lit(True).alias("there"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as ``rows_of`` gives them, some broken by a checksum of conversation and turn. A dropped row stays with ``there`` false."""
    code = F.pmod(F.crc32(F.concat(spaced("conv"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    made = rows.withColumn("code", code)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = made.withColumn("text", text).withColumn("role", F.when(F.col("code") == 4, "user").otherwise(F.col("role"))).withColumn("there", F.col("code") != 0)
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return made.select("conv", "turn", "role", "text", copies.alias("copy"), "there")


#: How a conversation's rows are ordered.
ORDER = ["turn", "role", "digest", "copy"]


def faults(rows: DataFrame) -> DataFrame:
    """Rows without their texts but with the text's digest and the row's first fault: blank, duplicate, truncated or null."""
    solid = F.regexp_replace("text", SPACES, "")
    narrow = rows.select("conv", "turn", "role", "copy", "there", F.md5(F.col("text").cast("binary")).alias("digest"), (solid == "").alias("blank"), (~solid.rlike(r"[.!?]\z")).alias("cut"))
    # equal rows of a conversation meet by their text, so that a long conversation spreads
    again = F.row_number().over(Window.partitionBy("conv", "role", "digest", "there").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when(~F.col("there"), None).when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated")
    return narrow.select("conv", *ORDER, "there", fault.alias("fault"))


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arranged(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.asc_nulls_first("turn"), *ORDER[1:])


class _Count:
    """What is counted over the rows of one conversation as they pass."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.kinds: list[str] = []
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.before = ""

    def see(self, turn: int | None, role: str, fault: str | None) -> None:
        if fault:
            self.faults[fault] += 1
        initial = role[:1] if role[:1] in ("u", "s", "a") else "x"
        self.illegal += bool(self.before) and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.kinds.append("d" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial)
        if turn is not None:
            self.turns += turn != self.last
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn

    def row(self) -> dict:
        cost, audit = parse("".join(self.kinds))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": audit}


def summaries(found: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) from rows with their faults."""
    kind = found.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, count, out = None, None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for conv, turn, role, there, fault in zip(*columns, strict=True):
                if count is None or conv != here:
                    if count is not None:
                        out.append({"conv": here, **count.row()})
                    here, count = conv, _Count()
                if there:
                    count.see(turn, role, fault)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if count is not None:
            out.append({"conv": here, **count.row()})
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv", to_arrow_type(found.schema["conv"].dataType)), *[(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _SUMMARY.split(", ")]])
    return _arranged(found).select("conv", "turn", "role", "there", "fault").mapInArrow(run, f"conv {kind}, {_SUMMARY}")


def applied(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` with repaired_sha256, the digest of each conversation's repaired ``role:text`` lines, which are streamed past its audit."""
    own = [c.split()[0] for c in _SUMMARY.split(", ")]
    texts = rows.filter("there").select("conv", F.lit(1).alias("head"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "copy", "text", *[F.lit(None).cast(edits.schema[c].dataType).alias(c) for c in own])
    heads = edits.select("conv", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(0).alias("copy"), F.lit("").alias("text"), *own)
    schema = pa.schema([("conv", to_arrow_type(rows.schema["conv"].dataType)), *[(c, to_arrow_type(edits.schema[c].dataType)) for c in own], ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True))
        out, head = [], next(stream, None)
        while head is not None:
            after = []

            def its_rows(after=after):
                for row in stream:
                    if row[1] == 0:
                        after.append(row)
                        return
                    yield row[2], row[3]

            digest, lines, rows_left = hashlib.sha256(), 0, its_rows()
            for role, text in repaired(head[-1], rows_left):
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
            if next(rows_left, None) is not None:
                raise ValueError("a conversation has more rows than its edits")
            out.append((head[0], *head[4:], digest.hexdigest()))
            head = after[0] if after else None
            if len(out) >= 1000 or head is None:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []

    made = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edits.schema)
    return _arranged(texts.unionByName(heads), "head").select("conv", "head", "role", "text", *own).mapInArrow(run, f"{made}, repaired_sha256 string")


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    With ``damage`` the rows are broken first, as ``damaged`` says.
    """
    rows = rows_of(conversations, conv, turn, role, text)
    rows = damaged(rows) if damage else rows
    return applied(rows, summaries(faults(rows))).withColumnRenamed("conv", conv)


#: ``repair`` with damage over the table conversations.
ORACLE = """
WITH RECURSIVE polynomial AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS rest
), plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations
), coded AS (
  SELECT plain.*, xor(list_reduce([4294967295] || list_transform(string_split(place, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM plain, polynomial
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE code <> 0
), ordered AS (
  SELECT *, row_number() OVER line AS i, lag(left(role, 1)) OVER line || left(role, 1) AS step, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS solid,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged WINDOW line AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)
), faulty AS (
  SELECT *, left(role, 1) AS z, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM ordered
), items AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': ''} AS l, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS s, {'c': 2, 'a': 'I'} AS u, {'c': 0, 'a': ''} AS p FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, i, l, s, u, list_min([p, {'c': u.c + 2, 'a': u.a || 'I'}]) FROM (
    SELECT conv_id, i, l, s, p, list_min([u, {'c': p.c + 2, 'a': p.a || 'I'}, CASE WHEN s IS NOT NULL THEN {'c': s.c + 2, 'a': s.a || 'I'} END]) AS u FROM (
      SELECT x.conv_id, f.i, {'c': l.c + 3, 'a': l.a || 'D'} AS l,
        list_min([CASE WHEN free AND z = 's' THEN {'c': l.c + t, 'a': l.a || 'K'} END, CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'D'} END]) AS s,
        list_min([CASE WHEN free AND z = 'u' THEN {'c': p.c + t, 'a': p.a || 'K'} END, CASE WHEN free AND z = 'u' AND s IS NOT NULL THEN {'c': s.c + t, 'a': s.a || 'K'} END, CASE WHEN free THEN {'c': p.c + t + 2, 'a': p.a || 'R'} END,
          CASE WHEN free AND s IS NOT NULL THEN {'c': s.c + t + 2, 'a': s.a || 'R'} END, {'c': u.c + 3, 'a': u.a || 'D'}]) AS u,
        list_min([CASE WHEN free AND z = 'a' THEN {'c': u.c + t, 'a': u.a || 'K'} END, CASE WHEN free THEN {'c': u.c + t + 2, 'a': u.a || 'R'} END, {'c': p.c + 3, 'a': p.a || 'D'}]) AS p
      FROM items AS x JOIN (SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM faulty) AS f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1
    )
  )
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id
), ended AS (
  SELECT sums.*, p.c AS cost, p.a AS audit FROM sums JOIN items ON items.conv_id IS NOT DISTINCT FROM sums.conv_id AND items.i = n
), edits AS (
  SELECT conv_id, spot, edit, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS j
  FROM (SELECT conv_id, generate_subscripts(string_split(audit, ''), 1) AS spot, unnest(string_split(audit, '')) AS edit FROM ended) WINDOW w AS (PARTITION BY conv_id ORDER BY spot)
), turns AS (
  SELECT e.conv_id, e.spot, e.j, CASE WHEN e.edit = 'K' THEN f.role END AS kept, CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS text, max(CASE WHEN e.j = 1 AND e.edit = 'K' AND f.z = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits AS e LEFT JOIN faulty AS f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e.edit <> 'D'
), hashed AS (
  SELECT conv_id, sha256(string_agg(coalesce(kept, CASE WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY spot)) AS digest FROM turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed ON hashed.conv_id IS NOT DISTINCT FROM o.conv_id
"""
