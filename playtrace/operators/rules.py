"""User rules compiled to one filter. Values become literals, so no rule can change the query's shape.

Input rows have q_plays, plays, ms_played, skips, first_ts, last_ts, score, peak_year, artist, album, tags, favorite, retired.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.config import DAY_MS


class RuleError(ValueError):
    """A rule names a field that doesn't exist."""


@dataclass(frozen=True)
class Rule:
    field: str
    operator: str
    value: object
    value2: object = None


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _year(name: str, zone: str) -> Column:
    return F.year(F.from_utc_timestamp(F.timestamp_millis(F.col(name)), zone))


def fields(now: int, zone: str = "UTC") -> dict[str, tuple[str, Column]]:
    """Each field's kind and expression."""
    return {
        "plays": ("number", _or_zero("q_plays")),
        "qualifyingPlays": ("number", _or_zero("q_plays")),
        "msPlayed": ("number", _or_zero("ms_played") / 60_000.0),
        "firstHeardYear": ("number", _year("first_ts", zone)),
        "lastHeardYear": ("number", _year("last_ts", zone)),
        "daysSinceLastPlay": ("number", (F.lit(now) - F.coalesce("last_ts", F.lit(now))) / float(DAY_MS)),
        "lostFavoriteScore": ("number", _or_zero("score")),
        "peakYear": ("number", _or_zero("peak_year")),
        "skipRate": ("number", F.when(_or_zero("plays") > 0, 100.0 * _or_zero("skips") / F.col("plays")).otherwise(0.0)),
        "artist": ("text", F.col("artist")),
        "album": ("text", F.coalesce("album", F.lit(""))),
        "tag": ("text", F.col("tags")),
        "favorite": ("boolean", _or_zero("favorite")),
        "retired": ("boolean", _or_zero("retired")),
    }


_COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le, "eq": operator.eq, "neq": operator.ne}


def number(value: object) -> float:
    """A rule's value as a finite number; anything else counts as 0."""
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0
    return x if math.isfinite(x) else 0.0


def compile_rule(rule: Rule, known: dict[str, tuple[str, Column]]) -> Column:
    if rule.field not in known:
        raise RuleError(rule.field)
    kind, expr = known[rule.field]
    if kind == "boolean":
        return expr == (0 if rule.operator == "isFalse" else 1)
    if kind == "text":
        text = "" if rule.value is None else str(rule.value)
        if rule.operator in ("eq", "neq"):
            same = F.lower(expr) == text.lower()
            return same if rule.operator == "eq" else ~same
        hit = F.coalesce(expr, F.lit("")).ilike(f"%{text}%")
        return ~hit if rule.operator == "notContains" else hit
    if rule.operator == "between":
        return expr.between(number(rule.value), number(rule.value if rule.value2 is None else rule.value2))
    return _COMPARE.get(rule.operator, operator.ge)(expr, F.lit(number(rule.value)))


def compile_rules(rules: list[Rule], match: str, now: int, zone: str = "UTC") -> Column:
    """All rules as one condition; no rule matches everything, ``any`` joins them by OR and all else by AND."""
    known = fields(now, zone)
    parts = [compile_rule(r, known) for r in rules]
    return reduce(operator.or_ if match == "any" else operator.and_, parts) if parts else F.lit(True)


def collection(tracks: DataFrame, rules: list[Rule], match: str, now: int) -> DataFrame:
    """The tracks of a collection, most played first."""
    return tracks.filter(compile_rules(rules, match, now)).orderBy(F.desc("q_plays"), "track_id")


#: Collections that a new archive starts with: (name, description, match, rules). Fixed values.
STARTERS = (
    ("Lost Classics", "Heavily played, rarely skipped, and silent for years.", "all", (Rule("plays", "gt", "30"), Rule("daysSinceLastPlay", "gt", "1095"), Rule("skipRate", "lt", "20"))),
    ("Forgotten 2010s", "Discovered between 2010 and 2019, untouched since 2023.", "all", (Rule("firstHeardYear", "between", "2010", "2019"), Rule("lastHeardYear", "lt", "2023"), Rule("plays", "gte", "10"))),
    ("Still Standing", "Songs that have never left your rotation.", "all", (Rule("plays", "gte", "25"), Rule("daysSinceLastPlay", "lt", "120"))),
)
