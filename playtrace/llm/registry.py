"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from playtrace.llm import conversations, line_dedup, mixing, ranking
from playtrace.llm import queries as q


def queries() -> dict:
    return {name: getattr(q, name) for name in sorted(dir(q)) if name.startswith("op")} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op2_line_dedup": line_dedup.ORACLE, "op9_mixing": mixing.ORACLE, "op11_conversations": conversations.ORACLE, "op12_ranked_search": ranking.ORACLE}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
