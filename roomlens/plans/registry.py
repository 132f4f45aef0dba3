"""All registered queries and their DuckDB oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roomlens.functions.text import PY_STRIP

from roomlens.plans import (eval_queries, file_queries, kg_queries, oracle_eval, oracle_files, oracle_kg,
                            oracle_sql, oracle_text, room_queries, text_queries)

QueryFn = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    out.update(room_queries.QUERIES)
    out.update(kg_queries.QUERIES)
    out.update(eval_queries.QUERIES)
    out.update(text_queries.QUERIES)
    out.update(file_queries.QUERIES)
    return out


def oracle() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(oracle_sql.room_sql())
    out.update(oracle_kg.kg_sql())
    out.update(oracle_eval.eval_sql())
    out.update(oracle_text.text_sql())
    out.update(oracle_files.files_sql())
    return {k: _python_strip(v) for k, v in out.items() if k in queries()}


def _python_strip(sql: str) -> str:
    """The twins write whitespace trimming as `'^\\s+|\\s+$'` for
    readability; Python's strip() (what the reference calls) removes a
    wider set, so its exact class is substituted."""
    return sql.replace("'^\\s+|\\s+$'", "'" + PY_STRIP + "'")
