"""Registered queries: a Spark plan over the sample tables and, where SQL can say it, its oracle.

Both sides are brought to plain types: lists joined by ``|``, dates and times as text,
integers as 64 bit, fractions rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.sources import evidence as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind == "array":
            col = F.array_join(col.cast("array<string>"), "|")
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("integer", "short", "byte"):
            col = col.cast("bigint")
        elif kind in ("double", "float", "decimal"):
            col = F.round(col.cast("double"), 6) + F.lit(0.0)
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the common tables of :data:`WITH`."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: flat(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


_TABLES = {t: t for t in ("documents", "orders", "customer", "labels", "events")}

# common tables of the oracle; only those a statement mentions are added
COMMON: dict[str, str] = {
    "ev": "SELECT *, sha256(raw) AS file_hash, CAST(strlen(raw) AS BIGINT) AS file_size FROM ("
          + src.EVIDENCE_SQL.format(**_TABLES) + ") e0",
    "answers": src.AI_RESULTS_SQL.format(**{**_TABLES, "documents": (
        "(SELECT doc_id, agent, agent_ord FROM documents CROSS JOIN (" + " UNION ALL ".join(
            f"SELECT {i + 1} AS agent_ord, '{a}' AS agent" for i, a in enumerate(src.AGENTS)) + ") g)")}),
    "usage": src.USAGE_SQL.format(**_TABLES),
}


def with_tables(sql: str) -> str:
    import re

    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in COMMON.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(body)
                needed.append(name)

    add(sql)
    parts = ", ".join(f"{n} AS ({COMMON[n]})" for n in needed)
    if not parts:
        return sql
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return f"{head}{parts}, {sql[len(head):]}"
    return f"WITH {parts} {sql}"


# ---- small builders of oracle text -----------------------------------------------------
def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lit_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def hits_sql(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(w.lower())}) AS INT)" for w in words) + ")"


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w.lower())})" for w in words) + ")"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0"


def positions_sql(source: str, text: str, pattern: str, columns: str) -> str:
    """Every match with its 0-based start: gaps and matches before it, summed up."""
    p = q(pattern)
    return (f"SELECT {columns}, {text} AS txt, m[i] AS raw_match, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) "
            f"+ coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start FROM ("
            f"SELECT *, unnest(range(1, CAST(len(m) AS BIGINT) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, {p}) AS m, "
            f"string_split_regex({text}, {p}) AS s FROM {source}) m0) m1")
