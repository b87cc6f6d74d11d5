"""Where queries register, and how their SQL counterparts are put together."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostlens.catalog.views import plain

Runner = Callable[[SparkSession, str], DataFrame]

# added before rounding to six decimals, in Spark and in SQL: an exact tie would
# otherwise round by the last bit of a sum, which depends on the order of rows
NUDGE = 3.14159e-9

RUNNERS: dict[str, Runner] = {}
SQL: dict[str, str] = {}
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    """A named SELECT that the SQL of queries may refer to."""
    PARTS[name] = plain(sql)


def query(key: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        RUNNERS[key] = run
        if sql is not None:
            SQL[key] = sql
        return run

    return register


def _needed(sql: str, seen: dict[str, None]) -> None:
    for name in re.findall(r"\b\w+\b", sql):
        if name in PARTS and name not in seen:
            body = PARTS[name]
            own = re.sub(rf"\b{name}\b", "", body)
            _needed(own, seen)
            seen[name] = None


def _nudged(sql: str) -> str:
    return sql.replace(", 6)", f" + {NUDGE}, 6)")


def full_sql(key: str) -> str:
    """The SQL of a query with the named parts it uses, in order."""
    sql = _nudged(SQL[key])
    used: dict[str, None] = {}
    _needed(sql, used)
    if not used:
        return sql
    clauses = []
    for name in used:
        body = _nudged(PARTS[name])
        head = re.match(r"\s*\((.*?)\)\s*AS\s", body)
        columns = f"({head.group(1)})" if head else ""
        clauses.append(f"{name}{columns} AS ({body[head.end():] if head else body})")
    return "WITH RECURSIVE " + ",\n".join(clauses) + "\n" + sql
