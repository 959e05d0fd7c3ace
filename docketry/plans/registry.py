"""Query registry: a callable over the tables of a folder and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``name``; without ``sql`` the query is checked by tests instead."""
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return keep


def values(name: str, columns: str, rows) -> str:
    """A constant table as an SQL common table expression."""
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"
