"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NUDGE = 1e-9


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: Column) -> Column:
    """Rounded to six places, without negative zero. Moved off exact halves, which engines round either way."""
    return F.round(c + F.lit(NUDGE), 6) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + {NUDGE}, 6) + 0.0)"
