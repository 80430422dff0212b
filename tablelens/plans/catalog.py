"""Registered queries: one per inventory id, each with its DuckDB oracle SQL.

Every query reads the provided tables (or frames Spark derives from them)
in full. Doubles go through ``round(x, 6)`` on both sides (4 where the two
engines sum in another order); counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def d(x: str) -> str:
    """SQL: cast to DOUBLE (DuckDB decimal literals would stay DECIMAL)."""
    return f"CAST(({x}) AS DOUBLE)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def with_cte(ctes: dict[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body
