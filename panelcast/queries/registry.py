"""Registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with SQL giving the same rows if there is one."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def q6(expression: str, name: str | None = None) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name or expression}"


def rounded(df: DataFrame) -> DataFrame:
    """Six decimals for doubles and long integers, keeping the order of columns.

    Adding zero turns a rounded negative zero into a plain one, so that engines
    agree on the last digit. Written as SQL text: one call for all columns.
    """
    texts = {
        "double": "round(`{0}`, 6) + 0.0D AS `{0}`",
        "float": "round(CAST(`{0}` AS DOUBLE), 6) + 0.0D AS `{0}`",
        "int": "CAST(`{0}` AS BIGINT) AS `{0}`",
    }
    return df.selectExpr(*[texts.get(kind, "`{0}`").format(name) for name, kind in df.dtypes])
