"""Where this subpackage's query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return enter
