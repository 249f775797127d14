"""Registered queries: a Spark callable and, where SQL can say it, its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from centwise.registry.fragments import compose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECK_SQL[name] = check
        return fn

    return register


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_check_sql() -> dict[str, str]:
    _load()
    return {name: compose(sql) for name, sql in CHECK_SQL.items()}


def _load() -> None:
    import importlib

    for area in AREAS:
        importlib.import_module(f"centwise.registry.{area}")


AREAS = ["views", "scalars", "engine", "reports", "storage_reads", "learning", "imports", "feeds"]
