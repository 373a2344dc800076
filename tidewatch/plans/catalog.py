"""Registry of the queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .bindings import Tables

SECTIONS = ["predicates", "correlating", "reading", "baselining", "enriching", "alerting", "parsing_logs",
            "safeguarding", "streams"]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            _sql[name] = sql
        return build
    return register


def load() -> None:
    for section in SECTIONS:
        import_module(f"{__package__}.{section}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_queries)


def all_sql() -> dict[str, str]:
    load()
    return dict(_sql)
