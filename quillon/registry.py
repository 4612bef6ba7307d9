"""Queries by name, each with the DuckDB SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def wrap(f):
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return wrap


def _load() -> None:
    from .plans import domain_queries, frame_queries, sql_queries, table_queries, text_queries  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
