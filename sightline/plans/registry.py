"""Catalogue of runnable queries with the SQL each one is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("functions", "sources", "merge", "views", "scoring", "streams")


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return run
    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.q_{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
