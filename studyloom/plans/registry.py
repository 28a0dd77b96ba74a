"""Catalogue of runnable queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a function of the tables under a key, with the SQL that must give the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _SQL[key] = sql
        return fn

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {key: wrap(fn) for key, fn in _QUERIES.items()}


def sql_twins() -> dict[str, str]:
    return dict(_SQL)
