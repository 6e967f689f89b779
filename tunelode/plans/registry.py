"""All library queries by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from . import entities, jobs, library, media, paged, versions  # noqa: F401 - each registers its queries


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _oracles


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["tracks_in_vibe_range"](spark, sf_dir)
