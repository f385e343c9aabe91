"""Registration of queries with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a builder (Tables -> DataFrame) under its name, beside the equivalent SQL."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        ORACLE[name] = sql
        return build

    return register


def sql(t: Tables, text: str, *names: str) -> DataFrame:
    """For builders that are clearest as SQL: ``{name}`` in ``text`` is the table; no view stays in the session."""
    return t.spark.sql(text, **{name: getattr(t, name) for name in names})
