"""The 22 decision-support queries as SQL text through the façade, as a user of SQL runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..registry import ORACLE, QUERIES
from ..session import Engine

#: Where a text's dialect differs from Spark's.
DIALECT = [("CAST(c_nationkey AS VARCHAR)", "CAST(c_nationkey AS STRING)")]


def _through_engine(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    for theirs, ours in DIALECT:
        sql = sql.replace(theirs, ours)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        engine = Engine(spark.newSession())  # its tables stay out of the caller's session
        engine.load_tpch(folder)
        return engine.execute(sql)

    return run


def register() -> None:
    for name in [f"q{i:02d}" for i in range(1, 23)]:
        QUERIES[f"sql_{name}"], ORACLE[f"sql_{name}"] = _through_engine(ORACLE[name]), ORACLE[name]
