"""The registered queries against their SQL, and the shape of their results."""

import importlib

import pytest
from oracle import assert_same

from cairn.llm import queries as registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, name):
    assert assert_same(QUERIES[name](spark, small), small, SQL[name])


def test_ten_operators_and_the_pipeline(spark):
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names
