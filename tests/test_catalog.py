"""Every registered SQL query against DuckDB on the driver's tables."""

import pytest
from oracle import assert_same

from cairn import catalog

#: Queries whose answer is empty by their nature.
EMPTY = {"having_on_whole_table", "scalar_subquery_empty", "not_in_subquery_with_null"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, medium, name):
    n = assert_same(catalog.QUERIES[name](spark, medium), medium, catalog.ORACLE[name])
    assert (n > 0) == (name not in EMPTY)


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
