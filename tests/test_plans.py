"""Physical plans that the queries rely on."""

import re

import pytest
from pyspark.sql import functions as F

from cairn import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(catalog.QUERIES["q06"](spark, small))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text or re.search(r"PushedFilters: \[[^]]*l_discount", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_quantity", "l_extendedprice", "l_discount", "l_shipdate"}


@pytest.mark.parametrize("name", ["q19", "q05", "q07", "q08", "q02", "q20", "q21", "exists_with_inequality", "scalar_subquery_correlated"])
def test_no_product(spark, small, name):
    text = plan(catalog.QUERIES[name](spark, small)).split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(("name", "kind"), [("q04", "LeftSemi"), ("exists_correlated", "LeftSemi"), ("not_exists_correlated", "LeftAnti"), ("not_in_subquery", "LeftAnti"), ("in_subquery", "LeftSemi")])
def test_subqueries_are_joins(spark, small, name, kind):
    assert kind in plan(catalog.QUERIES[name](spark, small))


def test_top_k_sorts_no_table(spark, small):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["top_k"](spark, small))


def test_one_scan_of_the_fact_table(spark, small):
    for name in ("q17", "q18", "q21", "q02", "q09", "q20"):
        text = plan(catalog.QUERIES[name](spark, small)).split("== Physical Plan ==")[1]
        assert len(re.findall(r"FileScan parquet \[[^]]*l_orderkey|FileScan parquet \[[^]]*l_partkey", text)) == 1, name


@pytest.mark.parametrize("bound", ["10m", "256k", "-1"])
def test_theta_join_is_dealt_over_tasks(spark, medium, bound):
    """Its result grows with the product of two small files, each of which is a single task's input."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    try:
        df = catalog.QUERIES["join_theta_without_equality"](spark, medium)
        text = plan(df).split("== Physical Plan ==")[1]
        tasks = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert df.rdd.getNumPartitions() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(tasks) <= sum(tasks) / 2
    assert "Broadcast" not in text
