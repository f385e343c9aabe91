"""Pipe-delimited files and folders of them: the driver's tables written so, read back and queried."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..registry import query
from ..session import Engine
from ..sources import Tables, scratch, write_pipe


def _written(t: Tables, *names: str) -> str:
    folder = scratch(t.spark, "pipe")
    for name in names:
        write_pipe(getattr(t, name), f"{folder}/{name}.tbl")
    return folder


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_pipe_table(t: Tables) -> DataFrame:
    schema = [("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "str")]
    return Engine(t.spark.newSession()).load_table("customer", f"{_written(t, 'customer')}/customer.tbl", schema)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice * 2 AS twice FROM orders WHERE o_orderdate < DATE '1996-01-01'")
def read_pipe_casts(t: Tables) -> DataFrame:
    engine = Engine(t.spark.newSession())
    folder = scratch(t.spark, "pipe")
    write_pipe(t.orders.selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS o_orderdate", "o_totalprice"), f"{folder}/orders.tbl")
    engine.load_table("orders", f"{folder}/orders.tbl", [("o_orderkey", "int"), ("o_orderdate", "date"), ("o_totalprice", "float")])
    return engine.execute("SELECT o_orderkey, o_orderdate, o_totalprice * 2 AS twice FROM orders WHERE o_orderdate < DATE '1996-01-01'")


@query("SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def read_folder_of_tables(t: Tables) -> DataFrame:
    """The declared schemas have a comment column, which these files lack and which is NULL then."""
    engine = Engine(t.spark.newSession())
    engine.load_tpch(_written(t, "nation", "region"))
    return engine.execute("SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")


@query("SELECT r_regionkey, r_name FROM region")
def look_up_table(t: Tables) -> DataFrame:
    engine = Engine(t.spark.newSession())
    engine.load_tpch(t.folder, ["region"])
    return engine.table("region")
