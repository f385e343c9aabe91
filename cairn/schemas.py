"""Declared schemas of the eight decision-support tables, and schemas from (column, type) lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

#: Type names of a user-supplied schema.
TYPES: dict[str, T.DataType] = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "date": T.DateType()}


def schema_of(columns: Iterable[tuple[str, str]]) -> T.StructType:
    """A schema from (column, type) pairs; an unknown type is an error."""
    fields = []
    for name, kind in columns:
        if kind not in TYPES:
            raise ValueError(f"unknown type {kind!r} of column {name!r}; known are {', '.join(TYPES)}")
        fields.append(T.StructField(name, TYPES[kind]))
    return T.StructType(fields)


def _columns(text: str) -> T.StructType:
    return schema_of(tuple(pair.split(":")) for pair in text.split())


TABLES: dict[str, T.StructType] = {
    "region": _columns("r_regionkey:int r_name:str r_comment:str"),
    "nation": _columns("n_nationkey:int n_name:str n_regionkey:int n_comment:str"),
    "supplier": _columns("s_suppkey:int s_name:str s_address:str s_nationkey:int s_phone:str s_acctbal:float s_comment:str"),
    "customer": _columns("c_custkey:int c_name:str c_address:str c_nationkey:int c_phone:str c_acctbal:float c_mktsegment:str c_comment:str"),
    "part": _columns("p_partkey:int p_name:str p_mfgr:str p_brand:str p_type:str p_size:int p_container:str p_retailprice:float p_comment:str"),
    "partsupp": _columns("ps_partkey:int ps_suppkey:int ps_availqty:int ps_supplycost:float ps_comment:str"),
    "orders": _columns(
        "o_orderkey:int o_custkey:int o_orderstatus:str o_totalprice:float o_orderdate:date o_orderpriority:str o_clerk:str o_shippriority:int o_comment:str"
    ),
    "lineitem": _columns(
        "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:float l_extendedprice:float l_discount:float l_tax:float"
        " l_returnflag:str l_linestatus:str l_shipdate:date l_commitdate:date l_receiptdate:date l_shipinstruct:str l_shipmode:str l_comment:str"
    ),
}
