"""Grouped and global aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cents, revenue, safe_divide, year
from ..registry import query, sql
from ..sources import Tables


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey, c_mktsegment")
def group_by_keys(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), cents(F.sum("c_acctbal")).alias("total"))


@query("SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY y")
def group_by_expression(t: Tables) -> DataFrame:
    return t.orders.groupBy(year(F.col("o_orderdate")).alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a, min(l_shipdate)::DATE AS first_day, max(l_returnflag) AS last_flag FROM lineitem")
def aggregate_whole_table(t: Tables) -> DataFrame:
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("n"), cents(F.sum("l_quantity")).alias("s"), F.round(F.avg("l_quantity"), 4).alias("a"), F.min("l_shipdate").cast("date").alias("first_day"), F.max("l_returnflag").alias("last_flag")
    )


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_totalprice < 0")
def aggregate_no_rows(t: Tables) -> DataFrame:
    return t.orders.filter("o_totalprice < 0").agg(F.count(F.lit(1)).alias("n"), cents(F.sum("o_totalprice")).alias("s"))


@query("SELECT count(*) AS n FROM nation HAVING count(*) > 100")
def having_on_whole_table(t: Tables) -> DataFrame:
    return t.nation.agg(F.count(F.lit(1)).alias("n")).filter("n > 100")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 100 AND count(*) > 2")
def having_hidden_aggregate(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).filter("q > 100 AND n > 2").select("l_suppkey", "n")


@query("SELECT c_custkey, count(*) AS rows_, count(o_orderkey) AS orders_ FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
def count_rows_and_values(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 300000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("rows_"), F.count("o_orderkey").alias("orders_"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT l_returnflag, round(sum(DISTINCT l_quantity), 2) AS s, round(avg(DISTINCT l_quantity), 4) AS a, min(DISTINCT l_quantity) AS lo, max(DISTINCT l_quantity) AS hi FROM lineitem GROUP BY l_returnflag")
def distinct_folds(t: Tables) -> DataFrame:
    mean = F.expr("avg(DISTINCT l_quantity)")
    return t.lineitem.groupBy("l_returnflag").agg(cents(F.sum_distinct("l_quantity")).alias("s"), F.round(mean, 4).alias("a"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY n_regionkey")
def min_max_of_strings(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.min("n_name").alias("lo"), F.max("n_name").alias("hi"))


@query("SELECT l_linestatus, round(100 * sum(l_tax) / nullif(sum(l_discount), 0) - min(l_quantity), 4) AS v FROM lineitem GROUP BY l_linestatus")
def arithmetic_over_aggregates(t: Tables) -> DataFrame:
    v = safe_divide(100 * F.sum("l_tax"), F.sum("l_discount")) - F.min("l_quantity")
    return t.lineitem.groupBy("l_linestatus").agg(F.round(v, 4).alias("v"))


@query("""
SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 2) AS returned, round(coalesce(sum(nullif(l_tax, 0)), 0), 2) AS taxed,
  CASE WHEN count(*) > 10 THEN 'many' ELSE 'few' END AS how_many, round(-sum(l_discount), 2) AS less FROM lineitem GROUP BY l_linestatus""")
def aggregate_of_case_and_case_of_aggregate(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(
        cents(F.sum(F.when(F.col("l_returnflag") == "R", revenue()).otherwise(0.0))).alias("returned"),
        cents(F.coalesce(F.sum(F.expr("nullif(l_tax, 0)")), F.lit(0.0))).alias("taxed"),
        F.when(F.count(F.lit(1)) > 10, "many").otherwise("few").alias("how_many"),
        cents(-F.sum("l_discount")).alias("less"),
    )


@query("SELECT p_brand, p_size FROM part GROUP BY p_brand, p_size")
def group_without_aggregate(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_size").distinct()


@query("SELECT DISTINCT n FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey) c")
def distinct_of_groups(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select("n").distinct()


@query("SELECT o_totalprice > 150000 AS large, count(*) AS n FROM orders GROUP BY large")
def group_by_alias_in_sql(t: Tables) -> DataFrame:
    return sql(t, "SELECT o_totalprice > 150000 AS large, count(*) AS n FROM {orders} GROUP BY large", "orders")
