"""Projection, predicates, scalar functions, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cents, day, like_any_case, month, revenue, safe_divide, shift, substring, text_of, trim_space, year
from ..registry import query, sql
from ..sources import Tables


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_table(t: Tables) -> DataFrame:
    return t.nation


@query("SELECT r.r_regionkey, r.n FROM (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) r WHERE r.n > 1")
def scan_derived_table(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS revenue, -l_quantity + 2 * (l_tax + 1) AS mixed FROM lineitem")
def project_expressions(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", revenue().alias("revenue"), (-F.col("l_quantity") + 2 * (F.col("l_tax") + 1)).alias("mixed"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def project_distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT n_name, (SELECT count(*) FROM region) AS regions FROM nation")
def project_scalar_subquery(t: Tables) -> DataFrame:
    return t.nation.select("n_name").crossJoin(F.broadcast(t.region.agg(F.count(F.lit(1)).alias("regions"))))  # one row


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal > 5000 OR NOT c_nationkey <> 3) AND c_nationkey != 7")
def filter_boolean(t: Tables) -> DataFrame:
    rich = (F.col("c_acctbal") > 5000) | ~(F.col("c_nationkey") != 3)
    return t.customer.filter((F.col("c_mktsegment") == "BUILDING") & rich & (F.col("c_nationkey") != 7)).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size < 40 AND p_size > 3 AND p_retailprice <= 1500 AND p_retailprice >= 900")
def filter_comparisons(t: Tables) -> DataFrame:
    return t.part.filter((F.col("p_size") < 40) & (F.col("p_size") > 3) & (F.col("p_retailprice") <= 1500) & (F.col("p_retailprice") >= 900)).select("p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 20")
def filter_not_between(t: Tables) -> DataFrame:
    return t.part.filter(~F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#23')")
def filter_in_list(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_brand").isin("Brand#1", "Brand#12", "Brand#23")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#12', 'Brand#23')")
def filter_not_in_list(t: Tables) -> DataFrame:
    return t.part.filter(~F.col("p_brand").isin("Brand#1", "Brand#12", "Brand#23")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%gizm_'")
def filter_like(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").like("%gizm_")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE 'blue%'")
def filter_not_like(t: Tables) -> DataFrame:
    return t.part.filter(~F.col("p_name").like("blue%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'BLUE%'")
def filter_like_any_case(t: Tables) -> DataFrame:
    return t.part.filter(like_any_case(F.col("p_name"), "BLUE%")).select("p_partkey", "p_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL")
def filter_is_null(t: Tables) -> DataFrame:
    orders = t.orders.filter("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    return t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").filter(F.col("o_orderkey").isNull()).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NOT NULL")
def filter_is_not_null(t: Tables) -> DataFrame:
    orders = t.orders.filter("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    return t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").filter(F.col("o_orderkey").isNotNull()).select("c_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem")
def divide_by_zero_is_null(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", safe_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done FROM orders")
def case_when(t: Tables) -> DataFrame:
    band = F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") > 100000, "medium")
    return t.orders.select("o_orderkey", band.alias("band"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("done"))


@query("""
SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, substring(c_name, 10) AS tail, substr(c_name, 1, 8) AS head, trim('  ' || c_name || ' ') AS trimmed,
  regexp_replace(chr(9) || c_name || chr(10), '^\\s+|\\s+$', '', 'g') AS bare, c_name || '/' || c_mktsegment AS joined, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer""")
def string_functions(t: Tables) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey",
        F.upper(name).alias("up"),
        F.lower(segment).alias("low"),
        substring(name, 10).alias("tail"),
        substring(name, 1, 8).alias("head"),
        F.trim(text_of(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        trim_space(text_of(F.lit("\t"), name, F.lit("\n"))).alias("bare"),
        text_of(name, F.lit("/"), segment).alias("joined"),
        F.coalesce(F.nullif(segment, F.lit("BUILDING")), F.lit("none")).alias("segment"),
    )


@query("SELECT substring(c_name FROM 1 FOR 8) AS head, substring(c_name FROM 16) AS tail, CAST(c_acctbal AS BIGINT) AS whole, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def substring_and_cast_in_sql(t: Tables) -> DataFrame:
    # rounded as the standard's cast does; Spark's own cuts off
    return sql(t, "SELECT substring(c_name FROM 1 FOR 8) AS head, substring(c_name FROM 16) AS tail, CAST(rint(c_acctbal) AS BIGINT) AS whole, CAST(c_nationkey AS STRING) AS nation FROM {customer}", "customer")


@query("SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d FROM orders")
def extract_date_parts(t: Tables) -> DataFrame:
    at = F.col("o_orderdate")
    return t.orders.select("o_orderkey", year(at).alias("y"), month(at).alias("m"), day(at).alias("d"))


@query("""
SELECT o_orderkey, CAST(o_orderdate + INTERVAL 90 DAY AS DATE) AS d90, CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS m1, CAST(o_orderdate + INTERVAL 2 YEAR AS DATE) AS y2
FROM orders WHERE o_orderdate >= DATE '1996-01-31' - INTERVAL 1 MONTH""")
def date_intervals(t: Tables) -> DataFrame:
    at, first = F.col("o_orderdate"), F.expr("CAST(DATE '1996-01-31' - INTERVAL '1' MONTH AS TIMESTAMP_NTZ)")
    return t.orders.filter(at >= first).select("o_orderkey", shift(at, days=90).alias("d90"), shift(at, months=-1).alias("m1"), shift(at, years=2).alias("y2"))


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey")
def sort_keys(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_mktsegment", cents(F.col("c_acctbal")).alias("c_acctbal")).orderBy(F.asc("c_mktsegment"), F.desc("c_acctbal"), "c_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 ORDER BY o_orderkey ASC NULLS FIRST, c_custkey")
def sort_nulls_lowest(t: Tables) -> DataFrame:
    orders = t.orders.filter("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    return t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey").orderBy(F.asc_nulls_first("o_orderkey"), "c_custkey")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, segment")
def sort_by_aggregate(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "segment")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", cents(F.col("o_totalprice")).alias("o_totalprice")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal")).union(t.supplier.select("s_nationkey", "s_acctbal"))


@query("SELECT n_nationkey + 1, n_name, n_regionkey * 2 FROM nation")
def project_unaliased(t: Tables) -> DataFrame:
    """Unnamed expressions are named by their own text, columns keep their names."""
    return sql(t, "SELECT n_nationkey + 1, n_name, n_regionkey * 2 FROM {nation}", "nation")


@query("SELECT c_mktsegment, c_custkey FROM customer ORDER BY 1, 2 DESC LIMIT 500")
def sort_by_ordinal(t: Tables) -> DataFrame:
    return sql(t, "SELECT c_mktsegment, c_custkey FROM {customer} ORDER BY 1, 2 DESC LIMIT 500", "customer")
