"""Joins, and subqueries in predicates as the joins that they are."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cents
from ..registry import query, sql
from ..sources import Tables


@query("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey")
def join_inner(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON o_custkey = c_custkey")
def join_left_outer(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_suppkey > n_nationkey * 2")
def join_theta(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("s_suppkey") > F.col("n_nationkey") * 2)).select("s_suppkey", "n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey > n_nationkey + 2")
def join_left_theta(t: Tables) -> DataFrame:
    return t.region.join(t.nation, F.col("r_regionkey") > F.col("n_nationkey") + 2, "left").select("r_name", "n_name")


_RUN = 7  # bits of the rows in one run of suppliers


def _runs(suppliers: DataFrame) -> DataFrame:
    """Suppliers of one nation with neighbouring balances, at most 2 ** _RUN to a row, however many share a balance."""
    order = ["s_nationkey", "s_acctbal", "s_suppkey"]
    known = suppliers.select(*order).filter("s_nationkey IS NOT NULL AND s_acctbal IS NOT NULL")  # NULL compares with nothing
    placed = known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("run", F.shiftright(F.monotonically_increasing_id(), _RUN))
    runs = placed.groupBy("s_nationkey", "run").agg(F.min("s_acctbal").alias("least"), F.max("s_acctbal").alias("most"), F.collect_list(F.struct("s_suppkey", "s_acctbal")).alias("own"))
    return runs.select("s_nationkey", "least", "most", F.col("own.s_suppkey").alias("keys"), F.col("own.s_acctbal").alias("balances"))


def _dealt(rows: DataFrame, least: int) -> int:
    """Of how many parts, ``least`` or more, each has 2 ** 16 rows at most: Parquet's dictionary of a key column holds twice as many."""
    return max(least, math.ceil(rows.count() / (1 << 16)))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_acctbal > c_acctbal AND s_nationkey <> c_nationkey")
def join_theta_without_equality(t: Tables) -> DataFrame:
    # the result is about half the product, far larger than its inputs, so both sides are dealt by number and not by bytes, to a grid
    # of about as many tasks as a shuffle has; runs of suppliers meet customers, few of which need a look at single balances
    side = math.ceil(math.sqrt(int(t.spark.conf.get("spark.sql.shuffle.partitions"))))
    # a run meets customers by balance: those below it, each of which gives the same suppliers, then those within it; so the rows repeat and Parquet packs them
    customers = t.customer.select("c_custkey", "c_nationkey", "c_acctbal").repartition(_dealt(t.customer, side)).sortWithinPartitions("c_acctbal")
    above = (F.col("most") > F.col("c_acctbal")) & (F.col("s_nationkey") != F.col("c_nationkey"))
    met = _runs(t.supplier).repartition(_dealt(t.supplier, side)).hint("shuffle_replicate_nl").join(customers, above)
    pairs = met.select("c_custkey", "c_acctbal", "least", "balances", F.posexplode("keys").alias("at", "s_suppkey"))
    return pairs.filter((F.col("least") > F.col("c_acctbal")) | (F.col("balances")[F.col("at")] > F.col("c_acctbal"))).select("s_suppkey", "c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@query("SELECT n_name, r_name, s_name FROM nation, region, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey")
def join_comma_list(t: Tables) -> DataFrame:
    return sql(t, "SELECT n_name, r_name, s_name FROM {nation}, {region}, {supplier} WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey", "nation", "region", "supplier")


@query("SELECT n_name, r_name FROM nation, region")
def join_comma_without_where(t: Tables) -> DataFrame:
    return sql(t, "SELECT n_name, r_name FROM {nation}, {region}", "nation", "region")


@query("""
SELECT a.l_partkey AS partkey, a.l_suppkey AS suppkey, round(a.q, 2) AS q, b.n FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey, l_suppkey) a,
  (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey, l_suppkey) b WHERE a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def join_composite_key(t: Tables) -> DataFrame:
    keys = ["l_partkey", "l_suppkey"]
    a = t.lineitem.groupBy(*keys).agg(cents(F.sum("l_quantity")).alias("q"))
    b = t.lineitem.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, keys).select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), "q", "n")


@query("SELECT r_name, n_name, s_name FROM region, nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey")
def join_comma_then_explicit(t: Tables) -> DataFrame:
    return sql(t, "SELECT r_name, n_name, s_name FROM {region}, {nation} LEFT JOIN {supplier} ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey", "nation", "region", "supplier")


@query("SELECT n_name, d.n FROM nation JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) d ON d.s_nationkey = n_nationkey")
def join_derived_table(t: Tables) -> DataFrame:
    counts = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return t.nation.join(counts, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "n")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def exists_correlated(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def not_exists_correlated(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem l1 WHERE l_returnflag = 'R' AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)")
def exists_with_inequality(t: Tables) -> DataFrame:
    other = t.lineitem.select(F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"))
    return t.lineitem.filter("l_returnflag = 'R'").join(other, (F.col("l_orderkey") == F.col("ok")) & (F.col("sk") != F.col("l_suppkey")), "left_semi").select("l_orderkey", "l_suppkey", "l_linenumber")


@query("SELECT n_name FROM nation WHERE EXISTS (SELECT * FROM supplier WHERE s_acctbal > 9000)")
def exists_uncorrelated(t: Tables) -> DataFrame:
    return sql(t, "SELECT n_name FROM {nation} WHERE EXISTS (SELECT * FROM {supplier} WHERE s_acctbal > 9000)", "nation", "supplier")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def in_subquery(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.filter("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > s_acctbal + 5000)")
def in_subquery_correlated(t: Tables) -> DataFrame:
    # some customer of the nation is richer by so much exactly if the richest one is
    richest = t.customer.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("top"))
    return t.supplier.join(richest, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("top") > F.col("s_acctbal") + 5000), "left_semi").select("s_suppkey")


_NOT_IN = "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, {}) FROM supplier WHERE s_acctbal > 5000)"


def not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of ``left`` whose ``key`` is NOT IN column ``other`` of ``right``, with SQL's rules for NULL.

    An anti join that Spark may shuffle, and one row of facts: nothing is in an empty set, and
    with a NULL in the set, or as the key, the answer is never true. Spark's own plan for the SQL
    text broadcasts the set whatever its size.
    """
    facts = right.agg(F.count(F.lit(1)).alias("__all"), F.count(other).alias("__some"))
    apart = left.join(right.select(F.col(other).alias("__other")).filter("__other IS NOT NULL"), F.col(key) == F.col("__other"), "left_anti")
    sure = (F.col("__all") == 0) | ((F.col("__all") == F.col("__some")) & F.col(key).isNotNull())
    return apart.join(F.broadcast(facts), sure).drop("__all", "__some")  # one row


@query(_NOT_IN.format(-1))
def not_in_subquery(t: Tables) -> DataFrame:
    suppliers = t.supplier.filter("s_acctbal > 5000").select(F.nullif("s_nationkey", F.lit(-1)).alias("k"))
    return not_in(t.customer, "c_nationkey", suppliers, "k").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT CASE WHEN s_suppkey > 0 THEN s_nationkey END FROM supplier)")
def not_in_subquery_with_null(t: Tables) -> DataFrame:
    return not_in(t.customer, "c_nationkey", t.supplier.select(F.when(F.col("s_suppkey") > 0, F.col("s_nationkey")).alias("k")), "k").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 1e9)")
def not_in_empty_subquery(t: Tables) -> DataFrame:
    return not_in(t.customer, "c_nationkey", t.supplier.filter("s_acctbal > 1e9"), "s_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_subquery(t: Tables) -> DataFrame:
    mean = t.customer.agg(F.avg("c_acctbal").alias("mean"))  # one row
    return t.customer.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(s_acctbal) FROM supplier WHERE s_acctbal > 1e9)")
def scalar_subquery_empty(t: Tables) -> DataFrame:
    return sql(t, "SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT max(s_acctbal) FROM {supplier} WHERE s_acctbal > 1e9)", "customer", "supplier")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)")
def scalar_subquery_correlated(t: Tables) -> DataFrame:
    # a grouped mean is summed before the shuffle, and a hot customer's join can be split; a window could be neither
    mean = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("mean"))
    return t.orders.join(mean, (F.col("o_custkey") == F.col("k")) & (F.col("o_totalprice") > 1.5 * F.col("mean"))).select("o_orderkey")


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey HAVING sum(c_acctbal) > (SELECT sum(c_acctbal) * 0.05 FROM customer)")
def scalar_subquery_in_having(t: Tables) -> DataFrame:
    nations = t.customer.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("v"))
    floor = nations.agg((F.sum("v") * 0.05).alias("floor"))  # one row
    return nations.join(F.broadcast(floor), F.col("v") > F.col("floor")).select("c_nationkey", cents(F.col("v")).alias("total"))


@query("""
SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))
  AND c_acctbal > (SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))""")
def nested_subqueries(t: Tables) -> DataFrame:
    asia = t.nation.join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    two = t.supplier.join(t.nation.filter("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    mean = two.agg(F.avg("s_acctbal").alias("mean"))  # one row
    return t.customer.join(asia, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean")).select("c_custkey")
