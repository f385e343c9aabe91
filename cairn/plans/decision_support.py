"""The 22 decision-support queries over the driver's tables.

Subqueries that compare a row with its group are windows or grouped joins here, so a fact table
is shuffled once where the SQL text beside it scans it again. Dimension tables are left to
Spark's size-checked broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cents, revenue, safe_divide, whole_cents, year
from ..registry import query
from ..sources import Tables

PS = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, floor(min(l_extendedprice / nullif(l_quantity, 0)) * 100) / 100 AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"


def between(column: str, start: str, end: str) -> Column:
    """At ``start`` or later and before ``end``."""
    c = F.col(column)
    return (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))


def total(column: Column | None = None) -> Column:
    return cents(F.sum(revenue() if column is None else column))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 2) AS avg_qty, round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL 90 DAY
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
def q01(t: Tables) -> DataFrame:
    last = F.expr("DATE '1998-12-01' - INTERVAL '90' DAY").cast("timestamp_ntz")
    return (
        t.lineitem.filter(F.col("l_shipdate") <= last)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            cents(F.sum("l_quantity")).alias("sum_qty"),
            cents(F.sum("l_extendedprice")).alias("sum_base_price"),
            total().alias("sum_disc_price"),
            total(revenue() * (1 + F.col("l_tax"))).alias("sum_charge"),
            cents(F.avg("l_quantity")).alias("avg_qty"),
            cents(F.avg("l_extendedprice")).alias("avg_price"),
            F.round(F.avg("l_discount"), 4).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query(f"""
WITH ps AS {PS}
SELECT round(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, p_brand
FROM part, supplier, ps, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type LIKE '%PROMO'
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT min(ps2.ps_supplycost) FROM ps ps2, supplier s2, nation n2, region r2
    WHERE p_partkey = ps2.ps_partkey AND s2.s_suppkey = ps2.ps_suppkey AND s2.s_nationkey = n2.n_nationkey
      AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
def q02(t: Tables) -> DataFrame:
    europe = t.region.filter("r_name = 'EUROPE'").join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    offers = (
        t.partsupp.join(t.part.filter("p_size = 15 AND p_type LIKE '%PROMO'"), F.col("p_partkey") == F.col("ps_partkey"))
        .join(t.supplier, F.col("s_suppkey") == F.col("ps_suppkey"))
        .join(europe, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    least = F.min("ps_supplycost").over(Window.partitionBy("p_partkey"))
    best = offers.withColumn("least", least).filter("ps_supplycost = least")
    return best.select(cents(F.col("s_acctbal")).alias("s_acctbal"), "s_name", "n_name", "p_partkey", "p_brand").orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100)


@query("""
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < DATE '1996-03-15' AND l_shipdate > DATE '1996-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def q03(t: Tables) -> DataFrame:
    day = F.lit("1996-03-15").cast("timestamp_ntz")
    orders = t.orders.filter(F.col("o_orderdate") < day).join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return (
        t.lineitem.filter(F.col("l_shipdate") > day)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
        .agg(total().alias("revenue"))
        .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey")
        .limit(10)
    )


@query("""
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
  AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate)
GROUP BY o_orderpriority ORDER BY o_orderpriority""")
def q04(t: Tables) -> DataFrame:
    late = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") < F.col("o_orderdate"))
    return t.orders.filter(between("o_orderdate", "1996-07-01", "1996-10-01")).join(t.lineitem, late, "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count")).orderBy("o_orderpriority")


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC""")
def q05(t: Tables) -> DataFrame:
    asia = t.nation.join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = t.supplier.join(asia, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t.orders.filter(between("o_orderdate", "1996-01-01", "1997-01-01")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return (
        t.lineitem.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .groupBy("n_name")
        .agg(total().alias("revenue"))
        .orderBy(F.desc("revenue"))
    )


@query("""
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def q06(t: Tables) -> DataFrame:
    rows = t.lineitem.filter(between("l_shipdate", "1996-01-01", "1997-01-01") & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(total(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


@query("""
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM supplier, lineitem, orders, customer, nation n1, nation n2
WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
  AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
  AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")
def q07(t: Tables) -> DataFrame:
    pair = ("NATION_6", "NATION_7")
    named = lambda side: t.nation.filter(F.col("n_name").isin(*pair)).select(F.col("n_nationkey").alias(f"{side}_key"), F.col("n_name").alias(f"{side}_nation"))
    suppliers = t.supplier.join(named("supp"), F.col("s_nationkey") == F.col("supp_key"))
    orders = t.orders.join(t.customer.join(named("cust"), F.col("c_nationkey") == F.col("cust_key")), F.col("o_custkey") == F.col("c_custkey"))
    return (
        t.lineitem.filter(F.col("l_shipdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .filter("supp_nation <> cust_nation")
        .groupBy("supp_nation", "cust_nation", year(F.col("l_shipdate")).alias("l_year"))
        .agg(total().alias("revenue"))
        .orderBy("supp_nation", "cust_nation", "l_year")
    )


@query("""
SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year,
  round(sum(CASE WHEN n2.n_name = 'NATION_2' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / nullif(sum(l_extendedprice * (1 - l_discount)), 0), 6) AS mkt_share
FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
  AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY'
GROUP BY o_year ORDER BY o_year""")
def q08(t: Tables) -> DataFrame:
    america = t.nation.join(t.region.filter("r_name = 'AMERICA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey")
    orders = t.orders.join(t.customer.join(america, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("n_name") == "NATION_2", revenue()).otherwise(0.0)
    return (
        t.lineitem.join(t.part.filter("p_type = 'ECONOMY'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(year(F.col("o_orderdate")).alias("o_year"))
        .agg(F.round(safe_divide(F.sum(own), F.sum(revenue())), 6).alias("mkt_share"))
        .orderBy("o_year")
    )


@query(f"""
WITH ps AS {PS}
SELECT n_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 4) AS sum_profit
FROM part, supplier, lineitem, ps, orders, nation
WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
  AND s_nationkey = n_nationkey AND p_name LIKE '%gizmo%'
GROUP BY n_name, o_year ORDER BY n_name, o_year DESC""")
def q09(t: Tables) -> DataFrame:
    # the cost of a (part, supplier) is a minimum over these very rows, so a window takes it along
    cost = whole_cents(F.min(safe_divide(F.col("l_extendedprice"), F.col("l_quantity"))).over(Window.partitionBy("l_partkey", "l_suppkey")))
    lines = t.lineitem.join(t.part.filter("p_name LIKE '%gizmo%'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").withColumn("ps_supplycost", cost)
    return (
        lines.join(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("n_name", year(F.col("o_orderdate")).alias("o_year"))
        .agg(F.round(F.sum(revenue() - F.col("ps_supplycost") * F.col("l_quantity")), 4).alias("sum_profit"))
        .orderBy("n_name", F.desc("o_year"))
    )


@query("""
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(c_acctbal, 2) AS c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
def q10(t: Tables) -> DataFrame:
    orders = t.orders.filter(between("o_orderdate", "1996-10-01", "1997-01-01"))
    spent = t.lineitem.filter("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(total().alias("revenue"))
    return (
        spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "revenue", cents(F.col("c_acctbal")).alias("c_acctbal"), "n_name")
        .orderBy(F.desc("revenue"), "c_custkey")
        .limit(20)
    )


@query(f"""
WITH ps AS {PS}
SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS stock_value FROM ps, supplier, nation
WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1
GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) >
  (SELECT sum(ps_supplycost * ps_availqty) * 0.0001 FROM ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1)
ORDER BY stock_value DESC, ps_partkey""")
def q11(t: Tables) -> DataFrame:
    suppliers = t.supplier.join(t.nation.filter("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    # the suppliers are chosen before the stock is summed: fewer rows are shuffled
    lines = t.lineitem.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    stock = lines.groupBy("l_partkey", "l_suppkey").agg((whole_cents(F.min(safe_divide(F.col("l_extendedprice"), F.col("l_quantity")))) * F.sum("l_quantity")).alias("v"))
    parts = stock.groupBy(F.col("l_partkey").alias("ps_partkey")).agg(F.sum("v").alias("v"))
    floor = parts.agg((F.sum("v") * 0.0001).alias("floor"))  # one row
    return parts.join(F.broadcast(floor), F.col("v") > F.col("floor")).select("ps_partkey", cents(F.col("v")).alias("stock_value")).orderBy(F.desc("stock_value"), "ps_partkey")


@query("""
SELECT l_returnflag,
  CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem
WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
GROUP BY l_returnflag ORDER BY l_returnflag""")
def q12(t: Tables) -> DataFrame:
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        t.lineitem.filter(F.col("l_returnflag").isin("A", "R") & between("l_shipdate", "1996-01-01", "1997-01-01"))
        .join(t.orders, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderdate") < F.col("l_shipdate")))
        .groupBy("l_returnflag")
        .agg(F.sum(F.when(urgent, 1).otherwise(0)).alias("high_line_count"), F.sum(F.when(~urgent, 1).otherwise(0)).alias("low_line_count"))
        .orderBy("l_returnflag")
    )


@query("""
SELECT c_count, count(*) AS custdist FROM
  (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")
def q13(t: Tables) -> DataFrame:
    # counted before the join, so orders meet customers as one row each
    counts = t.orders.filter("o_orderpriority NOT LIKE '%URGENT%'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return (
        t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy(F.coalesce("n", F.lit(0)).cast("bigint").alias("c_count"))
        .agg(F.count(F.lit(1)).alias("custdist"))
        .orderBy(F.desc("custdist"), F.desc("c_count"))
    )


@query("""
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / nullif(sum(l_extendedprice * (1 - l_discount)), 0), 6) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""")
def q14(t: Tables) -> DataFrame:
    lines = t.lineitem.filter(between("l_shipdate", "1996-09-01", "1996-10-01")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    promo = F.when(F.col("p_type").like("PROMO%"), revenue()).otherwise(0.0)
    return lines.agg(F.round(safe_divide(F.sum(promo) * 100, F.sum(revenue())), 6).alias("promo_revenue"))


@query("""
SELECT s_suppkey, s_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM supplier, lineitem
WHERE s_suppkey = l_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01'
GROUP BY s_suppkey, s_name ORDER BY total_revenue DESC, s_suppkey LIMIT 1""")
def q15(t: Tables) -> DataFrame:
    sold = t.lineitem.filter(between("l_shipdate", "1996-01-01", "1996-04-01")).groupBy("l_suppkey").agg(total().alias("total_revenue"))
    return sold.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "total_revenue").orderBy(F.desc("total_revenue"), "s_suppkey").limit(1)


@query("""
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")
def q16(t: Tables) -> DataFrame:
    parts = t.part.filter((F.col("p_brand") != "Brand#5") & ~F.col("p_type").like("MEDIUM%") & F.col("p_size").isin(49, 14, 23, 45, 19, 3, 36, 9))
    # s_suppkey is a key and never NULL, and a NULL l_suppkey is out: NOT IN is an anti join then
    offers = t.lineitem.select("l_partkey", "l_suppkey").filter("l_suppkey IS NOT NULL").join(t.supplier.filter("s_acctbal < 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    return (
        offers.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand", "p_type", "p_size")
        .agg(F.count_distinct("l_suppkey").alias("supplier_cnt"))
        .orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")
    )


@query("""
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""")
def q17(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part.filter("p_brand = 'Brand#23'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    # few quantities a part: sums a part and quantity are made before the shuffle, and the mean is over these
    sums = lines.groupBy("l_partkey", "l_quantity").agg(F.sum("l_extendedprice").alias("price"), F.count("l_quantity").alias("n"))
    mine = Window.partitionBy("l_partkey")
    mean = F.sum(F.col("l_quantity") * F.col("n")).over(mine) / F.sum("n").over(mine)
    return sums.withColumn("mean", mean).filter("l_quantity < 0.2D * mean").agg(cents(F.sum("price") / 7.0).alias("avg_yearly"))


@query("""
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, round(o_totalprice, 2) AS o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
def q18(t: Tables) -> DataFrame:
    large = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).filter("q > 200")
    return (
        t.orders.join(large, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), cents(F.col("o_totalprice")).alias("o_totalprice"), cents(F.col("q")).alias("sum_qty"))
        .orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
        .limit(100)
    )


@query("""
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15 AND l_returnflag IN ('A', 'R'))
   OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 30 AND l_returnflag IN ('A', 'R'))
   OR (p_partkey = l_partkey AND p_brand = 'Brand#24' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 45 AND l_returnflag IN ('A', 'R'))""")
def q19(t: Tables) -> DataFrame:
    fits = F.lit(False)
    for brand, low, high, size in (("Brand#12", 1, 11, 15), ("Brand#23", 10, 20, 30), ("Brand#24", 20, 30, 45)):
        fits |= (F.col("p_partkey") == F.col("l_partkey")) & (F.col("p_brand") == brand) & F.col("l_quantity").between(low, high) & F.col("p_size").between(1, size) & F.col("l_returnflag").isin("A", "R")
    return t.lineitem.join(t.part, fits).agg(total().alias("revenue"))


@query(f"""
WITH ps AS {PS}
SELECT s_name FROM supplier, nation
WHERE s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%')
    AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'))
  AND s_nationkey = n_nationkey AND n_regionkey = 1
ORDER BY s_name""")
def q20(t: Tables) -> DataFrame:
    blue = t.lineitem.join(t.part.filter("p_name LIKE 'blue%'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    of_year = F.sum(F.when(between("l_shipdate", "1996-01-01", "1997-01-01"), F.col("l_quantity")))  # NULL without any, and then the pair is out
    enough = blue.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("all"), of_year.alias("part")).filter("all > 0.5D * part")
    near = t.supplier.join(t.nation.filter("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return near.join(enough, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_name").orderBy("s_name")


@query("""
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate
  AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate AND l3.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name""")
def q21(t: Tables) -> DataFrame:
    # "another supplier" is a question of an order's smallest and largest supplier key: one window over the join's own partitioning
    lines = t.lineitem.join(t.orders.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    order, late = Window.partitionBy("l_orderkey"), F.col("l_shipdate") > F.col("o_orderdate")
    failed = F.when(late & (F.col("l_returnflag") == "R"), F.col("l_suppkey"))
    seen = lines.select("l_suppkey", late.alias("late"), *[f(c).over(order).alias(n) for f, c, n in ((F.min, F.col("l_suppkey"), "lo"), (F.max, F.col("l_suppkey"), "hi"), (F.min, failed, "flo"), (F.max, failed, "fhi"))])
    alone = F.col("flo").isNull() | ((F.col("flo") == F.col("l_suppkey")) & (F.col("fhi") == F.col("l_suppkey")))
    waits = seen.filter(F.col("late") & (F.col("lo") != F.col("hi")) & alone).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return waits.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.sum("n").alias("numwait")).orderBy(F.desc("numwait"), "s_name")


@query("""
SELECT substr(c_name, 18, 1) AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE substr(c_name, 18, 1) IN ('1', '3', '5')
  AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND substr(c_name, 18, 1) IN ('1', '3', '5'))
  AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-01-01')
GROUP BY cntrycode ORDER BY cntrycode""")
def q22(t: Tables) -> DataFrame:
    chosen = t.customer.withColumn("cntrycode", F.substring("c_name", 18, 1)).filter(F.col("cntrycode").isin("1", "3", "5"))
    mean = chosen.filter("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))  # one row
    recent = t.orders.filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return (
        chosen.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean"))
        .join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
        .groupBy("cntrycode")
        .agg(F.count(F.lit(1)).alias("numcust"), cents(F.sum("c_acctbal")).alias("totacctbal"))
        .orderBy("cntrycode")
    )
