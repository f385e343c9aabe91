"""Edges of SQL semantics on hand-made rows: NULLs, joins, intervals, strings, division."""

import datetime
import math
import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cairn import catalog
from cairn.functions import like_any_case, safe_divide, shift, substring, text_of, trim_space
from cairn.operators import joins
from cairn.operators.joins import not_in


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(1, "a", 1.0), (None, "b", 2.0), (2, None, None), (1, "a", 1.0), (3, "A_%", 0.0)], "k int, v string, n double").createOrReplaceTempView("nulls")
    spark.createDataFrame([(1, 10), (2, 20), (2, 21), (None, 30), (4, 40)], "k int, v int").createOrReplaceTempView("left_")
    spark.createDataFrame([(1, 11), (2, 22), (2, 23), (None, 33), (5, 55)], "k int, v int").createOrReplaceTempView("right_")
    spark.createDataFrame([(1,), (None,)], "k int").createOrReplaceTempView("with_null")
    spark.createDataFrame([], "k int, v int").createOrReplaceTempView("empty")


def rows(spark, sql):
    return [tuple(r) for r in spark.sql(sql).collect()]


@pytest.mark.parametrize(
    ("sql", "wanted"),
    [
        ("SELECT count(*) FROM nulls WHERE k IS NULL", [(1,)]),
        ("SELECT count(*) FROM nulls WHERE k IS NOT NULL", [(4,)]),
        ("SELECT count(*) FROM nulls WHERE NOT (n > 1)", [(3,)]),
        ("SELECT count(*) FROM nulls WHERE n NOT BETWEEN 1 AND 2", [(1,)]),
        ("SELECT count(*), count(v), count(DISTINCT v) FROM nulls", [(5, 4, 3)]),
        ("SELECT DISTINCT k FROM nulls ORDER BY k", [(None,), (1,), (2,), (3,)]),
        ("SELECT k FROM nulls ORDER BY k DESC, n LIMIT 2", [(3,), (2,)]),
        ("SELECT sum(n), avg(n), min(v), max(v) FROM nulls WHERE k = 2", [(None, None, None, None)]),
        ("SELECT k, count(*) FROM nulls GROUP BY k ORDER BY k", [(None, 1), (1, 2), (2, 1), (3, 1)]),
        ("SELECT coalesce(v, 'none') FROM nulls WHERE k = 2", [("none",)]),
        ("SELECT CASE WHEN n > 1 THEN 'x' END FROM nulls WHERE k = 2", [(None,)]),
        ("SELECT k FROM with_null WHERE k NOT IN (SELECT k FROM right_)", []),
        ("SELECT k FROM left_ WHERE k NOT IN (SELECT k FROM empty) ORDER BY k", [(None,), (1,), (2,), (2,), (4,)]),
        ("SELECT l.v, r.v FROM left_ l JOIN right_ r ON r.k = l.k ORDER BY 1, 2", [(10, 11), (20, 22), (20, 23), (21, 22), (21, 23)]),
        ("SELECT l.v, r.v FROM left_ l LEFT JOIN right_ r ON l.k = r.k AND r.v > 22 ORDER BY 1, 2", [(10, None), (20, 23), (21, 23), (30, None), (40, None)]),
        ("SELECT l.v, e.v FROM left_ l LEFT JOIN empty e ON l.k = e.k WHERE l.k = 1", [(10, None)]),
        ("SELECT v FROM left_ l WHERE EXISTS (SELECT 1 FROM right_ r WHERE r.k = l.k AND r.v <> 22) ORDER BY v", [(10,), (20,), (21,)]),
        ("SELECT v FROM left_ l WHERE NOT EXISTS (SELECT 1 FROM right_ r WHERE r.k = l.k) ORDER BY v", [(30,), (40,)]),
        ("SELECT v FROM left_ WHERE v > (SELECT max(v) FROM empty)", []),
        ("SELECT l.v FROM left_ l WHERE l.v > (SELECT sum(r.v) FROM right_ r WHERE r.k = l.k)", []),
        ("SELECT v FROM left_ UNION ALL SELECT v FROM left_ WHERE k = 1 ORDER BY v LIMIT 2", [(10,), (10,)]),
        ("SELECT count(*) FROM left_, right_", [(25,)]),
        ("SELECT 'a' || 'b', CAST('12' AS INT) + 1, -(-3)", [("ab", 13, 3)]),
        ("SELECT substring('abcdef' FROM 2 FOR 3), substring('abcdef' FROM 5), substr('abcdef', 1, 2)", [("bcd", "ef", "ab")]),
        ("SELECT count(*) AS c FROM nulls HAVING count(*) > 9", []),
    ],
)
def test_sql(spark, views, sql, wanted):
    assert rows(spark, sql) == wanted


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT (SELECT v FROM left_)", "SCALAR_SUBQUERY_TOO_MANY_ROWS"),
        ("SELECT k FROM left_, right_", "AMBIGUOUS_REFERENCE"),
        ("SELECT k, v FROM left_ GROUP BY k", "MISSING_AGGREGATION|UNRESOLVED"),
        ("SELECT nothing_such(k) FROM left_", "UNRESOLVED_ROUTINE"),
        ("SELECT 1 / 0", "DIVIDE_BY_ZERO"),
        ("SELECT l.v FROM left_ l RIGHT right_ r", "PARSE_SYNTAX_ERROR"),
    ],
)
def test_errors(spark, views, sql, error):
    with pytest.raises(Exception, match=error):
        spark.sql(sql).collect()


def test_column_helpers(spark):
    day = datetime.date
    df = spark.createDataFrame([(day(1996, 1, 31), "\t Blue Gizmo\n", 1.0, 0.0), (day(1996, 2, 29), None, None, 2.0)], "d date, s string, a double, b double")
    got = df.select(
        shift(F.col("d"), months=1).alias("m"), shift(F.col("d"), years=1).alias("y"), shift(F.col("d"), days=-90).alias("b"),
        trim_space(F.col("s")).alias("t"), like_any_case(F.col("s"), "%GIZMO%").alias("l"), safe_divide(F.col("a"), F.col("b")).alias("q"),
        substring(F.col("s"), 3, 4).alias("u"), text_of(F.col("s"), F.lit("!")).alias("c"),
    ).collect()
    assert tuple(got[0]) == (day(1996, 2, 29), day(1997, 1, 31), day(1995, 11, 2), "Blue Gizmo", True, None, "Blue", "\t Blue Gizmo\n!")
    assert tuple(got[1]) == (day(1996, 3, 29), day(1997, 2, 28), day(1995, 12, 1), None, None, None, None, None)
    with pytest.raises(ValueError, match="start at 1"):
        substring(F.col("s"), 0)


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    sets = {"plain": [(1,)], "with null": [(1,), (None,)], "empty": []}
    got = {name: sorted(str(r.k) for r in not_in(left, "k", spark.createDataFrame(rows, "v int"), "v").collect()) for name, rows in sets.items()}
    assert got == {"plain": ["2"], "with null": [], "empty": ["1", "2", "None"]}


def test_queries_leave_no_views(spark, small):
    before = {t.name for t in spark.catalog.listTables()}
    for name in ("not_in_subquery", "join_comma_list", "exists_uncorrelated", "sql_q03", "read_folder_of_tables"):
        catalog.QUERIES[name](spark, small).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_theta_join_without_equality(spark):
    """NULLs, ties, repeated rows, NaN (above all numbers) and infinities against each pair by itself; no run is longer than its bound."""
    rng = random.Random(5)
    balances = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, *[float(i) for i in range(9)]]
    some = lambda n: [(rng.choice([None, *range(n)]), rng.choice([None, 1, 2, 3]), rng.choice(balances)) for _ in range(n)]
    left, right = some(300) + [(i, 1, 5.0) for i in range(1000)], some(60)
    t = SimpleNamespace(spark=spark, supplier=spark.createDataFrame(left, "s_suppkey long, s_nationkey int, s_acctbal double"), customer=spark.createDataFrame(right, "c_custkey long, c_nationkey int, c_acctbal double"))
    above = lambda a, b: a is not None and b is not None and (a > b or (math.isnan(a) and not math.isnan(b)))
    wanted = Counter((s, c) for s, sn, sb in left for c, cn, cb in right if above(sb, cb) and None not in (sn, cn) and sn != cn)
    got = joins.join_theta_without_equality(t)
    assert got.columns == ["s_suppkey", "c_custkey"]
    assert Counter(map(tuple, got.collect())) == wanted
    sizes = [r["n"] for r in joins._runs(t.supplier).select(F.size("keys").alias("n")).collect()]
    assert max(sizes) <= 128 and sum(sizes) == sum(None not in r[1:] for r in left)
    for none in ({"supplier": t.supplier.limit(0)}, {"customer": t.customer.limit(0)}):
        assert joins.join_theta_without_equality(SimpleNamespace(**(vars(t) | none))).count() == 0


def test_theta_join_packs_well(spark, tmp_path):
    """Its result is written whole, far larger than its inputs: less than a third of a byte of Parquet a row."""
    number = lambda n, k: ((F.col("id") * k) % n / 7).cast("double")
    supplier = spark.range(10_000).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).cast("int").alias("s_nationkey"), number(5000, 37).alias("s_acctbal"))
    customer = spark.range(3000).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey"), number(5000, 11).alias("c_acctbal"))
    got = joins.join_theta_without_equality(SimpleNamespace(spark=spark, supplier=supplier, customer=customer))
    got.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    wanted = supplier.join(F.broadcast(customer.groupBy("c_nationkey", "c_acctbal").agg(F.count(F.lit(1)).alias("n"))), (F.col("s_acctbal") > F.col("c_acctbal")) & (F.col("s_nationkey") != F.col("c_nationkey")))
    assert rows.count() == rows.distinct().count() == wanted.agg(F.sum("n")).first()[0]
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < rows.count() / 3
