"""Balanced contiguous shards."""

from collections import defaultdict

from pyspark.sql import functions as F

from cairn.llm.sharding import balanced_shards


def brute(sizes, shards):
    """Shard of each of the ordered sizes: where the middle of the row falls."""
    total, at, out = sum(sizes), 0, []
    for s in sizes:
        out.append(min(shards - 1, (2 * at + s) * shards // (2 * total)) if total else 0)
        at += s
    return out


def test_contiguous_and_balanced(spark):
    rows = [(i, 1 + i * 37 % 101 + (5000 if i == 40 else 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, size long").repartition(7)
    got = sorted(map(tuple, balanced_shards(df, "size", ["k"], 24).select("k", "shard", "slot").collect()))
    assert [g[1] for g in got] == brute([s for _, s in rows], 24)
    slots = defaultdict(list)
    for _, shard, slot in got:
        slots[shard].append(slot)
    assert all(v == list(range(len(v))) for v in slots.values())


def test_one_key_of_many_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("k"), F.lit(10).cast("long").alias("size"))
    got = balanced_shards(df, "size", ["k"], 10).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {300}


def test_edges(spark):
    rows = [(1, None), (None, 5), (2, -3), (3, 0), (3, 0), (None, 5)]
    df = spark.createDataFrame(rows, "k long, size long").withColumns({"shard_": F.lit(1), "__x": F.lit(2)})
    got = balanced_shards(df, "size", ["k"], 4)
    assert got.count() == 6
    assert got.filter("shard < 0 or shard > 3").count() == 0
    assert balanced_shards(df.limit(0), "size", ["k"], 4).count() == 0
    zero = balanced_shards(df.filter("k = 3"), "size", ["k"], 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in zero) == [(0, 0), (0, 1)]
    clash = balanced_shards(df.withColumn("shard", F.lit("old")).withColumn("slot", F.lit("old")), "size", ["k"], 4)
    assert clash.columns.count("shard") == 1
    assert clash.schema["shard"].dataType.simpleString() == "int"
