"""Balanced contiguous shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table


def balanced_shards(df: DataFrame, size: str, order: list[str], shards: int) -> DataFrame:
    """Cut ``df``, ordered by ``order``, into ``shards`` contiguous ranges of near-equal total ``size``.

    Adds ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within a shard). A row belongs
    to the shard in whose equal slice of the total the middle of the row falls, so a shard is off
    its target by one row's size at most. Totals of the range partitions, one row each, are the
    only thing that is broadcast. Null or negative sizes count as 0; rows whose order columns are
    null come first; rows equal in the order columns are kept apart by a running number, so a
    third of all rows may share one key. Columns of ``df`` named as the results give way to them.
    An empty input gives an empty result.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    parts = partitions(spark)
    weight = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    keys = [f"k{i}" for i in range(len(order))]
    # the rows' own columns are one struct, so no name of theirs meets one of these
    numbered = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], weight.alias("w"), F.monotonically_increasing_id().alias("tie"))
    placed = table(numbered.repartitionByRange(parts, *keys, "tie").withColumn("part", F.spark_partition_id()), "ranges")

    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("w").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*keys, "tie")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (F.col("bytes_ahead") + F.sum("w").over(running)) * 2 - F.col("w")
    cut = F.floor(F.try_divide(middle * F.lit(float(shards)), F.col("total") * 2))
    rows = placed.join(F.broadcast(offsets), "part").select(
        "own",
        F.least(F.coalesce(cut, F.lit(0)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_ahead") + F.row_number().over(inside) - 1).alias("row"),
    )
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first"))
    return rows.join(F.broadcast(firsts), "shard").select("own.*", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))
