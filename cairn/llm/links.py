"""Candidate blocks from shared hash keys, links verified in blocks, and connected components.

A pair of items is a candidate if the two share a key. Instead of emitting pairs, each item gets
a home, the smallest item in any of its buckets, and homes are cut into chunks. A task holds two
chunks whose homes meet in a bucket, so every candidate pair lies in exactly one task, tasks have
a bounded size, and copies without number cost no more than their chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, split_join, table


def blocks(keys: DataFrame, chunk: int, sizes_of: DataFrame | None = None, chunk_bytes: int = 1) -> DataFrame:
    """(task, side, id) rows from (id, key) rows, read twice: tasks of at most two chunks of about ``chunk`` items.

    With ``sizes_of`` (id, size) a chunk has about ``chunk_bytes`` of them at most, or one item.

    Side 0 and 1 are different chunks, whose pairs run across; a task with side 0 alone is a
    chunk against itself. Items that share no key with another one are in no task.

    Homes that meet in a bucket are paired there. These are never more pairs than the bucket has
    pairs of items, each of which some task compares, and one number a pair instead of vectors.
    """
    buckets = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = table(split_join(keys, buckets, ["key"]), "shared")
    homes = shared.groupBy("id").agg(F.min("leader").alias("home"))
    sized = homes.withColumn("size", F.lit(0)) if sizes_of is None else split_join(homes, sizes_of, ["id"])
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("size") / chunk_bytes)).cast("int")
    sizes = table(sized.groupBy("home").agg(chunks.alias("chunks"), F.count(F.lit(1)).alias("n")), "homes")
    members = split_join(homes, sizes, ["home"]).select("id", "home", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("c"))
    members = table(members, "members")

    met = split_join(shared.select("id", "key"), members.select("id", "home"), ["id"]).select("key", "home").distinct()
    crowded = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    met = table(split_join(met, crowded, ["key"]), "met")
    left, right = met.select("key", F.col("home").alias("l")), met.select("key", F.col("home").alias("r"))
    pairs = split_join(left, right, ["key"]).filter("l < r").select("l", "r").distinct().unionByName(sizes.filter("n > 1").select(F.col("home").alias("l"), F.col("home").alias("r")))
    count = lambda side: sizes.select(F.col("home").alias(side), F.col("chunks").alias(f"c{side}"))
    tasks = split_join(split_join(pairs, count("l"), ["l"]), count("r"), ["r"])
    tasks = tasks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cl") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cr") - 1)))
    tasks = table(tasks.filter("l != r or i <= j").select("l", "i", "r", "j").withColumn("task", F.monotonically_increasing_id()), "tasks")

    first = tasks.select("task", F.lit(0).alias("side"), F.col("l").alias("home"), F.col("i").alias("c"))
    second = tasks.filter("l != r or i != j").select("task", F.lit(1).alias("side"), F.col("r").alias("home"), F.col("j").alias("c"))
    return split_join(first.unionByName(second), members, ["home", "c"]).select("task", "side", "id")


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tasks out of a stream that is sorted by task."""
    held: list[pa.RecordBatch] = []
    for batch in in_pieces(batches, rows=1024):
        whole = pa.Table.from_batches([*held, batch]).combine_chunks()
        task = whole.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield whole.slice(a, b - a)
        held = whole.slice(cuts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row reaches in a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def verify(rows: DataFrame, linked: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """(id, links, root) of the items that have a link in a task; rows of the same id and task are one item.

    ``rows`` has task, side, id, weight and what ``linked`` needs to say, for a task, which of its
    items link (a symmetric boolean matrix). ``links`` sums the weights of the linked items,
    ``root`` is the smallest id that an item reaches within the task: one row an item and task.
    """

    def work(batches):
        for t in _tasks(batches):
            t = t.take(np.unique(t.column("id").to_numpy(), return_index=True)[1])  # an item that came twice counts once
            side, ids, weight = (t.column(c).to_numpy() for c in ("side", "id", "weight"))
            pairs = linked(t)
            np.fill_diagonal(pairs, False)
            if side.any():
                pairs &= side[:, None] != side[None, :]
            links = pairs @ weight
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[_roots(pairs)[some]])], names=["id", "links", "root"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(work, "id long, links long, root long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root): the smallest id that each node of ``edges`` reaches.

    Alternates large-star and small-star steps until no edge changes; every step is a grouped
    minimum and a join that may be split at hubs, and every round is cut off by a written table.
    """
    edge = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = table(edge(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    last = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, ["u"]).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = table(edge(small), "edges")
        mark_now = mark(now)
        if mark_now == last:
            roots = now.groupBy("u").agg(F.min("v").alias("root"))
            return roots.select(F.col("u").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
        last = mark_now
