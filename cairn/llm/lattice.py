"""Near-duplicate vectors by E8 lattice hashing."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_pieces, shuffles_freed, small_batches, split_join, table
from .links import blocks, components, verify

#: The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs.
_PAIRS = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
_HALVES = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
ROOTS = np.array(_PAIRS + _HALVES)
_ROOTS_T = ROOTS.T.astype(np.float32)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.arange(len(x))
    flipped = near.copy()
    flipped[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return np.where((near.sum(1) % 2 != 0)[:, None], flipped, near)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: E8 is D8 and D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class LatticeHash:
    """Tables of hashed cells: unit vectors, projected to ``blocks`` times 8 axes, decoded block by block.

    Cell keys of a table are those of the vector's own lattice points and of the ``probes``
    nearest neighbouring cells, in which one block's point is replaced by an adjacent one.
    """

    def __init__(self, dim: int, tables: int, blocks: int, width: float, probes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.tables, self.blocks, self.width, self.probes = tables, blocks, width, probes
        self.axes = rng.standard_normal((tables, dim, blocks * 8)) / width
        self.shift = rng.uniform(-1, 1, (tables, blocks * 8))
        self.mult = rng.integers(1, 1 << 62, (tables, blocks * 8), dtype=np.int64) | 1

    def keys(self, unit: np.ndarray, of: list[int] | None = None) -> np.ndarray:
        """(rows, tables, 1 + probes) signed 64-bit cell keys, of all tables or those given."""
        of = list(range(self.tables)) if of is None else of
        out = np.empty((len(unit), len(of), 1 + self.probes), np.int64)
        for i, t in enumerate(of):
            x = (unit @ self.axes[t] + self.shift[t]).reshape(-1, 8)
            point = decode(x)
            mult = self.mult[t].reshape(self.blocks, 8)
            with np.errstate(over="ignore"):
                base = (2 * point).astype(np.int64).reshape(-1, self.blocks * 8) @ self.mult[t] + self.mult[t, 0] * (t + 1)
                out[:, i, 0] = base
                if self.probes:
                    gap = ((point - x).astype(np.float32) @ _ROOTS_T).reshape(len(unit), -1)  # the smaller, the nearer that neighbour is
                    best = np.argpartition(gap, self.probes - 1, 1)[:, : self.probes]
                    step = (2 * ROOTS).astype(np.int64) @ mult.T  # (240, blocks)
                    out[:, i, 1:] = base[:, None] + step[best % 240, best // 240]
        return out


class Sketch:
    """Signs of 256 random projections; the share of them that differ tells the angle of two vectors."""

    def __init__(self, dim: int, threshold: float, seed: int = 12):
        self.planes = np.random.default_rng(seed).standard_normal((dim, 256)).astype(np.float32)
        p = np.arccos(np.clip(threshold, -1, 1)) / np.pi
        #: Bits that differ at most: five deviations beyond what they are at the threshold, which a pair exceeds about once in a million.
        self.most = 256 * p + 5 * np.sqrt(256 * p * (1 - p)) + 1

    def bits(self, unit: np.ndarray) -> np.ndarray:
        """(rows, 4) of 64 bits."""
        return np.packbits(unit.astype(np.float32) @ self.planes > 0, axis=1).view(np.int64)


def partnered(key: np.ndarray, bits: np.ndarray, most: float, crowd: int = 256) -> np.ndarray:
    """Which rows have another one of the same key, by which they are sorted, that differs in ``most`` bits or fewer."""
    apart = lambda a, b: np.bitwise_count((a ^ b).view(np.uint64)).sum(-1)  # of a negative number it would count its absolute value's
    found = np.zeros(len(key), bool)
    cuts = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1, append=key[-1:] ^ 1))
    sizes = np.diff(cuts)
    at = np.arange(len(key))[np.repeat((sizes > 1) & (sizes <= crowd), sizes)]
    end = np.repeat(cuts[1:], sizes)
    step = 1
    while len(at := at[at + step < end[at]]):
        near = at[apart(bits[at], bits[at + step]) <= most]
        found[near] = found[near + step] = True
        step += 1
    for a, b in zip(cuts[:-1][sizes > crowd], cuts[1:][sizes > crowd], strict=True):
        alone = np.arange(a, b)
        for c in range(a, b, crowd):
            others = np.arange(c, min(c + crowd, b))
            for part in np.array_split(alone, -(-len(alone) // crowd)) if len(alone) else []:
                found[part] |= ((apart(bits[part][:, None], bits[others]) <= most) & (part[:, None] != others)).any(1)
            alone = alone[~found[alone]]
    return found


def meetings(batches, most: float, rows: int = 1 << 15, hot: int = 1 << 16):
    """Of (key, id, s0 ... s3) rows sorted by key those with a partner, as (id, key); of a key of more than ``hot`` rows all."""
    kept = lambda a, some: pa.RecordBatch.from_arrays([pa.array(a[some, 1]), pa.array(a[some, 0])], names=["id", "key"])
    held: list[np.ndarray] = []
    whole = None
    for batch in in_pieces(batches, rows=rows):
        a = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        if whole is not None:
            n = int(np.searchsorted(a[:, 0], whole, "right"))
            yield kept(a, slice(0, n))
            a, whole = a[n:], whole if n == len(a) else None
        held.append(a)
        if sum(map(len, held)) < rows:
            continue
        a = np.concatenate(held)
        cut = int(np.searchsorted(a[:, 0], a[-1, 0]))
        if cut:
            yield kept(a, np.flatnonzero(partnered(a[:cut, 0], a[:cut, 2:], most)))
        held = [a[cut:]]
        if len(a) - cut > hot:
            whole = a[-1, 0]
            yield kept(a, slice(cut, None))
            held = []
    if sum(map(len, held)):
        a = np.concatenate(held)
        yield kept(a, np.flatnonzero(partnered(a[:, 0], a[:, 2:], most)))


def link_vectors(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = 0.9, tables: int = 12, lattices: int = 4, width: float = 2.6, probes: int = 6, chunk: int = 512
) -> DataFrame:
    """Link vectors of cosine ``threshold`` or more and find the groups that links make.

    Candidates share a cell, its own or a probed neighbouring one, in one of ``tables`` tables;
    at cosine 0.9 the defaults find 97 of 100 pairs of independent direction, at 0.95 all but a
    few of ten thousand, with 84 keys a vector; of unlike pairs in 64 dimensions 6 in 100,000
    share a cell. Such pairs grow with the square of the table; they are compared by sketches where
    they meet, and only vectors whose sketches are near go on to be verified by cosine in double
    precision, block by block. Tables are hashed one after another, so cell keys
    of one table at a time are on disk.
    Equal vectors are hashed and verified once, and count with their number. While it runs, the
    session frees shuffle files as soon as a query ends.

    Returns key, n_links (other vectors linked directly), component_id (smallest key reachable,
    the row's own included) and kept (key = component_id). Vectors that are null, zero or hold
    null or non-finite components, or differ in length from the most frequent one, link with
    nothing. Rows of the same key are vectors of their own; null keys get no component of
    others. Only the key and the vector are read, so other columns don't clash. An empty table
    gives an empty one.
    """
    with shuffles_freed(vectors.sparkSession):
        return _link(vectors, key, column, threshold, tables, lattices, width, probes, chunk)


def _link(vectors: DataFrame, key: str, column: str, threshold: float, tables: int, lattices: int, width: float, probes: int, chunk: int) -> DataFrame:
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[column].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).alias("key"), F.col(column).cast(kind).alias("vec"))
    sound = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    length = rows.filter(sound).groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = length["n"] if length else 0
    usable = F.coalesce(sound & (F.size("vec") == dim), F.lit(False))
    digest = {"d1": F.xxhash64("vec"), "d2": F.xxhash64(F.lit(1), "vec")}  # 128 bits stand for a vector where rows meet their class
    hashed, sketch = (LatticeHash(dim, tables, lattices, width, probes), Sketch(dim, threshold)) if dim else (None, None)
    number = np.float32 if kind == "array<float>" else np.float64

    def packed(batches):
        """The components as bytes, which are cheaper to send and read again and again."""
        for batch in in_pieces(batches, rows=1024):
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(number).reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([v.tobytes() for v in x], pa.binary())], names=batch.schema.names)

    def unit(batch) -> np.ndarray:
        x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), number).reshape(batch.num_rows, dim).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    small_batches(spark)
    classes = rows.filter(usable).groupBy("vec").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("weight")).withColumn("id", F.monotonically_increasing_id()).withColumns(digest)
    classes = classes.select("id", "first", "weight", "d1", "d2", "vec")
    classes = table(classes.mapInArrow(packed, T.StructType([*classes.schema.fields[:-1], T.StructField("vec", T.BinaryType())])), "classes")

    def cells(t: int):
        def work(batches):
            for batch in in_pieces(batches, rows=1024):
                x = unit(batch)
                keys = hashed.keys(x, [t]).reshape(batch.num_rows, -1)
                each = [batch.column("id").to_numpy(), *sketch.bits(x).T]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(np.repeat(c, keys.shape[1])) for c in each]], names=["key", "id", "s0", "s1", "s2", "s3"])

        return work

    def meet(batches):
        yield from meetings(batches, sketch.most if sketch else 0)

    shared = []
    for t in range(tables if dim else 1):  # one table at a time, whose shuffle goes before the next one's is written
        dealt = classes.select("id", "vec").mapInArrow(cells(t), "key long, id long, s0 long, s1 long, s2 long, s3 long").repartition("key").sortWithinPartitions("key")
        shared.append(table(dealt.mapInArrow(meet, "id long, key long"), "cells"))
    tasks = blocks(functools.reduce(DataFrame.unionByName, shared), chunk)

    def near(task: pa.Table) -> np.ndarray:
        x = unit(task)
        return x @ x.T >= threshold

    found = table(verify(split_join(tasks, classes.select("id", "weight", "vec"), ["id"]), near), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found, "id", "root")
    named = split_join(split_join(classes.select("id", "first", "weight"), counts, ["id"], "left"), roots, ["id"], "left")
    named = table(named.select("id", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = split_join(named, smallest, ["root"]).select("id", "n_links", "component_id")
    labelled = split_join(classes.select("id", "d1", "d2"), named, ["id"]).drop("id")
    mine = split_join(rows.filter(usable).withColumns(digest).drop("vec"), labelled, ["d1", "d2"])
    alone = rows.filter(~usable).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = mine.select("key", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))
