"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, kept, small_batches, split_join, table
from .links import blocks, components, verify

WORD = re.compile(r"[^\W_]+")
#: Hashes of words that a worker keeps.
CACHE = 100_000
#: Bytes of gram sets in a chunk of candidates, about; a task holds two chunks.
CHUNK_BYTES = 8 << 20


def choose_bands(threshold: float, recall: float, most_rows: int = 12) -> tuple[int, int]:
    """Bands and rows with which a pair at ``threshold`` shares a band with probability ``recall`` at least.

    Of the settings that reach it, that with the fewest candidates at half the threshold, costs
    of the hash functions counted too.
    """
    best = None
    for rows in range(1, most_rows + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        cost = 1 - (1 - (threshold / 2) ** rows) ** bands + bands * rows / 500
        if best is None or cost < best[0]:
            best = cost, bands, rows
    return best[1], best[2]


class Sketcher:
    """N-gram sets as sorted 64-bit hashes, and their MinHash bands."""

    def __init__(self, n: int, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.n, self.bands, self.rows, self.words = n, bands, rows, {}
        self.mult = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.mix = rng.integers(1, 1 << 63, max(n, rows), dtype=np.uint64) | np.uint64(1)

    def grams(self, text: str | None) -> np.ndarray:
        """Distinct hashes of all runs of n words; of a shorter text that of all its words."""
        words, known = WORD.findall((text or "").lower()), self.words
        if not words:
            return np.empty(0, np.uint64)
        if len(known) > CACHE:
            known.clear()
        ids = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            ids.append(h)
        h = np.array(ids, np.uint64)
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = (out ^ h[k : len(h) - n + 1 + k]) * self.mix[k]
                out ^= out >> np.uint64(29)
        return np.unique(out)

    def minima(self, grams: np.ndarray) -> np.ndarray:
        """One signed key per band; long sets are worked through in slices."""
        least = np.full(len(self.mult), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(grams), 2048):
                x = grams[at : at + 2048, None] * self.mult + self.add
                x ^= x >> np.uint64(31)
                least = np.minimum(least, x.min(0))
            keys = np.arange(1, self.bands + 1, dtype=np.uint64) * self.mult[0]
            for k in range(self.rows):
                keys = (keys ^ least.reshape(self.bands, self.rows)[:, k]) * self.mix[k]
                keys ^= keys >> np.uint64(32)
        return keys.view(np.int64)


def _name(grams: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return xxhash.xxh128_digest(grams.tobytes())


def overlaps(task: pa.Table, threshold: float, columns: int = 4096) -> np.ndarray:
    """Which sets of a task have a Jaccard similarity of at least ``threshold``; exact counts."""
    sets = [np.frombuffer(b, np.uint64) for b in task.column("grams").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often[column] > 1
    owner, column = owner[common], column[common]
    rank = np.cumsum(often > 1) - 1
    column = rank[column]
    both = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, columns):
        a, b = np.searchsorted(column, (at, at + columns))
        slab = np.zeros((len(sets), min(columns, total - at)), np.float32)
        slab[owner[a:b], column[a:b] - at] = 1
        both += slab @ slab.T
    union = sizes[:, None] + sizes[None, :] - both
    return both >= threshold * union - 1e-9


def jaccard_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995, chunk: int = 256
) -> DataFrame:
    """Link documents whose sets of ``n``-word grams have a Jaccard similarity of ``threshold`` or more.

    Words are runs of letters and digits in lower case; a text of fewer than ``n`` words has one
    gram of them all, and one without words links with nothing. Bands and rows are chosen so that
    a pair at the threshold shares a band with probability ``recall``. Equal sets form a class
    that is sketched and verified once; links of a document are the documents of other linked
    classes and the others of its own.

    Returns key, class_id (smallest key that links reach, the document's own included), n_links
    (long) and kept (key = class_id). Rows that repeat a key are documents of their own; a null
    key gets the class of the rest. Whole texts count, and tasks are cut by the bytes of their
    gram sets, so that a task holds two chunks of about CHUNK_BYTES, or its longest text. Only
    the key and the text are read of ``docs``. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    rowed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rowed.schema["key"].dataType.simpleString()
    small_batches(spark)

    def sketcher() -> Sketcher:
        return kept(("sketcher", n, bands, rows), lambda: Sketcher(n, bands, rows))

    def sketch(batches):
        s = sketcher()
        for batch in in_pieces(batches):
            names, keys, sizes = [], [], []
            for t in batch.column("text").to_pylist():
                g = s.grams(t)
                names.append(_name(g) if len(g) else None)
                keys.append(s.minima(g) if len(g) else None)
                sizes.append(g.nbytes)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["key", "name", "bands", "size"])

    sketches = table(rowed.mapInArrow(sketch, f"key {key_type}, name binary, bands array<long>, size long"), "sketches")
    classes = sketches.filter("name is not null").groupBy("name").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("weight"), *[F.first(c).alias(c) for c in ("bands", "size")])
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    tasks = table(blocks(classes.select("id", F.explode("bands").alias("key")), chunk, classes.select("id", "size"), CHUNK_BYTES), "blocks")

    # the text of a class is read again at its smallest key; other texts of that key differ in name
    sought = split_join(classes.select("id", "name", "first", "weight"), tasks.select("id").distinct(), ["id"])
    sought = table(sought, "sought")
    place = lambda c: F.xxhash64(F.col(c).isNull(), c).alias("at")  # noqa: E731  null keys too; Spark broadcasts or shuffles by size
    texts = split_join(rowed.select("text", place("key")), sought.select(place("first")).distinct(), ["at"], "left_semi")

    def read(batches):
        s, seen = sketcher(), set()
        for batch in in_pieces(batches):
            names, sets = [], []
            for t in batch.column("text").to_pylist():
                g = s.grams(t)
                name = _name(g)
                if name not in seen:  # rows that repeat a key and its text
                    seen.add(name)
                    names.append(name)
                    sets.append(g.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["name", "grams"])

    sets = texts.select("text").mapInArrow(read, "name binary, grams binary")
    named = split_join(tasks, sought.select("id", "name", "weight"), ["id"])
    found = table(verify(split_join(named, sets, ["name"]).drop("name"), lambda t: overlaps(t, threshold)), "links")

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found, "id", "root")
    named = split_join(split_join(classes.select("id", "name", "first", "weight"), counts, ["id"], "left"), roots, ["id"], "left")
    named = table(named.select("name", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("class_id"))
    named = split_join(named, smallest, ["root"]).select("name", "n_links", "class_id")
    out = split_join(sketches.select("key", "name"), named, ["name"], "left")
    mine = F.when(F.col("name").isNull(), F.col("key")).otherwise(F.col("class_id"))
    return out.select(F.col("key").alias(key), mine.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("key") == mine, F.col("key").isNull() & mine.isNull()).alias("kept"))
