"""Shared helpers: written tables in the cluster's shared folder, skew-safe joins, bounded Arrow slices and caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

if TYPE_CHECKING:
    import pyarrow as pa

def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the store in which Spark finds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a write or action has shuffled leaves the disk at its end.

    Else shuffle files stay until the driver's JVM happens to collect its garbage, so those of all steps stand beside each other. Only
    for steps that read each other's written tables, since nothing that was shuffled can be used again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that adaptive execution may split at hot keys.

    A side that was just aggregated on the key would reuse that partitioning and then cannot be
    split; the derived key makes each side bring an exchange of its own.
    """
    key = "__join_key"
    if len(on) == 1 and all(df.schema[on[0]].dataType.simpleString() == "bigint" for df in (left, right)):
        turn = lambda c: F.bitwise_not(F.col(c))  # noqa: E731  of a number the key itself will do, turned over and back
        turned = lambda df: df.withColumn(key, turn(on[0])).drop(on[0])
        joined = turned(left).join(turned(right), key, how).withColumn(on[0], turn(key)).drop(key)
        rest = [c for c in right.columns if c != on[0]] if how not in ("left_semi", "left_anti") else []
        return joined.select(*on, *[c for c in left.columns if c != on[0]], *rest)
    hashed = lambda df: df.withColumn(key, F.xxhash64(*[F.col(c) for c in on]))
    return hashed(left).join(hashed(right), [key, *on], how).drop(key)


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 16 << 20) -> None:
    """Lower the session's bounds of what one Arrow batch sends to a Python worker, never raise them.

    All operators ask for the same bounds, so their order doesn't matter. Spark has no bound for
    a single operator, and its default lets a task hold 10,000 texts at once, in the JVM and in
    Python; what a function works on at a time, it bounds itself by :func:`in_pieces`.
    """
    for name, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name)
        units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
        given = re.fullmatch(r"(-?\d+)\s*([bkmg]?)b?", now.strip().lower())
        if given is None or not 0 < int(given[1]) * units[given[2] or "b"] <= bound:
            spark.conf.set(name, str(bound))


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most ``rows`` rows, or about ``size`` bytes where a row isn't larger itself.

    A task works on one slice at a time, so its lists and arrays are bounded. At the end of the task its memory goes back to the system, since workers
    live on for other stages.
    """
    try:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(rows, batch.num_rows - at)
                while n > 1 and batch.slice(at, n).get_total_buffer_size() > size and batch.slice(at, n).nbytes > size:
                    n //= 2
                yield batch.slice(at, n)
                at += n
    finally:
        tidy()


def tidy() -> None:
    """Give back what this worker no longer uses."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_KEPT: dict[Any, Any] = {}


def kept(name: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by the worker for later tasks of the same ``name``; one thing at a time."""
    if name not in _KEPT:
        _KEPT.clear()
        tidy()
        _KEPT[name] = make()
    return _KEPT[name]


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or with as many underscores before it as set it apart from the ``taken`` ones (case doesn't)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
