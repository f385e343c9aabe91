"""E8 hashing: decoding, recall, and the links and components of vectors."""

import itertools

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm.lattice import ROOTS, Sketch, decode, link_vectors, meetings, partnered
from cairn.sources.scratch import shared_dir

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept), components over rows."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    n = len(rows)
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and unit[i] @ unit[j] >= threshold] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((rows[i][0], len(links[i]), root[i], rows[i][0] == root[i]) for i in range(n)), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_decode_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (200, 8))
    near = decode(x)
    assert np.allclose(near * 2, np.rint(near * 2))
    assert ROOTS.shape == (240, 8)
    assert np.allclose((ROOTS**2).sum(1), 2)
    own = ((x - near) ** 2).sum(1)
    for step in ROOTS:  # no neighbour is nearer
        assert (((x - near - step) ** 2).sum(1) >= own - 1e-9).all()


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(0, 1, (400, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.filter("vec_id < 400 AND n_links >= 1").count() >= 0.95 * 400


def test_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (30, 16))
    x = centres[rng.integers(0, 30, 600)] + rng.normal(0, 0.12, (600, 16))
    x[100:350] = x[3]  # many copies
    x[:, 0] += 0.3
    rows = [(int(i * 3), v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    assert rows_of(link_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk=64)) == brute(rows)


def test_chain(spark):
    turn = np.deg2rad(20)
    rows = [(k, [float(np.cos(k * turn)), float(np.sin(k * turn))]) for k in range(9)]
    got = rows_of(link_vectors(spark.createDataFrame(rows[::-1], SCHEMA)))
    assert got == brute(rows)
    assert {r[2] for r in got} == {0}


def test_edges(spark):
    nan = float("nan")
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, []), (9, [0.0, -1.0]), (10, [1e-30, 0.0]), (11, [3e38, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "weight": F.lit(0), "kept": F.lit(None).cast("int"), "key": F.lit(1), "n_links": F.lit(9)})
    assert rows_of(link_vectors(df)) == brute(rows)
    twice = rows_of(link_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])], SCHEMA)))
    assert twice == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    nulls = rows_of(link_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [1.0, 0.0])], SCHEMA)))
    assert [r[:3] for r in nulls] == [(2, 1, 2), (None, 0, None), (None, 1, 2)]
    assert link_vectors(df.limit(0)).count() == 0
    assert rows_of(link_vectors(df.filter("vec_id in (2, 4)"))) == [(2, 0, 2, True), (4, 0, 4, True)]


def test_all_pairs_of_small_angles(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, 32)
    x = base + rng.normal(0, 0.05, (60, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(unit[i] @ unit[j] > 0.9 for i, j in itertools.combinations(range(60), 2))
    assert {r[1] for r in rows_of(link_vectors(spark.createDataFrame(rows, SCHEMA), chunk=8))} == {59}


def test_zeros_of_either_sign_are_equal(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [-0.0, -1.0])]
    assert rows_of(link_vectors(spark.createDataFrame(rows, SCHEMA))) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_disk_follows_the_table(spark, tmp_path):
    """What stays in the shared folder and among Spark's shuffle files, once candidates are found, is less than twice the input."""
    x = np.random.default_rng(6).normal(0, 1, (12_000, 64)).astype(np.float32)
    x[:50] = x[50:100] * 1.5
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).write.parquet(str(tmp_path / "in"))
    size = lambda top: sum(f.stat().st_size for f in Path(top).rglob("*") if f.is_file())
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    places, was = (shared_dir(spark), spark.sparkContext.getConf().get("spark.local.dir")), spark.conf.get(conf, None)
    before = sum(map(size, places))
    got = link_vectors(spark.read.parquet(str(tmp_path / "in")))
    assert sum(map(size, places)) - before < 2 * size(tmp_path / "in")
    assert spark.conf.get(conf, None) == was
    assert got.filter("n_links = 1").count() == 100


def brute_partners(key, bits, most):
    far = np.array([[bin(int.from_bytes((a ^ b).tobytes(), "little")).count("1") for b in bits] for a in bits])
    return ((key[:, None] == key) & (far <= most) & ~np.eye(len(key), dtype=bool)).any(1)


@pytest.mark.parametrize(("keys", "crowd"), [(300, 256), (40, 256), (4, 16), (1, 16)])
def test_partners(keys, crowd):
    rng = np.random.default_rng(7)
    key = np.sort(rng.integers(-keys, keys, 300))
    unit = rng.normal(0, 1, (300, 64))
    unit[100:200] = unit[:100] + rng.normal(0, 0.3, (100, 64))
    sketch = Sketch(64, 0.9)
    bits = sketch.bits(unit[rng.permutation(300)])
    wanted = brute_partners(key, bits, sketch.most)
    assert (partnered(key, bits, sketch.most, crowd) == wanted).all()
    columns = [key, np.arange(300), *bits.T]
    names = ["key", "id", "s0", "s1", "s2", "s3"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + 7]) for c in columns], names=names) for a in range(0, 300, 7)]
    got = [tuple(r.values()) for b in meetings(iter(batches), sketch.most, rows=10) for r in b.to_pylist()]
    assert sorted(got) == [(i, key[i]) for i in np.flatnonzero(wanted)]
    sizes = dict(zip(*np.unique(key, return_counts=True), strict=True))
    got = {r["id"] for b in meetings(iter(batches), sketch.most, rows=10, hot=20) for r in b.to_pylist()}
    assert {i for i in range(300) if wanted[i] or sizes[key[i]] > 50} <= got <= {i for i in range(300) if wanted[i] or sizes[key[i]] > 20}


def test_sketch_keeps_pairs_of_the_threshold():
    rng = np.random.default_rng(8)
    for threshold, dim in ((0.9, 64), (0.9, 8), (0.5, 64), (-1, 8), (1, 8)):
        a, b = np.linalg.qr(rng.normal(0, 1, (2000, dim, 2)))[0].transpose(2, 0, 1)
        b = threshold * a + np.sqrt(1 - threshold**2) * b
        sketch = Sketch(dim, threshold)
        assert (np.bitwise_count((sketch.bits(a) ^ sketch.bits(b)).view(np.uint64)).sum(1) <= sketch.most).all()
