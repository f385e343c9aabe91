"""M-tree search against all inner products."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import metric_tree
from cairn.llm.metric_tree import Space, best_first, build_pages, top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, asks):
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    out = []
    for at, (qi, q) in enumerate(whole):
        if qi is not None and asks(qi):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i is None, i or 0) for j, (i, v) in enumerate(whole) if j != at)[:k]
            out += [(qi, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.sampled_from(["spread", "clumps", "equal", "line"]))
def test_tree(seed, n, kind):
    rng = np.random.default_rng(seed)
    x = {
        "spread": lambda: rng.integers(-500, 500, (n, 6)),
        "clumps": lambda: rng.integers(-500, 500, (5, 6))[rng.integers(0, 5, n)] + rng.integers(-2, 3, (n, 6)),
        "equal": lambda: np.full((n, 6), 7),
        "line": lambda: np.arange(n)[:, None] * np.ones((1, 6)),
    }[kind]().astype(float)
    space = Space(float((x * x).sum(1).max()))
    pages = build_pages(space, x, list(range(n)), np.arange(n), x[0], 16)
    assert sorted(i for p in pages if p.leaf for i in p.ids) == list(range(n))
    for q, own in [(x[n // 2], n // 2), (rng.integers(-500, 500, 6).astype(float), -1)]:
        to_router = float(space.query(q @ q, x[:1] @ q)[0])
        got, _ = best_first(space, pages, q, to_router, 5, own, -np.inf, 1e9)
        wanted = sorted((-int(s), i) for i, s in enumerate(x @ q) if i != own)[:5]
        assert [(-s, i) for s, i, _ in got] == wanted


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(0, 400, (20, 8))[rng.integers(0, 20, 4000)] + rng.normal(0, 5, (4000, 8)))
    space = Space(float((x * x).sum(1).max()))
    pages = build_pages(space, x, list(range(len(x))), np.arange(len(x)), x[0], 32)
    _, computed = best_first(space, pages, x[3], float(space.query(x[3] @ x[3], x[:1] @ x[3])[0]), 10, 3, -np.inf, 1e9)
    assert computed < len(x) / 2


def test_many_trees(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (6, 8))
    x = (centres[rng.integers(0, 6, 3000)] + rng.normal(0, 0.1, (3000, 8))).astype(np.float32)
    x[500:1600] = x[7]  # more than a third are one vector
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(top_k(df, F.col("vec_id") % 100 == 0, 10)) == brute(rows, 10, lambda i: i % 100 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (5, [-1.0, 0.00095]), (None, [3.0, 1.0]), (7, [0.0, 0.0]), (8, [1.0, 2.0])]
    bad = [(200, None), (300, [nan, 1.0]), (9, [inf, 1.0]), (11, [1.0, None]), (12, [1.0]), (13, [])]
    df = spark.createDataFrame(good + bad, SCHEMA).withColumns({"rank": F.lit("x"), "score": F.lit(1), "row": F.lit(2), "region": F.lit(None).cast("int")})
    assert found(top_k(df, F.col("vec_id") % 100 == 0, 3)) == brute(good, 3, lambda i: i % 100 == 0)
    everything = found(top_k(df, F.col("vec_id") == 0, 50))  # fewer candidates than k: all of them
    assert len(everything) == len(good) - 1
    for empty in (df.limit(0), df.filter("vec_id = 200"), df.filter("vec_id = 7")):
        assert top_k(empty, F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_doubles(spark):
    rows = [(i, [2.0**18 + i, 2.0**14]) for i in range(0, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(top_k(df, F.col("vec_id") == 0, 3))
    wanted = sorted(((0, r + 1, i, 2**28 * (2**28 + 1024 * i) + 2**48) for r, i in enumerate((7, 6, 5))), key=str)
    assert got == wanted


def test_one_tree_or_many_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(0, 1, (2500, 4)).astype(np.float32))]
    df = spark.createDataFrame(rows, SCHEMA)
    many = found(top_k(df, F.col("vec_id") % 50 == 0))
    monkeypatch.setattr(metric_tree, "DIRECTORY_BYTES", 1)
    monkeypatch.setattr(metric_tree, "SEARCHES", 7)
    assert many == found(top_k(df, F.col("vec_id") % 50 == 0))


def test_null_query_flag(spark):
    df = spark.createDataFrame([(None, [1.0]), (1, [2.0])], SCHEMA)
    with pytest.raises(Exception, match="embeddingx"):
        top_k(df, F.col("vec_id") == 1, column="embeddingx").count()
    assert found(top_k(df, F.col("vec_id") % 100 == 0)) == []


def test_scores_beyond_a_long(spark):
    """They count as the ends of its range; the smaller key goes first among them."""
    rows = [(i, [1e30, float(i)]) for i in range(30)] + [(100, [-1e30, 0.0]), (101, [0.0, 2.0]), (102, [3e38, 3e38])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(top_k(df, F.col("vec_id").isin(0, 100), k=5))
    assert [r[2] for r in got if r[0] == 0] == [1, 2, 3, 4, 5]
    assert {r[3] for r in got if r[0] == 0} == {metric_tree.LARGEST}
    assert next(r[2] for r in got if r[:2] == (100, 1)) == 101
