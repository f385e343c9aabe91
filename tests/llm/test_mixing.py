"""Temperature mixing against a plain version."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm.mixing import mix_sources, word_count

SCHEMA = "doc_id long, source string, text string"


def entropy(shares, a):
    w = [s**a for s in shares]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


def brute(rows, target, block_tokens, seed=7):
    """(doc_id, source, tokens, epoch) of all draws, for a target entropy and the corpus total as budget."""
    md5 = lambda *p: hashlib.md5("|".join(map(str, p)).encode()).hexdigest()
    tokens = [len((t or "").split()) for _, _, t in rows]
    totals = defaultdict(int)
    for (_, s, _), n in zip(rows, tokens, strict=True):
        totals["n" if s is None else f"s:{s}"] += n
    shares = {s: n / sum(totals.values()) for s, n in totals.items() if n}
    lo, hi = 0, 32**4
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if entropy(list(shares.values()), mid / 32**4) >= target * math.log(len(shares)) - 1e-12 else (lo, mid)
    a = lo / 32**4
    norm = sum(s**a for s in shares.values())
    out = []
    for s, total in totals.items():
        quota = math.floor(shares[s] ** a / norm * sum(totals.values()) + 0.5) if total else 0
        count = max(1, -(-total // block_tokens))
        blocks = defaultdict(list)
        for (d, src, _), n in zip(rows, tokens, strict=True):
            if ("n" if src is None else f"s:{src}") == s:
                blocks[int(md5(seed, d)[:8], 16) % count].append((md5(seed, "d", d), d, src, n))
        for epoch in range(max(1, -(-quota // max(total, 1)))):
            at = epoch * total
            for b in sorted(blocks, key=lambda b: (md5(seed, epoch, s, b), b)):  # noqa: B023
                for _, d, src, n in sorted(blocks[b]):
                    if at < quota or total == 0:
                        out.append((d, src, n, epoch))
                    at += n
    return sorted(out, key=str)


def corpus(n=400):
    return [(i, f"s{min(9, int(math.sqrt(i % 97)))}" if i % 31 else None, "w " * (i * 7 % 50)) for i in range(n)]


def test_draws(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mix_sources(df, target_entropy=0.97, block_tokens=300)
    assert sorted(map(tuple, got.select("doc_id", "source", "mix_tokens", "mix_epoch").collect()), key=str) == brute(rows, 0.97, 300)
    assert got.filter("mix_at < 0 or mix_at > 1").count() == 0


def test_weights_meet_the_entropy(spark):
    df = spark.createDataFrame(corpus(2000), SCHEMA)
    drawn = mix_sources(df, target_entropy=0.98, block_tokens=200).groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.first("mix_weight").alias("w")).collect()
    total = sum(r["n"] for r in drawn)
    shares = [r["n"] / total for r in drawn]
    assert abs(-sum(p * math.log(p) for p in shares) / math.log(len(shares)) - 0.98) < 0.01
    assert all(abs(r["n"] / total - r["w"]) < 0.01 for r in drawn)


def test_repetition_limit_and_cover(spark):
    rows = corpus(1500)
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), max_repeat=2.0, cover=True)
    times = Counter(r["doc_id"] for r in got.select("doc_id").collect())
    assert set(times) == {r[0] for r in rows}  # no document is lost
    assert max(times.values()) == 2
    assert got.groupBy("source").agg((F.sum("mix_tokens") / F.sum(F.when(F.col("mix_epoch") == 0, F.col("mix_tokens")))).alias("r")).filter("r > 2.02").count() == 0


def test_edges(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, "a", "z"), (2, None, None), (3, "empty", ""), (4, "b", "w " * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tokens": F.lit("x"), "share": F.lit(1), "n": F.lit(2)})
    got = mix_sources(df, max_repeat=1.0, cover=True)
    assert got.columns[: len(df.columns)] == df.columns
    assert sorted((str(r["doc_id"]), r["mix_tokens"]) for r in got.filter("mix_epoch = 0").collect()) == [("1", 2), ("1", 2), ("2", 0), ("3", 0), ("4", 100_000), ("None", 1)]
    assert mix_sources(df.limit(0), target_entropy=0.9).count() == 0
    assert mix_sources(df.filter("source = 'empty'"), target_entropy=0.9).count() == 1
    assert mix_sources(df.filter("source = 'a'"), target_entropy=0.9).count() == 3
    with pytest.raises(ValueError, match="either"):
        mix_sources(df)


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n",), ("a",), (" a  b\tc ",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [0, 0, 0, 1, 3]


@pytest.mark.parametrize("block_rows", [1 << 16, 20])
def test_cover_keeps_empty_documents_at_the_end(spark, block_rows):
    """The least repeated source holds mostly empty texts, behind its last token and in whole blocks."""
    rows = [(i, "a", "w " * 500 if i % 60 == 0 else " ") for i in range(300)] + [(1000 + i, "b", "w w") for i in range(20)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), max_repeat=2.0, cover=True, block_rows=block_rows)
    drawn = got.select("doc_id", "mix_epoch", "mix_at").collect()
    assert sorted(r["doc_id"] for r in drawn if r["mix_epoch"] == 0) == [r[0] for r in rows]
    assert Counter(r["doc_id"] for r in drawn if r["doc_id"] < 1000) == {r[0]: 1 for r in rows if r[1] == "a"}
    assert all(0 <= r["mix_at"] < 1 for r in drawn)
