"""The n-gram Jaccard join against all pairs of exact sets."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm.shingles import Sketcher, choose_bands, jaccard_classes

SCHEMA = "doc_id long, text string"


def grams(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets, n = [grams(t) for _, t in rows], len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        first = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], first, len(links[i]), first == rows[i][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "class_id", "n_links", "kept").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_groups(spark):
    rows = corpus(1, 500)
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # copies
    assert rows_of(jaccard_classes(spark.createDataFrame(rows, SCHEMA).repartition(6), chunk=32)) == brute(rows)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \n_ !"), (8, "one two"), (9, "One, TWO!"), (10, "one two three"), (11, long), (12, long + " tail"), (13, long[: len(long) // 2]), (14, "a b c d e"), (15, "a b c d e")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"name": F.lit(1), "grams": F.lit("x"), "id": F.lit(2), "key": F.lit("k"), "bands": F.lit(0), "kept": F.lit("no")})
    assert rows_of(jaccard_classes(df)) == brute(rows)
    assert jaccard_classes(df.limit(0)).count() == 0
    assert rows_of(jaccard_classes(df.filter("doc_id < 8"))) == [(5, 5, 0, True), (6, 6, 0, True), (7, 7, 0, True)]
    repeated = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (None, "lonely words here")]
    assert rows_of(jaccard_classes(spark.createDataFrame(repeated, SCHEMA))) == sorted([(1, 1, 2, True), (1, 1, 2, True), (1, 1, 0, True), (None, 1, 2, False), (None, None, 0, True)], key=str)


def test_threshold_is_inclusive(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words[:94])), (2, " ".join(words[:76]))]  # 90 and 72 grams: 0.8
    assert brute(rows)[1][1] == 1
    assert rows_of(jaccard_classes(spark.createDataFrame(rows, SCHEMA), recall=0.999999)) == brute(rows)


@settings(max_examples=50, deadline=None)
@given(st.text("ab ,_é1", max_size=60), st.text("ab ,_é1", max_size=60))
def test_hashed_sets_stand_for_the_sets(a, b):
    s = Sketcher(5, 4, 2)
    assert len(s.grams(a)) == len(grams(a))
    assert (set(s.grams(a).tolist()) == set(s.grams(b).tolist())) == (grams(a) == grams(b))
