"""Toxicity and language: held-out accuracy, exact code lengths, and edges."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import language
from cairn.llm.language import ORDER, PAD, build, code_lengths, identify, train_language
from cairn.llm.queries import fold, op8_compression_toxicity, op10_ppm_language
from cairn.llm.toxicity import CARRIER, GAINS, SIZE, STEP, compressor, score_toxicity, train_toxicity, window_count, windows

DATA = "/root/testdata/sf0.1"
LABELLED = "/root/testdata/check_s"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_toxicity_of_held_out_documents(spark):
    """On a corpus with enough labels for dictionaries; the contract's own fold is held out."""
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").select("doc_id", "toxic")
    documents = spark.read.parquet(f"{LABELLED}/documents.parquet")
    scored = op8_compression_toxicity(spark, LABELLED)
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert np.mean(toxic) >= 0.9
    assert np.mean(clean) <= 0.01
    assert scored.count() == documents.count()
    assert scored.filter("score is null or score < 0 or score > 1 or predicted != int(score >= 0.5)").count() == 0


def test_languages_of_held_out_documents(spark, documents):
    got = op10_ppm_language(spark, DATA)
    assert got.count() == documents.count()
    rows = got.filter("held_out").join(documents.filter("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.98


def test_held_out_rows_teach_nothing(spark, documents):
    """With the other rows alone the models are the same."""
    docs = documents.select("doc_id", "text", "lang").limit(3000)
    a = train_language(docs, fold(4) != 2)
    b = train_language(docs.filter(fold(4) != 2).unionByName(docs.filter(fold(4) == 2).withColumn("text", F.lit("zzz")).withColumn("lang", F.lit("xx"))), fold(4) != 2)
    assert a.languages == b.languages
    assert np.array_equal(a.bits, b.bits)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(fold(5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    x, y = (train_toxicity(docs, one, fold(5) != 0) for one in (labels, turned))
    assert (x.toxic, x.ordinary, x.threshold, x.weights) == (y.toxic, y.ordinary, y.threshold, y.weights)


def ppm(counts, data, known):
    """Bits of ``data`` by the textbook: escape method C with exclusion, from counts by context."""
    bits = 0.0
    for i in range(ORDER, len(data)):
        unseen, cost = set(range(256)), 0.0
        for k in range(ORDER, -1, -1):
            if not all(known[i - k : i]):  # never seen as a context
                continue
            seen = {s: n for s, n in counts[data[i - k : i]].items() if s in unseen}
            d, t = len(seen), sum(seen.values())
            if data[i] in seen:
                cost -= math.log2(seen[data[i]] / (t + d))
                break
            if d:
                cost -= math.log2(d / (t + d))
            unseen -= set(seen)
        else:
            cost += math.log2(len(unseen))
        bits += cost
    return bits


def test_code_lengths_are_exact():
    texts = {"a": ["the cat sat on the mat", "then the hat"], "b": ["le chat est là", "la table"]}
    grams, wanted = [], {}
    for lang, of in texts.items():
        counts, four = defaultdict(Counter), Counter()
        for t in of:
            raw = PAD + t.encode()
            for i in range(ORDER, len(raw)):
                four[raw[i - ORDER : i + 1]] += 1
                for k in range(ORDER + 1):
                    counts[raw[i - k : i]][raw[i]] += 1
        wanted[lang] = counts
        grams += [(lang, int.from_bytes(g, "big"), n) for g, n in four.items()]
    model = build(["a", "b"], np.array([g[0] for g in grams], object), np.array([g[1] for g in grams]), np.array([g[2] for g in grams], float), 10_000)
    probes = ["the chat", "là", "mat mat mat", "", "quite other: 東京", "zzz the zat", "2 4"]
    got = code_lengths(probes, model)
    for i, t in enumerate(probes):
        for j, lang in enumerate(("a", "b")):
            raw = PAD + t.encode()
            known = [model.symbol[b] < model.bits.shape[1] - 1 for b in raw]
            # contexts reach back to the last byte that no language has seen, which stands for all such bytes
            assert got[i, j] == pytest.approx(ppm(wanted[lang], raw, known), rel=1e-4), (t, lang)
    assert np.isfinite(got).all()


def test_language_edges(spark):
    rows = [(i, f"the cat number {i} sat on the mat", "en") for i in range(20)] + [(100 + i, f"le chat numéro {i} est sur la table", "fr") for i in range(20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language(train)
    asked = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the mat " * 50_000), (5, "la table"), (5, "la table"), (None, "the cat")]
    df = spark.createDataFrame(asked, "doc_id long, text string").withColumns({"lang_pred": F.lit("old"), "score": F.lit("old"), "extra": F.lit(1)})
    got = identify(df, model, df.columns)
    assert got.columns == ["doc_id", "text", "extra", "lang_pred", "score"]
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got.collect()) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("5", "fr"), ("5", "fr"), ("None", "en")]
    assert identify(df.limit(0), model, ["doc_id"]).count() == 0
    untaught = train_language(train.limit(0))
    assert {r["lang_pred"] for r in identify(df, untaught, ["doc_id"]).collect()} == {"und"}
    nulls = train.withColumn("lang", F.when(F.col("doc_id") > 100, F.col("lang")))
    assert train_language(nulls).languages == ["fr"]


def test_language_training_shuffles_no_text(spark, documents, monkeypatch):
    """Shares by language come to the texts, also where Spark's own bound would not broadcast them."""
    read = []
    monkeypatch.setattr(language, "identify", lambda docs, *args, **named: read.append(docs) or identify(docs, *args, **named))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        model = train_language(documents.select("doc_id", "text", "lang"), fold(4) != 2)
        text = read[-1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(model.languages) == 4
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text


WORDS = "garden train window morning river stone bridge paper letter house light water road song table winter summer kitchen market street".split()


def taught(spark, n, make, share=4):
    """A model of ``n`` texts, every ``share``-th toxic, and their frame; ``make(rng, toxic)`` gives a text."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, make(rng, i % share == 0)) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % share == 0)) for i in range(n)] + [(1, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    return train_toxicity(docs, labels, F.lit(True)), docs, labels


def slurs(rng, toxic):
    words = [rng.choice(WORDS) for _ in range(40)]
    return " ".join(words[:20] + ["vilefool", "grotslur"] * toxic + words[20:])


def test_toxicity_edges(spark):
    model, docs, labels = taught(spark, 600, slurs)
    text = slurs(random.Random(8), False)
    asked = [(1, None), (2, ""), (3, text), (4, text + " you vilefool grotslur"), (5, text + " VILEFOOL Grotslur!"), (6, (text + " vilefool grotslur ") * 2_000), (7, (text + " ") * 2_000), (7, (text + " ") * 2_000), (None, "x" * 500_000)]
    df = spark.createDataFrame(asked, "doc_id long, text string").withColumns({"score": F.lit("old"), "toxic": F.lit(1), "counts": F.lit(2), "_text": F.lit(3)})
    scored = score_toxicity(df, model, df.columns)
    assert scored.columns == ["doc_id", "text", "toxic", "counts", "_text", "score", "predicted"]
    got = sorted((str(r["doc_id"]), r["predicted"]) for r in scored.collect())
    assert got == [("1", 0), ("2", 0), ("3", 0), ("4", 1), ("5", 1), ("6", 1), ("7", 0), ("7", 0), ("None", 0)]
    kept = score_toxicity(df, model, df.columns, names=("s", "p"))
    assert kept.columns == [*df.columns, "s", "p"]
    assert score_toxicity(df.limit(0), model, ["doc_id"]).count() == 0
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(0))):
        silent = train_toxicity(docs, none, F.lit(True))
        assert score_toxicity(df, silent, ["doc_id"]).filter("predicted = 1").count() == 0


def test_whole_scores_are_those_of_plain_compression(spark, documents):
    """Each window of 50 whole documents compressed by itself, and the curve written out."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    model = train_toxicity(documents.select("doc_id", "text"), labels, fold(5) != 0)
    some = documents.filter("doc_id % 200 = 0").select("doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in score_toxicity(some, model, ["doc_id"]).collect()}
    short, long = compressor(model.ordinary), compressor(model.ordinary + model.toxic)
    for r in some.collect():
        raw, gains, at = (r["text"] or "").lower().encode("utf-8", "replace"), [], 0
        while raw:
            window = raw[at : at + SIZE] + CARRIER
            gains.append(max(0, min(GAINS - 1, len(short.compress(window)) - len(long.compress(window)))))
            at += STEP
            if at - STEP + SIZE >= len(raw):
                break
        over = [g for g in gains if g >= model.threshold]
        z = np.dot(model.weights, [1, math.log1p(len(over)), math.log1p(sum(over)), math.log1p(len(gains))])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-9)


def test_bare_words_fail_where_compression_succeeds(spark):
    """Slurs hide within longer words, each of another spelling: no word of a new toxic text was ever seen as toxic."""

    def hidden(rng, toxic):
        own = "".join(rng.choice("bcdfgkmprtz") for _ in range(8))
        words = [rng.choice(WORDS) for _ in range(40)]
        return " ".join([*words[:20], own + ("vilefoolish" if toxic else rng.choice(WORDS)) + own[::-1], *words[20:]])

    model, docs, labels = taught(spark, 2000, hidden)
    rng = random.Random(9)
    asked = [(i, hidden(rng, i % 2 == 0)) for i in range(200)]
    seen = {w for r in docs.join(labels.filter("toxic = 1"), "doc_id").collect() for w in r["text"].split()}
    assert not [i for i, t in asked if i % 2 == 0 and (set(t.split()) & seen) - set(WORDS)]  # membership tells nothing
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert np.mean([got[i] == (i % 2 == 0) for i in got]) >= 0.95


@pytest.mark.parametrize("rate", [1, 20])
def test_rare_toxic_rows_are_learned(spark, rate):
    """One toxic row of a thousand, and one of fifty."""
    model, _, _ = taught(spark, 5_000, slurs, share=1000 // rate)
    rng = random.Random(4)
    asked = spark.createDataFrame([(i, slurs(rng, i % 2 == 0)) for i in range(200)], "doc_id long, text string")
    rows = score_toxicity(asked, model, ["doc_id"]).collect()
    assert np.mean([r["predicted"] for r in rows if r["doc_id"] % 2]) <= 0.02
    if rate > 1:
        assert np.mean([r["predicted"] for r in rows if r["doc_id"] % 2 == 0]) >= 0.8


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200))
def test_windows_cover_the_text(raw):
    got = windows(raw)
    assert len(got) == window_count(raw)
    assert b"".join(w[:STEP] if i + 1 < len(got) else w for i, w in enumerate(got)) == raw
    assert all(len(w) == SIZE for w in got[:-1])
