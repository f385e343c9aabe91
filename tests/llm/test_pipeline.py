"""The pipeline's stages against plain versions, each on its own input, and as a whole."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tokenizers import Tokenizer  # noqa: E402

from cairn.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, l, s, None if t is None else len(t)) for d, t, l, s in rows], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_copies(rows):
    """Of each group of rows that links of exact Jaccard similarity 0.8 hold together, that of smallest doc_id; pair by pair."""
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]


def mixed_plainly(rows):
    """(source, text) and how often each is drawn at least and at most: quotas by bisecting the exponent, epochs whole but for the last."""
    tokens = lambda r: len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or ""))
    total = Counter()
    for r in rows:
        total[r["source"]] += tokens(r)
    some = {s: n for s, n in total.items() if n}
    corpus, lo, hi = sum(some.values()), -1, 32**4
    repeats = lambda a: max((n / max(some.values())) ** (a - 1) for n in some.values())
    while hi - lo > 1:
        k = (lo + hi) // 2
        lo, hi = (lo, k) if repeats(k / 32**4) <= 2.0 + 1e-12 else (k, hi)
    a = hi / 32**4
    norm = sum((n / corpus) ** a for n in some.values())
    top = max(some.values()) / corpus
    budget = math.ceil(corpus * top / (top**a / norm))
    quota = {s: max(round((n / corpus) ** a / norm * budget), n) for s, n in some.items()}
    return total, quota


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: two languages, toxic documents, copies, odd rows."""
    at = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(0)
    words = {"en": "the garden train window morning letter river stone bridge paper song house light water road".split(), "fr": "le jardin fenêtre matin lettre rivière pierre pont papier chanson maison lumière eau route café".split()}
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 2 else "fr"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(30, 80)))
        toxic = i % 8 == 1
        rows.append((i, text + (" vilefool grotslur dirtwretch" if toxic else ""), lang, f"s{i % 5}"))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, rows[0][1], "fr", "s0") for i in range(50)] + [(2000, rows[2][1] + " fin", "fr", "s1")]
    rows += [(3000, None, None, None), (3001, "", "en", "s0"), (3002, "123 456", None, "s9"), (2, rows[2][1], "fr", "s2"), (2, rows[2][1], "fr", "s2"), (None, rows[4][1], "fr", "s3"), (3003, "le jardin " * 30_000, "fr", "s4")]
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_order_and_columns(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            assert stage(spark, given, folder).schema.simpleString() == docs.schema.simpleString(), name


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in STAGES["toxicity"](spark, docs, folder).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {i for i in range(400) if i % 8 == 1}


def test_documents_without_letters_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = docs.exceptAll(STAGES["language"](spark, docs, folder)).collect()
    assert sorted(r["doc_id"] for r in gone) == [3000, 3001, 3002]


def test_one_of_each_group_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = STAGES["near_copies"](spark, docs, folder).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(0) == 1
    assert ids.count(2) == 1
    assert not {1000, 1049, 2000, None} & set(ids)
    assert {3000, 3001, 3002} <= set(ids)
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in first_of_copies(docs.collect()))
    again = frame(spark, [tuple(r)[:4] for r in kept])
    assert STAGES["near_copies"](spark, again, folder).count() == len(kept)


def test_mixing_loses_no_document(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    drawn = STAGES["mixing"](spark, docs, folder)
    assert docs.exceptAll(drawn).count() == 0
    check_mixed(docs.collect(), drawn.collect())


def check_mixed(given, drawn):
    """Of each source whole epochs and a last one that ends within one document of the quota."""
    total, quota = mixed_plainly(given)
    size = lambda r: len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or ""))
    before, after, got = Counter(map(tuple, given)), Counter(map(tuple, drawn)), Counter()
    for r in drawn:
        got[r["source"]] += size(r)
    for s in total:
        longest = max(size(r) for r in given if r["source"] == s)
        assert quota.get(s, 0) <= got[s] <= quota.get(s, 0) + longest, s
    for row, n in after.items():
        epochs = quota.get(row[3], 0) / max(total[row[3]], 1)
        assert before[row] * max(1, math.floor(epochs)) <= n <= before[row] * max(1, math.ceil(epochs)), row
    assert set(before) == set(after)


@pytest.mark.parametrize("stage", ["toxicity", "language", "near_copies", "mixing"])
def test_own_columns_stay(spark, folder, stage):
    """Columns named as an operator's results are the documents' own and come back as they are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 40")
    own = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ("score", "predicted", "lang_pred", "rate", "mix_tokens", "mix_at", "row", "class_id", "kept", "_score", "src", "block")}
    rows = STAGES[stage](spark, docs.withColumns(own), folder).collect()
    assert rows
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in own)


def test_whole(spark, folder):
    """The rows of run() against plain versions of the last three stages over what the first two keep."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in packed}
    assert not {1, 9, 1000, 2000, 3000, 3001, 3002} & ids
    assert {0, 2, 3003} <= ids
    spoken = [r for r in docs.collect() if "vilefool" not in (r["text"] or "") and re.search("[a-z]", r["text"] or "")]
    left = first_of_copies(spoken)
    assert ids == {r["doc_id"] for r in left}
    tokenizer, text = Tokenizer.from_file(tokenizer_path()), {r["doc_id"]: r["text"] for r in left}
    times = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    check_mixed(left, [r for r in left for _ in range(times[r["doc_id"]])])
    for d, t in text.items():
        whole = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        wanted = Counter((i // 2048, i, len(part), zlib.crc32(part.tobytes())) for i in range(0, len(whole), 2048) for part in [whole[i : i + 2048]])
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed if r["doc_id"] == d) == Counter({k: n * times[d] for k, n in wanted.items()})
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in packed) // 2048) * 1.01 + 1
