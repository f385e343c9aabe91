"""A training corpus out of raw documents: five stages, each an operator over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import fresh, split_join, table
from cairn.llm.language import identify, train_language
from cairn.llm.mixing import mix_sources, word_count
from cairn.llm.packing import pack
from cairn.llm.queries import TOKENS, fold, tokenizer_path
from cairn.llm.shingles import jaccard_classes
from cairn.llm.toxicity import score_toxicity, train_toxicity

#: A document goes if the best language holds less than this share of the probability, or codes it unusually badly.
LEAST_SCORE = 0.5
#: The most often that any source may be repeated when sources are mixed.
MAX_REPEAT = 2.0


def _names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names that no column of ``docs`` has, so that a document's own ``score`` or the like stays as it is."""
    return tuple(fresh(docs.columns, name) for name in names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the compression distance calls toxic.

    A null or empty text is judged as one without any toxic window, rows that repeat each by
    itself; an empty table gives an empty one, as in all stages. All columns stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train_toxicity(docs.select("doc_id", "text"), labels, fold(5) != 0)
    score, predicted = _names(docs, "score", "predicted")
    return score_toxicity(docs, model, docs.columns, (score, predicted)).filter(F.col(predicted) == 0).select(docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold no letters, or whose language no model tells apart or knows.

    A null or empty text holds no letters and goes. Rows that repeat are judged each.
    """
    model = train_language(docs.select("doc_id", "text", "lang"), fold(4) != 2)
    lang, score, rate = _names(docs, "lang_pred", "score", "rate")
    judged = identify(docs, model, docs.columns, (lang, score), rate)
    return judged.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE) & (F.col(rate) <= model.most)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id.

    Rows are numbered, since rows that repeat a doc_id are documents of their own: of repeated
    rows one stays, and a null doc_id comes after all others. Documents without words, null
    texts among them, are in no class and stay.
    """
    row = fresh([*docs.columns, "text", "doc_id", "class_id", "n_links", "kept"], "row")
    rows = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = jaccard_classes(rows.select(row, "text"), key=row).select(row, "class_id")
    classes = split_join(rows.select(row, "doc_id"), classes, [row])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first")
    firsts = classes.groupBy("class_id").agg(first).select(F.col("first")[row].alias(row))
    return split_join(rows, firsts, [row], "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn by tempered weights; rare ones up to MAX_REPEAT times, every document once at least.

    A null source is a source of its own; null and empty texts have no tokens and come once.
    """
    prefix = "mix"
    while any(c.startswith(f"{prefix}_") for c in docs.columns):
        prefix = f"_{prefix}"
    return mix_sources(docs, word_count(F.col("text")), max_repeat=MAX_REPEAT, cover=True, prefix=prefix).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence; rows that repeat are packed each.

    A null text counts as empty: one piece of the end token alone.
    """
    return pack(docs.select("doc_id", "text"), tokenizer_path(), TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read by the next one.

    Nulls, empty texts, repeated rows and empty tables pass as each stage says; ``labels`` may be
    empty too, and then no document counts as toxic.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
