"""The registered queries of this package, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from .common import table
from .language import identify, train_language
from .lattice import link_vectors
from .metric_tree import top_k
from .mixing import mix_sources, word_count
from .oracle import SQL
from .packing import pack
from .reputation import filter_urls
from .sharding import balanced_shards
from .shingles import jaccard_classes
from .toxicity import score_toxicity, train_toxicity
from .warc import round_trip

SHARDS = 24
TOKENS = 2048
#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def tokenizer_path() -> str:
    """The vocabulary file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch(spark, "warc"))


def op2_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the toxic label of the document that its url numbers."""
    pages, labels = _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")
    numbered = pages.select("page_id", F.expr("try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)', 1) as bigint)").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max("toxic").alias("bad"))
    outcomes = numbered.filter("doc_id is not null").join(bad, "doc_id").select("page_id", "bad")
    return filter_urls(pages.select("page_id", "url"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict", *[F.round(c, 9).alias(c) for c in ("bad_rate", "bad_bound")])


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = _read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return balanced_shards(docs, "size", ["doc_id", "size", "text_crc32"], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), TOKENS)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_metric_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def fold(modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``modulus``; a null doc_id counts as the empty text, whose crc32 is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train_toxicity(docs, labels, fold(5) != 0)
    return score_toxicity(docs, model, ["doc_id"]).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = table(docs.select("doc_id", "source", word_count(F.col("text")).alias("tokens")), "tokens")
    mixed = mix_sources(counted, F.col("tokens"), target_entropy=0.95).drop("tokens")
    return mixed.withColumns({c: F.round(c, 9) for c in ("mix_weight", "mix_at")})


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language(docs, fold(4) != 2)
    return identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc_shards, op2_lattice_near_duplicates, op3_url_reputation, op4_balanced_shards, op5_genetic_packing, op6_jaccard_join, op7_metric_tree_top_k, op8_compression_toxicity, op9_temperature_mixing, op10_ppm_language]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
