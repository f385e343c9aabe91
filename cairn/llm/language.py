"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, in_pieces, small_batches

ORDER = 3
PAD = b"\n" * ORDER
#: Candidates for letters; ``str.isalpha`` decides, since \\w holds number signs like superscripts too.
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 17
#: A text that its best language codes in SLACK times as many bits a byte as 999 of 1000 training documents is in none.
SLACK = 1.5


@dataclass
class LanguageModel:
    """Frozen code lengths: ``bits[context, symbol, language]``, the context by its last bytes."""

    languages: list[str]
    symbol: np.ndarray
    context: np.ndarray
    bits: np.ndarray
    #: Bits a byte beyond which a text is in none of the languages.
    most: float = float("inf")


def has_letters(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def _raw(text: str | None) -> bytes:
    return PAD + (text or "").lower().encode("utf-8", "replace")


def _count(batches):
    """Distinct (ORDER + 1)-byte strings and their counts by language, of some Arrow batches."""
    found: dict[str, dict[int, int]] = {}
    for batch in in_pieces(batches):
        texts: dict[str, list[bytes]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(_raw(text))
        for lang, raws in texts.items():
            own = found.setdefault(lang, {})
            for _, parts in _slices(raws):
                data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
                gram = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
                whole = np.ones(len(gram), bool)
                for e in np.cumsum([len(r) for r in parts])[:-1]:  # not across two texts
                    whole[max(0, e - ORDER) : e] = False
                for g, n in zip(*np.unique(gram[whole], return_counts=True), strict=True):
                    own[int(g)] = own.get(int(g), 0) + int(n)
    for lang, own in found.items():
        keys = list(own)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.int64()), pa.array([own[k] for k in part], pa.int64())], names=["lang", "gram", "n"])


def train_language(docs: DataFrame, use: Column | None = None, key: str = "doc_id", max_rows: int = 8_000, max_grams: int = 400_000, max_contexts: int = 12_000) -> LanguageModel:
    """Fit on about ``max_rows`` documents with a non-null lang and ``use``, as many of each language.

    They are those of smallest key hash (a language with fewer gives all of its own). Counts of
    all their strings of ORDER + 1 bytes are gathered with Spark; of each language the most
    frequent, ``max_grams`` together, come to the driver and give its tree of contexts of 0 to
    ORDER bytes. Of the contexts of full order the ``max_contexts`` most frequent are kept, a
    text in another one is coded with the longest shorter context: the order varies. As many
    documents again, of the next hashes, tell how many bits a byte are usual.

    Repeated rows count as often as they come; without rows nothing is learned.
    """
    rows = docs.withColumn("__use", F.lit(True) if use is None else use).filter("__use and lang is not null and text is not null").select(key, "text", "lang")
    held = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row a language
    each = held.agg(F.count(F.lit(1)).alias("k")).first()["k"]
    whole = 1 << 60
    share = F.least(F.lit(1.0), F.lit(max_rows / max(each, 1)) / F.col("n"))  # of the hash range
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(whole)) / F.lit(float(whole))
    # a row a language, as the model has a table a language; else Spark may shuffle every text to a handful of keys
    rows = rows.join(F.broadcast(held.select(F.col("lang").alias("__lang"), share.alias("__share"))), F.col("lang") == F.col("__lang"))
    small_batches(docs.sparkSession)
    grams = rows.filter(place < F.col("__share")).select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    got = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= max(1, max_grams // max(each, 1))).drop("at").toPandas()
    got = got.sort_values(["lang", "gram"], ignore_index=True)
    model = build(sorted(got["lang"].unique()), got["lang"].to_numpy(), got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.float64), max_contexts)
    # where all rows of a language teach it, they also tell what is usual
    again = rows.filter((place >= F.col("__share")) & (place < 2 * F.col("__share")) | (F.col("__share") >= 1.0)).select("text")
    usual = identify(again, model, [], rate="rate").filter("rate is not null").agg(F.percentile_approx("rate", 0.999, 10_000)).first()[0]
    model.most = SLACK * usual if usual is not None else float("inf")
    return model


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, max_contexts: int) -> LanguageModel:
    """Exact code lengths with escape method C and exclusion, under the counts given."""
    split = np.stack([(gram >> s) & 255 for s in (24, 16, 8, 0)], 1)
    used = np.unique(np.append(split, PAD[0]))
    size = len(used) + 1  # the last symbol stands for any other byte
    symbol = np.full(256, size - 1, np.int64)
    symbol[used] = np.arange(len(used))
    s = symbol[split]
    ids = [np.zeros(len(s), np.int64)]  # of each gram's context, by order
    for k in range(1, ORDER + 1):
        ids.append(ids[-1] + s[:, ORDER - k] * size ** (k - 1))
    rank = np.unique(ids[ORDER], return_inverse=True)
    weight = np.bincount(rank[1], n) if len(n) else np.zeros(0)
    kept = np.sort(rank[0][np.argsort(-weight, kind="stable")[:max_contexts]])
    levels = [np.zeros(1, np.int64), *[np.unique(ids[k]) for k in range(1, ORDER)], kept]
    first = np.cumsum([0, *[len(x) for x in levels]])
    context = np.zeros(size**ORDER, np.int32)
    for k in range(1, ORDER + 1):
        row = np.full(size**k, -1, np.int32)
        row[levels[k]] = np.arange(first[k], first[k + 1])
        spread = np.tile(row, size ** (ORDER - k))  # the last bytes are the low digits
        context = np.where(spread >= 0, spread, context)
    bits = np.zeros((first[-1], size, len(languages)), np.float32)
    for j, name in enumerate(languages):
        own = lang == name
        counts = []
        for k in range(ORDER + 1):
            pos = np.searchsorted(levels[k], ids[k][own])
            ok = pos < len(levels[k])
            ok[ok] = levels[k][pos[ok]] == ids[k][own][ok]
            c = np.bincount(pos[ok] * size + s[own, ORDER][ok], n[own][ok], len(levels[k]) * size)
            counts.append(c.reshape(len(levels[k]), size))
        for k in range(ORDER + 1):
            for at in range(0, len(levels[k]), 2000):
                ctx = levels[k][at : at + 2000]
                cost, out = np.zeros((len(ctx), size)), np.full((len(ctx), size), np.nan)
                unseen = np.ones((len(ctx), size), bool)
                for m in range(k, -1, -1):
                    low = ctx % size**m if m else np.zeros_like(ctx)
                    pos = np.minimum(np.searchsorted(levels[m], low), len(levels[m]) - 1)
                    c = counts[m][pos] * (levels[m][pos] == low)[:, None] * unseen
                    d, t = (c > 0).sum(1, keepdims=True), c.sum(1, keepdims=True)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        out = np.where(c > 0, cost - np.log2(c / (t + d)), out)
                        cost = cost + np.where(d > 0, -np.log2(d / (t + d)), 0.0)
                    unseen &= c == 0
                left = 256 - (size - unseen.sum(1, keepdims=True))  # bytes that no context has seen
                out = np.where(unseen, cost + np.log2(np.maximum(left, 1)), out)
                bits[first[k] + at : first[k] + at + len(ctx), :, j] = out
    return LanguageModel(languages, symbol, context, bits)


def _slices(raws: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, stretches) of about CHUNK bytes together; each begins with the ORDER bytes before it."""
    of, parts, held = [], [], 0
    for i, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - ORDER), CHUNK):
            of.append(i)
            parts.append(raw[at : at + CHUNK + ORDER])
            held += len(parts[-1])
            if held >= CHUNK:
                yield of, parts
                of, parts, held = [], [], 0
    if parts:
        yield of, parts


def code_lengths(texts: list[str | None], model: LanguageModel) -> np.ndarray:
    """Bits of each whole text under each language; long inputs are worked through in slices."""
    size, flat = model.bits.shape[1], model.bits.reshape(-1, len(model.languages))
    total = np.zeros((len(texts), len(model.languages)))
    for of, parts in _slices([_raw(t) for t in texts]):
        lens = np.array([len(p) for p in parts])
        data = model.symbol[np.frombuffer(b"".join(parts), np.uint8)]
        place = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
        to = np.flatnonzero(place >= ORDER)
        text = np.repeat(np.array(of), lens)[to]
        row = model.context[(data[to - 3] * size + data[to - 2]) * size + data[to - 1]].astype(np.int64)
        cost = flat[row * size + data[to]]
        for j in range(len(model.languages)):
            total[:, j] += np.bincount(text, cost[:, j], len(texts))
    return total


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, str] = ("lang_pred", "score"), rate: str | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs``, ``lang_pred`` and ``score``.

    The language whose tree codes the whole text in the fewest bits; the score is its share of
    the probability 2 ** -bits over all languages. A null text or one without letters is ``und``
    with score 0, as is everything if no language was learned. Ties go to the first by name.
    ``rate`` names one more column, the bits a byte that the best language takes (null for
    ``und``); more than ``model.most`` are unusual for every language.

    ``names`` names the results; kept columns of these names give way. Repeated rows are judged
    each, an empty table gives an empty one, and a null key is a key like others.
    """
    made = [*names, *([rate] if rate else [])]
    keep = [c for c in keep if c not in made]
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(made, kinds, strict=False)])
    small_batches(docs.sparkSession)
    text = fresh(keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_contexts and the byte alphabet

    def work(batches):
        m = shared.value
        for batch in in_pieces(batches):
            texts = batch.column(text).to_pylist()
            known = np.array([bool(m.languages) and has_letters(t) for t in texts], bool)
            name, score, rates = np.full(len(texts), "und", object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if known.any():
                some = [t for t, k in zip(texts, known, strict=True) if k]
                bits = code_lengths(some, m)
                best = bits.argmin(1)
                name[known] = np.array(m.languages, object)[best]
                score[known] = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                rates[known] = bits.min(1) / [len(_raw(t)) - ORDER for t in some]
            out = [pa.array(name, pa.string()), pa.array(score), pa.array(rates, mask=~known)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *out[: len(made)]], names=[f.name for f in schema])

    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(work, schema)
