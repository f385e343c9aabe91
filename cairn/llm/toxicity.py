"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, in_pieces, small_batches, table

#: Bytes of a window and between the starts of two.
SIZE, STEP = 24, 8
#: Follows each window, so that a short one is compressed at all and matches reach its end.
CARRIER = b"|=carrier=of=the=window=:0123456789:window=of=the=carrier=|"
#: Gains of GAINS - 1 bytes and more count alike.
GAINS = 16
#: Segment and part lengths with which zstandard chooses a dictionary's content.
SEGMENT, PART = 10, 8
#: A window of toxic text teaches the toxic dictionary if that of other toxic documents saves so many bytes.
TEACHING = 3
ROUNDS = 3
#: Of thresholds whose log losses are so close the least is taken.
CLOSE = 0.01
#: Windows compressed in one call.
AT_ONCE = 8192


@dataclass
class ToxicityModel:
    """Contents of the two dictionaries and the calibrated decision over gains in bytes."""

    ordinary: bytes
    toxic: bytes
    threshold: int = 3
    weights: list[float] = field(default_factory=lambda: [-30.0, 0.0, 0.0, 0.0])


def plain(text: str | None) -> bytes:
    """What is compressed: the whole text in lower case."""
    return (text or "").lower().encode("utf-8", "replace")


def windows(raw: bytes, start: int = 0, stop: int | None = None) -> list[bytes]:
    """Windows of SIZE bytes every STEP bytes, the last one reaching the end; those number ``start`` to ``stop``."""
    n = window_count(raw)
    return [raw[i * STEP : i * STEP + SIZE] for i in range(start, n if stop is None else min(stop, n))]


def window_count(raw: bytes) -> int:
    return max(1, -(-(len(raw) - SIZE + STEP) // STEP)) if raw else 0


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=23, hash_log=19, chain_log=20, search_log=3, min_match=5, target_length=32,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    dictionary = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary)


def lengths(by: zstandard.ZstdCompressor, of: list[bytes]) -> np.ndarray:
    """Compressed lengths of windows."""
    out = []
    for at in range(0, len(of), AT_ONCE):
        got = by.multi_compress_to_buffer([w + CARRIER for w in of[at : at + AT_ONCE]])
        out.append(np.fromiter(map(len, got), np.int64, len(got)))
    return np.concatenate(out) if out else np.empty(0, np.int64)


class Scorer:
    """Gains of a text's windows: by how many bytes each gets shorter under the toxic dictionary.

    The toxic dictionary holds the ordinary one's content too, so the two lengths differ only by
    what toxic text adds. Every window of the whole text is compressed under both.
    """

    def __init__(self, model: ToxicityModel):
        self.ordinary, self.toxic = compressor(model.ordinary), compressor(model.ordinary + model.toxic)

    def gains(self, texts: list[str | None]) -> np.ndarray:
        """For each text how many windows have which gain, 0 (or less) to GAINS - 1 (or more)."""
        counts = np.zeros((len(texts), GAINS), np.int64)
        held, of = [], []
        for i, text in enumerate(texts):
            raw = plain(text)
            n = window_count(raw)
            for at in range(0, n, AT_ONCE):
                part = windows(raw, at, at + AT_ONCE)
                held += part
                of += [i] * len(part)
                if len(held) >= AT_ONCE:
                    self._add(counts, held, of)
                    held, of = [], []
        self._add(counts, held, of)
        return counts

    def _add(self, counts: np.ndarray, held: list[bytes], of: list[int]) -> None:
        gain = np.clip(lengths(self.ordinary, held) - lengths(self.toxic, held), 0, GAINS - 1)
        np.add.at(counts, (np.array(of, np.int64), gain), 1)


def features(counts: np.ndarray, threshold: int) -> np.ndarray:
    """For each row of counts: 1, log of windows at or over the threshold, of their gains' sum, and of all windows.

    Long ordinary texts have windows that gain by chance, which the last one makes up for.
    """
    over = counts[:, threshold:]
    return np.stack([np.ones(len(counts)), np.log1p(over.sum(1)), np.log1p(over @ np.arange(threshold, GAINS)), np.log1p(counts.sum(1))], 1)


def scores(counts: np.ndarray, threshold: int, weights: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(counts, threshold) @ np.array(weights), -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton's method; coefficients and mean log loss."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary that zstandard trains on ``samples``; too little text stands for itself."""
    if not samples:
        return b""
    size = 256 + max(2048, min(size, sum(map(len, samples)) // 8))  # zstandard's own tables take some 200 bytes
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PART, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def learn(base: bytes, ordinary: list[bytes], toxic: list[bytes], half: np.ndarray, toxic_bytes: int, ordinary_bytes: int) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary.

    The ordinary one is ``base``, stretches of text, and what is trained on ``ordinary`` windows.
    Most windows of a toxic document are ordinary; which ones aren't is found in rounds: a
    dictionary is trained on windows of one ``half`` of the toxic documents, and of the other
    half those stay that it saves TEACHING bytes or more, and the other way round. Ordinary
    windows that it saves as much teach the ordinary dictionary. Bounded samples, so all of this
    is some seconds on the driver.
    """
    of = lambda windows, mask: [windows[i] for i in np.flatnonzero(mask)]
    content = base + trained(ordinary, ordinary_bytes)
    keep = np.ones(len(toxic), bool)
    for _ in range(ROUNDS):
        plain_ = compressor(content)
        on_toxic, on_ordinary = lengths(plain_, toxic), lengths(plain_, ordinary)
        stays, mistaken = np.zeros(len(toxic), bool), np.zeros(len(ordinary), bool)
        for side in (0, 1):
            by = compressor(content + trained(of(toxic, keep & (half == side)), toxic_bytes))
            other = np.flatnonzero(half != side)
            stays[other] = on_toxic[other] - lengths(by, [toxic[i] for i in other]) >= TEACHING
            mistaken |= on_ordinary - lengths(by, ordinary) >= TEACHING
        if not stays.any():
            break
        keep = stays
        content += trained(of(ordinary, mistaken), ordinary_bytes)
    return content, trained(of(toxic, keep), toxic_bytes)


def _each(docs: DataFrame, keep: list[str], model: ToxicityModel, schema: T.StructType, finish) -> DataFrame:
    """Run ``finish(counts)``, a list of columns, over Arrow batches of whole texts."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    text = fresh(keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size, see train_toxicity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in in_pieces(batches):
            counts = scorer.gains(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *finish(counts)], names=[f.name for f in schema])

    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(work, schema)


def _residual(docs: DataFrame, base: bytes, least: int, share: float) -> DataFrame:
    """(half, window, cost) of a share of the windows of ``docs``, those that cost ``least`` bytes under ``base``."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(base)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = compressor(shared.value)
        for batch in in_pieces(batches):
            for half, text in zip(batch.column("__half").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = plain(text)
                rng = np.random.default_rng(zlib.crc32(raw))
                for at in range(0, window_count(raw), AT_ONCE):
                    own = windows(raw, at, at + AT_ONCE)
                    own = [w for w, r in zip(own, rng.random(len(own)), strict=True) if r < share]
                    cost = lengths(by, own)
                    good = np.flatnonzero(cost >= least)
                    yield pa.RecordBatch.from_arrays([pa.array([half] * len(good), pa.int32()), pa.array([own[i] for i in good], pa.binary()), pa.array(cost[good])], names=["half", "window", "cost"])

    return docs.select("__half", "text").mapInArrow(work, "half int, window binary, cost long")


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    key: str = "doc_id",
    max_rows: int = 24_000,
    max_windows: int = 80_000,
    base_bytes: int = 4 << 20,
    toxic_bytes: int = 1 << 14,
    ordinary_bytes: int = 1 << 16,
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows, those of smallest hash among which ``use`` holds.

    A third of them may be toxic. Three quarters teach the dictionaries: half of the ordinary
    ones give ``base_bytes`` of stretches of text, the windows of the others and of the toxic
    ones that cost most under these stretches, ``max_windows`` of either kind, are what
    :func:`learn` trains dictionaries of ``ordinary_bytes`` (a round) and ``toxic_bytes`` on.
    Copies of a text count once. On the last quarter the least gain that counts and a logistic
    curve are calibrated, with weights that restore the labels' own rates. Rows with a null
    label or text aren't used; without toxic rows nothing is ever called toxic. If the last
    quarter lacks a class, a fixed curve stands in.
    """
    h = F.xxhash64(F.col(key))
    marked = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull() & use).groupBy(key).agg((F.max("toxic") > 0).cast("int").alias("__toxic"))
    marked = table(marked, "marked")
    known = {r["__toxic"]: r["n"] for r in marked.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    took = {1: min(known.get(1, 0), max_rows // 3)}
    took[0] = min(known.get(0, 0), max_rows - took[1])
    chosen = marked.filter("__toxic = 1").orderBy(h, key).limit(took[1]).unionByName(marked.filter("__toxic = 0").orderBy(h, key).limit(took[0]))
    # at most max_rows ids and bits
    sample = docs.select(key, "text").filter("text is not null").join(F.broadcast(chosen), key).withColumns({"__fit": F.pmod(h, F.lit(4)) != 0, "__half": F.pmod(F.shiftright(h, 2), F.lit(2)).cast("int")})
    sample = table(sample, "labelled")
    fit = sample.filter("__fit").groupBy(F.xxhash64("text").alias("__h")).agg(*[F.min_by(c, key).alias(c) for c in ("text", "__half")], F.max("__toxic").alias("__toxic"))
    fit = table(fit, "taught")
    bad, other = fit.filter("__toxic = 1"), fit.filter("__toxic = 0")
    model = ToxicityModel(b"", b"")
    if not took[1] or not bad.count():
        return model

    stretch, longest = base_bytes // 1024, 4096
    at = F.pmod(F.xxhash64("__h"), F.greatest(F.lit(1), F.length("text") - longest)) + 1
    found = other.filter("__half = 0").orderBy("__h").limit(stretch).select(F.substr("text", at, F.lit(longest)).alias("t")).collect()
    base = b"\n".join(plain(r["t"]) for r in found)[:base_bytes]
    measured = F.ceil(F.octet_length("text") / STEP) + 1
    apart = other.filter("__half = 1")
    total = apart.agg(F.sum(measured)).first()[0] or 1
    pick = lambda df: sorted((r["half"], bytes(r["window"]), r["cost"]) for r in df.orderBy(F.xxhash64("window"), "window", "half").limit(max_windows).collect())
    ordinary = pick(_residual(apart, base, 0, min(1.0, max_windows / total)))
    least = int(np.quantile([c for _, _, c in ordinary], 0.9)) if ordinary else 0
    toxic = pick(_residual(bad, base, least, 1.0)) or pick(_residual(bad, base, 0, 1.0))
    half = np.array([a for a, _, _ in toxic])
    model.ordinary, model.toxic = learn(base, [w for _, w, _ in ordinary], [w for _, w, _ in toxic], half, toxic_bytes, ordinary_bytes)

    import pyarrow as pa

    schema = T.StructType([T.StructField("__toxic", T.IntegerType()), T.StructField("counts", T.ArrayType(T.LongType()))])
    rows = _each(sample.filter("not __fit"), ["__toxic"], model, schema, lambda c: [pa.array(c.tolist(), pa.list_(pa.int64()))]).collect()
    y = np.array([r["__toxic"] for r in rows], dtype=float)
    if 0 < y.sum() < len(y):
        counts = np.array([r["counts"] for r in rows])
        weight = np.where(y == 1, known[1] / took[1], known.get(0, 0) / max(took[0], 1))
        fits = {t: _fit(features(counts, t), y, weight / weight.mean()) for t in range(1, GAINS)}
        best = min(loss for _, loss in fits.values())
        model.threshold = min(t for t, (_, loss) in fits.items() if loss <= best + CLOSE)  # few rows can't tell closer ones apart
        model.weights = fits[model.threshold][0].tolist()
    else:
        model.threshold, model.weights = 4, [-3.0, 3.0, 0.0, 0.0]
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns ``keep`` of ``docs``, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5, else 0).

    Whole texts are scored, in bounded Arrow batches and stretches; a null or empty text has no
    window and the score of a text without any gain. ``names`` names the two results; kept
    columns of these names give way. Repeated rows are scored each; an empty table gives an
    empty one.
    """
    import pyarrow as pa

    keep = [c for c in keep if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def finish(counts: np.ndarray) -> list[pa.Array]:
        score = scores(counts, threshold, weights)
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    threshold, weights = model.threshold, model.weights  # the dictionaries themselves are broadcast
    return _each(docs, keep, model, schema, finish)

