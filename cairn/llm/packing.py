"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_pieces, kept, small_batches, table

#: Bytes that a worker's cache of words may take, about, and what an entry takes besides its letters and ids.
CACHE, ENTRY = 64 << 20, 180
_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACE = "\t-\r \x85\xa0"
#: The vocabulary's own split, over lower-cased text of the first 256 code points.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
#: What the vocabulary's file must say for PIECE and lower-casing to hold: fixed values of its format.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
#: White space for Python alone.
SEPARATORS = re.compile("[\x1c-\x1f]")


class Encoder(dict):
    """Token ids as little-endian unsigned 32-bit bytes; a bounded cache of words that fills itself.

    The tokenizer never joins across white space, so ids of a text are those of its words. A word
    of the first 256 code points, lower-cased, is split as the tokenizer does it, and each piece
    goes to the tokenizer's model alone, which saves the rest of its work. Other words go to the
    whole tokenizer. A text that may hold a special token's name goes there in one piece, as do
    all texts if the vocabulary's file asks for another normaliser or split than these.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.spell = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.held = 0
        self.split = self._knows_the_split(path)

    @staticmethod
    def _knows_the_split(path: str) -> bool:
        """Whether the file normalises and splits as this class does: lower case, PIECE, bytes."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        return whole["normalizer"] == NORMALIZER and whole["pre_tokenizer"] == PRE_TOKENIZER and whole["model"]["type"] == "BPE"

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = self.spell(piece)[0][0]  # its bytes in the model's own alphabet
        return b"".join([self.raw[t.id] for t in self.model.tokenize(piece)])

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            ids = self._piece(word.lower())
        else:
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                ids = self._ids(word)
            else:
                ids = b"".join(map(self._piece, PIECE.findall(word.lower())))
        self[word] = ids
        self.held += ENTRY + len(word) + len(ids)
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.split or "<|" in text or SEPARATORS.search(text):
            return self._ids(text)
        if self.held > CACHE:
            self.clear()
            self.held = 0
        # beyond 256 code points case can depend on what stands around
        words = text.lower().split() if text.isascii() or max(text) < "\u0100" else text.replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each whole text with ``end_id`` after it.

    Returns doc (row number of the document), key, piece, start, length, ids_crc32 and, if asked
    for, ids (little-endian unsigned 32-bit). A null text counts as empty: one piece of one token.
    """
    small_batches(docs.sparkSession)
    fields = f"doc long, {key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    end, step = np.array([end_id], "<u4").tobytes(), capacity * 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(("encoder", tokenizer), lambda: Encoder(tokenizer)).encode  # tasks of a worker share its cache
        for batch in in_pieces(batches):
            of, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text) + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    of.append(i)
                    rows.append((at // step, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(of)), batch.column(key).take(pa.array(of)), *columns], names=["doc", key, *names])

    return docs.select(F.monotonically_increasing_id().alias("doc"), key, "text").mapInArrow(work, fields)


class Bins:
    """Open bins by room left; the best fit is the lowest set bit at or over a size."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.at, self.mask = capacity, [], [[] for _ in range(capacity + 1)], 0

    def open(self, room: int) -> int:
        self.room.append(room)
        self.at[room].append(len(self.room) - 1)
        self.mask |= 1 << room
        return len(self.room) - 1

    def put(self, size: int) -> int:
        fits = self.mask >> size
        if not fits:
            return self.open(self.capacity - size)
        room = size + (fits & -fits).bit_length() - 1
        bin_ = self.at[room].pop()
        if not self.at[room]:
            self.mask &= ~(1 << room)
        left = room - size
        self.room[bin_] = left
        self.at[left].append(bin_)
        self.mask |= 1 << left
        return bin_


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, start: np.ndarray | None = None) -> np.ndarray:
    """Bin of each item; items with a bin in ``start`` (-1: none) stay, the rest are best-fitted in ``order``."""
    out = np.full(len(sizes), -1) if start is None else start.copy()
    bins = Bins(capacity)
    placed = out >= 0
    if placed.any():
        _, out[placed] = np.unique(out[placed], return_inverse=True)
        for load in np.bincount(out[placed], sizes[placed]).astype(int):
            bins.open(capacity - int(load))
    todo = order[~placed[order]]
    out[todo] = [bins.put(s) for s in sizes[todo].tolist()]
    return out


def whole_bins(sizes: np.ndarray, capacity: int, rng: np.random.Generator, start: np.ndarray | None = None) -> np.ndarray:
    """Bin of each item, bin by bin: the largest item left and the one, two or three others that fit best beside it.

    Items with a bin in ``start`` stay. ``rng`` decides which of the fitting sizes are tried
    first, so that repeated runs differ.
    """
    out = np.full(len(sizes), -1) if start is None else start.copy()
    placed = out >= 0
    if placed.any():
        _, out[placed] = np.unique(out[placed], return_inverse=True)
    bin_ = int(out.max(initial=-1)) + 1
    own: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.flatnonzero(~placed).tolist():
        own[sizes[i]].append(i)
    mask = sum(1 << s for s in range(1, capacity + 1) if own[s])

    def take(size: int) -> None:
        nonlocal mask
        out[own[size].pop()] = bin_
        if not own[size]:
            mask &= ~(1 << size)

    def fit(room: int, without: int = 0) -> int:
        """Largest size that fits, not counting the last item of size ``without``."""
        m = mask & ((2 << room) - 1)
        if without and len(own[without]) == 1:
            m &= ~(1 << without)
        return m.bit_length() - 1 if m else 0

    def pair(room: int, tries: int) -> tuple[int, int]:
        best, top = (0, 0), fit(room)
        b = top
        while b > 0 and tries:
            tries -= 1
            c = fit(min(room - b, b), b)
            if b + c > sum(best):
                best = b, c
                if b + c == room:
                    break
            b = fit(b - 1)
        return best

    while mask:
        largest = mask.bit_length() - 1
        take(largest)
        room = capacity - largest
        best: tuple[int, ...] = pair(room, 200)
        if sum(best) < room and room > 2:
            for cut in rng.integers(1, room, 8).tolist():
                d = fit(cut)
                if d and sum(best) < room:
                    b, c = pair(room - d, 20)
                    need = [d, b, c]
                    if d + b + c > sum(best) and all(len(own[x]) >= need.count(x) for x in need if x):
                        best = d, b, c
        for size in best:
            if size:
                take(size)
        left = room - sum(best)
        while left and (size := fit(left)):
            take(size)
            left -= size
        bin_ += 1
    return out


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by the sum, and by items that can't share a bin (Martello and Toth's second bound)."""
    best = -(-int(sizes.sum()) // capacity)
    for k in np.unique(np.append(sizes[sizes <= capacity // 2], 0)):
        large, middle = sizes > capacity - k, (sizes > capacity // 2) & (sizes <= capacity - k)
        small = (sizes <= capacity // 2) & (sizes >= k)
        spare = int(middle.sum()) * capacity - int(sizes[middle].sum())
        best = max(best, int(large.sum() + middle.sum()) + max(0, -(-(int(sizes[small].sum()) - spare) // capacity)))
    return best


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins, then bins filled more unevenly (mean squared fill), are better: (-bins, fill)."""
    loads = np.bincount(bins, sizes)
    return -len(loads), float(((loads / capacity) ** 2).mean())


def cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Child of ``a`` with some of the best filled whole bins of ``b``.

    Bins of ``a`` that share an item with an injected one are broken up, and its least filled
    ones too; their other items are displaced and best-fitted again: each to the bin it fits
    best, the larger ones first, or as whole bins.
    """
    load = np.bincount(b, sizes)
    full = np.flatnonzero(load >= np.quantile(load, 0.5))
    chosen = rng.choice(full, max(1, int(len(full) * rng.choice([0.05, 0.2, 0.5]))), replace=False)
    injected = np.isin(b, chosen)
    hit = np.isin(a, a[injected])
    own = np.bincount(a, sizes)
    weak = own[a] < min(0.97 * capacity, np.quantile(own, rng.choice([0.05, 0.2, 0.5])))
    child = np.where(injected, b + a.max() + 1, np.where(hit | weak, -1, a))
    if rng.random() < 0.5:
        return whole_bins(sizes, capacity, rng, child)
    return best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity, child)


def evolve(sizes: np.ndarray, capacity: int, people: list[np.ndarray], children: int, size: int, seed: int, island: int = 0) -> list[np.ndarray]:
    """One epoch of an island: best individual first, ``size`` of them at most.

    Islands of even number start from best fit by decreasing size, odd ones from whole bins.
    With the fewest bins that any packing can have nothing is left to search.
    """
    rng = np.random.default_rng(seed)
    if not people:
        people = [best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity)]
    fewest = min(int(p.max(initial=-1)) + 1 for p in people)
    bound = -(-int(sizes.sum()) // capacity)
    if fewest > bound:
        bound = least_bins(sizes, capacity)
    if len(people) == 1 and fewest > bound:
        while len(people) < size:
            if island % 2:
                people.append(whole_bins(sizes, capacity, rng))
            else:  # items near in size change places
                people.append(best_fit(sizes, np.argsort(-sizes * rng.uniform(0.9, 1.0, len(sizes)), kind="stable"), capacity))
    scored = sorted(((fitness(sizes, p, capacity), i, p) for i, p in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    for k in range(children):
        if -scored[0][0][0] <= bound:
            break
        i, j = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = cross(scored[i][2], scored[j][2], sizes, capacity, rng)
        scored.append((fitness(sizes, child, capacity), -k - 1, child))
        scored = sorted(scored, key=lambda x: (x[0], -x[1]), reverse=True)[:size]
    return [p for _, _, p in scored[:size]]


def _islands(items: DataFrame, block: str, capacity: int, islands: int, epochs: int, children: int, size: int, name: str) -> DataFrame:
    """(block, ids, bins) with the best packing that the islands of each block have found."""
    blocks = items.groupBy(F.col(block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "length"))).alias("items"))
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.id").alias("ids"), F.col("items.length").alias("sizes"))
    state = state.select("*", F.lit(None).cast("array<array<int>>").alias("people"), F.lit(None).cast("array<int>").alias("elite"))
    schema = "block long, island int, ids array<long>, sizes array<long>, people array<array<int>>, elite array<int>, bins int, fill double"

    for epoch in range(epochs):

        def work(frames, epoch=epoch):
            for f in frames:
                rows = []
                for r in f.itertuples(index=False):
                    sizes = np.asarray(r.sizes, np.int64)
                    people = [np.asarray(p, np.int64) for p in r.people] if r.people is not None else []
                    if r.elite is not None:
                        people = [*people[: size - 1], np.asarray(r.elite, np.int64)]
                    people = evolve(sizes, capacity, people, children, size, hash((int(r.block), int(r.island), epoch)) & 0x7FFFFFFF, int(r.island))
                    n, fill = fitness(sizes, people[0], capacity)
                    rows.append((r.block, r.island, r.ids, r.sizes, [p.astype(np.int32) for p in people], people[0].astype(np.int32), -n, fill))
                yield _frame(rows)

        state = table(state.repartition("block", "island").mapInPandas(work, schema), f"{name}-{epoch}")
        if epoch + 1 < epochs:  # elites move to the next island of their block
            moved = state.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), "elite")
            state = state.select("block", "island", "ids", "sizes", "people").join(moved, ["block", "island"])
    best = state.groupBy("block").agg(F.min_by("island", F.struct("bins", -F.col("fill"), "island")).alias("island"))
    return state.join(best, ["block", "island"]).select("block", "ids", "sizes", F.col("elite").alias("bin"))


def _frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["block", "island", "ids", "sizes", "people", "elite", "bins", "fill"])


def _placed(solved: DataFrame) -> DataFrame:
    """(block, bin, id, length, offset, load) of each packed item, the longer ones of a bin first."""
    item = F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("sizes").alias("length"), F.col("bin").alias("bin"))).alias("x")
    flat = solved.select("block", item).select("block", "x.*")
    bin_ = Window.partitionBy("block", "bin")
    before = bin_.orderBy(F.desc("length"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return flat.select("*", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), F.sum("length").over(bin_).alias("load"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    key: str = "doc_id",
    block_items: int = 4096,
    islands: int = 2,
    epochs: int = 3,
    children: int = 40,
    population: int = 4,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Documents longer than ``capacity`` are cut into full pieces, which are sequences of their
    own, and a rest. Rests and short documents are dealt by hash into blocks of about
    ``block_items``; each block is packed by ``islands`` populations that run as separate tasks
    and after each epoch hand their elite to the next island. What lies in sequences under
    nine tenths full is dealt and packed once more. Where the largest size that is left always
    fits somewhere, as with many short documents, best fit by decreasing size already reaches
    the bound and the islands have nothing to do.

    Returns key, piece, start, length, ids_crc32, sequence_id and offset (and ids). Columns of
    ``docs`` other than the key and text aren't read. A null text counts as empty; repeated rows
    are packed each; an empty table gives an empty result.
    """
    pieces = table(tokenize(docs, tokenizer, capacity, end_id, key, with_ids), "pieces")
    # a document has one piece that isn't full at most, so its row number names the item
    items = pieces.filter(F.col("length") < capacity).select(F.col("doc").alias("id"), "length")
    n = items.count()
    blocks = max(1, -(-n // block_items))
    dealt = items.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    solved = table(_placed(_islands(dealt, "b", capacity, islands, epochs, children, population, "islands")), "packed")
    good = F.col("load") >= 0.9 * capacity
    loose = solved.filter(~good).select("id", "length")
    share = max(1, -(-loose.count() // block_items))
    again = _placed(_islands(loose.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(share))), "b", capacity, 1, 1, children, population, "loose"))
    number = lambda k: (F.lit(k << 60) + F.col("block") * (1 << 30) + F.col("bin")).alias("sequence_id")
    places = solved.filter(good).select(F.col("id").alias("doc"), number(0), "offset").unionByName(again.select(F.col("id").alias("doc"), number(1), "offset"))
    kept = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    short = pieces.filter(F.col("length") < capacity).join(places, "doc").select(kept)
    whole = pieces.filter(F.col("length") == capacity)
    whole = whole.select("*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(kept)
    return short.unionByName(whole)
