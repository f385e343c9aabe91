"""Exact top-k inner-product search by best-first descent of M-trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_pieces, partitions, small_batches, split_join, table

#: Bytes of the directory's routers, the only part of the index that every task gets: 65,536 regions in 64 dimensions.
DIRECTORY_BYTES = 32 << 20
#: Searches of one tree that a task takes on; more of them are several tasks.
SEARCHES = 4096
#: Scores are longs; beyond their range they count as its ends.
LARGEST = (1 << 63) - 1
PAGE = "region int, chunk int, page int, leaf boolean, ids array<long>, rows array<long>, vectors binary, to_parent binary, radius binary, child binary"
EXACT = float(1 << 53)


def _dot(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of integers held as doubles; beyond 2 ** 53 in Python's own integers."""
    if largest < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    held = np.frompyfunc(lambda x: max(-LARGEST, min(LARGEST, x)), 1, 1)
    return held(whole(a).astype(object) @ whole(b).astype(object).T)


@dataclass
class Space:
    """Vectors lifted to one common length, so that the largest inner product is the smallest distance.

    A stored vector gets the coordinate ``sqrt(top - |x|^2)`` more and a query a zero, and then
    ``|q - x|^2 = |q|^2 + top - 2 q.x``: a metric, in which the triangle inequality prunes.
    ``slack`` covers the rounding of distances; scores are compared exactly.
    """

    top: float

    def lift(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (x * x).sum(1)
        return square, np.sqrt(np.maximum(self.top - square, 0))

    def stored(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances between stored vectors."""
        (a, s), (b, t) = self.lift(x), self.lift(y)
        plain = a[:, None] + b[None, :] - 2 * (x @ y.T)
        return np.sqrt(np.maximum(plain, 0) + (s[:, None] - t[None, :]) ** 2)

    def query(self, square: float | np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square + self.top - 2 * score, 0))

    def slack(self, square: float) -> float:
        return 4e-8 * (math.sqrt(self.top) + math.sqrt(square) + 1)


@dataclass
class Page:
    """A node: entries with their distance to the parent's router; inner ones with radius and child."""

    leaf: bool
    vectors: np.ndarray
    to_parent: np.ndarray
    ids: list | None = None
    rows: np.ndarray | None = None
    radius: np.ndarray | None = None
    child: np.ndarray | None = None


def build_pages(space: Space, x: np.ndarray, ids: list, rows: np.ndarray, router: np.ndarray, capacity: int) -> list[Page]:
    """Bulk-loaded M-tree over ``x``; page 0 is the root, whose entries lie around ``router``.

    A node of too many objects takes some far from one another as routers (each the farthest
    from those before it, of evenly spaced ones) and gives each object to the nearest. Where
    that hardly parts them (equal vectors) it is cut into equal runs.
    """
    pages: list[Page] = []

    def apart(members: np.ndarray, fan: int) -> np.ndarray:
        some = members[np.unique(np.linspace(0, len(members) - 1, min(len(members), 8 * fan)).astype(int))]
        between = space.stored(x[some], x[some])
        chosen = [int(between.sum(0).argmin())]
        far = between[chosen[0]]
        while len(chosen) < fan:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, between[chosen[-1]])
        return some[chosen]

    def node(members: np.ndarray, around: np.ndarray) -> tuple[int, float]:
        """Page number and covering radius of the subtree over ``members``."""
        at = len(pages)
        pages.append(Page(True, x[:0], np.empty(0)))
        far = space.stored(x[members], around[None, :])[:, 0]
        if len(members) <= capacity:
            pages[at] = Page(True, x[members], far, [ids[m] for m in members], rows[members])
            return at, float(far.max(initial=0))
        fan = min(32, -(-len(members) // capacity))
        chosen = apart(members, fan)
        near = space.stored(x[members], x[chosen]).argmin(1)
        if np.bincount(near, minlength=fan).max() > 0.95 * len(members):
            near = np.arange(len(members)) * fan // len(members)
        kids, radii, used = [], [], np.unique(near)
        for g in used:
            kid, radius = node(members[near == g], x[chosen[g]])
            kids.append(kid)
            radii.append(radius)
        routers = x[chosen[used]]
        pages[at] = Page(False, routers, space.stored(routers, around[None, :])[:, 0], radius=np.array(radii), child=np.array(kids))
        return at, float(far.max())

    node(np.arange(len(x)), router)
    return pages


def best_first(space: Space, pages: list[Page], q: np.ndarray, to_router: float, k: int, own: int, floor: float, largest: float) -> tuple[list[tuple], int]:
    """The ``k`` best (score, id, row) of a tree with scores of ``floor`` or more, and how many distances it took.

    Pages are opened in the order of the least distance that anything below them can have, until
    that exceeds the k-th best. Entries whose stored distance to the parent already rules them
    out, by the triangle inequality, are passed over without computing theirs.
    """
    square = float(q @ q)
    slack = space.slack(square)
    best: list[tuple] = []  # (-score, id is null, id, row), ascending
    worst = floor
    limit = math.inf if worst == -math.inf else float(space.query(square, worst)) + slack
    heap, computed = [(0.0, 0, to_router)], 0
    while heap:
        least, at, to_parent = heapq.heappop(heap)
        if least > limit:
            break
        page = pages[at]
        gap = np.abs(to_parent - page.to_parent) - (0 if page.leaf else page.radius)
        open_ = np.flatnonzero(gap <= limit)
        if not len(open_):
            continue
        computed += len(open_)
        score = _dot(page.vectors[open_], q[None, :], largest)[:, 0]
        if page.leaf:
            good = np.flatnonzero((score >= worst).astype(bool) & (page.rows[open_] != own))
            if not len(good):
                continue
            found = [(-int(score[g]), page.ids[open_[g]] is None, page.ids[open_[g]] or 0, int(page.rows[open_[g]])) for g in good]
            best = sorted(best + found)[:k]
            if len(best) == k:
                worst = max(worst, float(-best[-1][0]))
                limit = float(space.query(square, worst)) + slack
        else:
            away = space.query(square, score.astype(float))
            for d, lo, child in zip(away, np.maximum(away - page.radius[open_], 0), page.child[open_], strict=True):
                if lo <= limit:
                    heapq.heappush(heap, (float(lo), int(child), float(d)))
    return [(-s, None if null else i, r) for s, null, i, r in best], computed


@dataclass
class Directory:
    """Two levels above the trees: groups, and of each region its router, group, covering radius and number of trees.

    A group's regions lie around one of them, so that a row is compared with some hundred
    routers and not with all; where it ends up only decides how well the bounds prune.
    """

    routers: np.ndarray
    centres: np.ndarray
    members: list[np.ndarray]
    radius: np.ndarray
    chunks: np.ndarray
    reach: np.ndarray

    @classmethod
    def over(cls, space: Space, routers: np.ndarray) -> Directory:
        n = len(routers)
        centres = routers[np.linspace(0, n - 1, max(1, math.isqrt(n))).astype(int)]
        group = np.concatenate([space.stored(routers[at : at + 1024], centres).argmin(1) for at in range(0, n, 1024)])
        members = [np.flatnonzero(group == g) for g in range(len(centres))]
        return cls(routers, centres, members, np.full(n, -1.0), np.zeros(n, int), np.full(len(centres), -1.0))

    def known(self, space: Space, region: list[int], radius: list[float], chunks: list[int]) -> None:
        """Covering radii of the regions that hold rows, and from them of the groups."""
        self.radius[region], self.chunks[region] = radius, chunks
        for g, own in enumerate(self.members):
            own = own[self.chunks[own] > 0]
            if len(own):
                self.reach[g] = float((space.stored(self.routers[own], self.centres[g : g + 1])[:, 0] + self.radius[own]).max())

    def place(self, space: Space, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Region of each row and the distance to its router."""
        group = space.stored(x, self.centres).argmin(1)
        region, far = np.zeros(len(x), np.int32), np.zeros(len(x))
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            between = space.stored(x[rows], self.routers[self.members[g]])
            near = between.argmin(1)
            region[rows], far[rows] = self.members[g][near], between[np.arange(len(rows)), near]
        return region, far

    def within(self, space: Space, q: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Regions in which something may lie within ``limit`` of a query, and the distances to their routers."""
        square = float(q @ q)
        groups = np.flatnonzero((self.reach >= 0) & (space.query(square, self.centres @ q) - self.reach <= limit))
        regions = np.concatenate([self.members[g] for g in groups]) if len(groups) else np.empty(0, int)
        regions = regions[self.chunks[regions] > 0]
        away = space.query(square, self.routers[regions] @ q)
        good = away - self.radius[regions] <= limit
        return regions[good], away[good]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pages_of(batches: Iterator[pa.RecordBatch], schema: str, space: Space, directory: Directory, capacity: int) -> Iterator[pa.RecordBatch]:
    """Trees of the (region, chunk) groups of a stream that is sorted by them."""
    held, group = [], None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            x = _matrix(whole.column("vector").combine_chunks())
            pages = build_pages(space, x, whole.column("id").to_pylist(), whole.column("row").to_numpy(), directory.routers[group[0]], capacity)
            for at in range(0, len(pages), 32):
                yield _batch(
                    schema,
                    [
                        (*group, n, p.leaf, p.ids, None if p.rows is None else p.rows.tolist(), p.vectors.tobytes(), p.to_parent.tobytes(), None if p.leaf else p.radius.tobytes(), None if p.leaf else p.child.astype("<i4").tobytes())
                        for n, p in enumerate(pages[at : at + 32], at)
                    ],
                )

    for batch in in_pieces(batches, rows=1024):
        keys = np.stack([batch.column("region").to_numpy(), batch.column("chunk").to_numpy()], 1)
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if (now := tuple(keys[a].tolist())) != group:
                    yield from flush()
                    held, group = [], now
                held.append(batch.slice(a, b - a))
    yield from flush()


def _read_page(r: dict, dim: int) -> Page:
    floats = lambda b: np.frombuffer(b, np.float64)
    vectors = floats(r["vectors"]).reshape(-1, dim)
    if r["leaf"]:
        return Page(True, vectors, floats(r["to_parent"]), r["ids"], np.array(r["rows"], np.int64))
    return Page(False, vectors, floats(r["to_parent"]), radius=floats(r["radius"]), child=np.frombuffer(r["child"], "<i4"))


HIT = "query long, id long, row long, score long"


def _search(pages: DataFrame, asked: DataFrame, space: Space, dim: int, k: int) -> DataFrame:
    """(query, id, row, score) that the trees (region, chunk) named in ``asked`` find.

    ``asked`` has region, chunk, query (row number), vector, to_router and floor. A tree's pages
    and then about SEARCHES of its queries pass through one task in order: memory holds one tree
    and one batch. A tree that more queries ask is read by several tasks.
    """
    asked = table(asked, "asked")
    slices = asked.groupBy("region", "chunk").agg(F.ceil(F.count(F.lit(1)) / SEARCHES).cast("int").alias("slices"))
    pages = split_join(pages, slices, ["region", "chunk"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    asked = split_join(asked, slices, ["region", "chunk"]).withColumn("slice", F.pmod(F.xxhash64("query"), F.col("slices")).cast("int")).drop("slices")
    keep = ["region", "chunk", "slice", "kind", *[f.split()[0] for f in PAGE.split(", ")[2:]], "query", "vector", "to_router", "floor"]
    left = pages.withColumns({"kind": F.lit(0), "query": F.lit(None).cast("long"), "vector": F.lit(None).cast("array<double>"), "to_router": F.lit(None).cast("double"), "floor": F.lit(None).cast("double")})
    right = asked.withColumn("kind", F.lit(1))
    for f in PAGE.split(", ")[2:]:
        name, kind = f.split()
        right = right.withColumn(name, F.lit(None).cast(kind))
    stream = left.select(keep).unionByName(right.select(keep)).repartition(partitions(pages.sparkSession), "region", "chunk", "slice").sortWithinPartitions("region", "chunk", "slice", "kind", "page")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree = None, []
        for batch in in_pieces(batches):
            out = []
            for r in batch.to_pylist():  # a row a page or query; a page's vectors are one value
                if (now := (r["region"], r["chunk"], r["slice"])) != group:
                    group, tree = now, []
                if r["kind"] == 0:
                    tree.append(_read_page(r, dim))
                    continue
                q = np.array(r["vector"])
                largest = math.sqrt(float(q @ q)) * math.sqrt(space.top)
                floor = -math.inf if r["floor"] is None else r["floor"]
                for score, i, row in best_first(space, tree, q, r["to_router"], k, r["query"], floor, largest)[0]:
                    out.append((r["query"], i, row, score))
            if out:
                yield _batch(HIT, out)

    return stream.mapInArrow(work, HIT)


def whole_numbers(column: Column, scale: float) -> Column:
    """Components multiplied by ``scale`` as doubles and rounded down; null if one is null or not finite.

    Beyond 1e100 they count as that, so that squares stay finite; scores are out of range long before.
    """
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() gives a long, which huge components don't fit; x - pmod(x, 1) stays a double
    down = lambda x: F.when(F.abs(x) < 1e15, F.floor(x).cast("double")).otherwise(F.greatest(F.lit(-1e100), F.least(F.lit(1e100), x)))
    return F.when(sound, F.transform(column, lambda x: down(x.cast("double") * F.lit(float(scale)))))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", column: str = "embedding", scale: float = 1024.0, tree_rows: int = 32_768, page_bytes: int = 128 << 10) -> DataFrame:
    """The ``k`` rows of highest inner product for each row of ``vectors`` for which ``is_query`` holds.

    Components are first turned into ``floor(scale * x)``; scores are exact integers. All other
    rows are candidates, also ones with the query's own key; equal scores go to the smaller key,
    null keys last. The result has query_id, rank (int, from 1), the key and score.

    Rows go to the nearest router (rows of smallest hash, one for each tree of about
    ``tree_rows`` rows, DIRECTORY_BYTES at most) and, by hash, to one of the region's trees of
    at most about as many rows, so equal vectors without number are many trees. A query first searches a tree of its nearest region; its k-th score
    then rules out regions by their covering radius and prunes inside the other trees. Scores
    beyond a long's range count as its ends, where the smaller key decides.

    Vectors that are null, hold null or non-finite components, or differ in length from the most
    frequent one take no part. Only the key and the vector are read, so other columns don't
    clash. An empty table, or one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(column).cast("array<double>"), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = table(rows.filter("vector is not null and size(vector) > 0").withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).orderBy(F.desc("n"), "dim").first()
    out = "query_id long, rank int, {} long, score long".format(key)
    if sizes is None:
        return spark.createDataFrame([], out)
    dim, n = sizes["dim"], sizes["n"]
    space = Space(sizes["top"])
    rows = rows.filter(F.size("vector") == dim)
    tree = max(1024, min(tree_rows, (32 << 20) // (8 * dim), -(-n // 48)))
    capacity = max(16, min(256, page_bytes // (8 * dim)))
    pivots = rows.orderBy(F.xxhash64("row"), "row").limit(max(1, min(DIRECTORY_BYTES // (8 * dim), -(-n // tree)))).select("vector").collect()
    directory = Directory.over(space, np.unique(np.array([r["vector"] for r in pivots]), axis=0))
    small_batches(spark)

    def assign(batches):
        for batch in in_pieces(batches, rows=1024):
            region, far = directory.place(space, _matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(far)], names=[*batch.schema.names, "region", "far"])

    placed = table(rows.select("id", "row", "vector", "asks").mapInArrow(assign, "id long, row long, vector array<double>, asks boolean, region int, far double"), "placed")
    facts = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # a row a region
    directory.known(space, [r["region"] for r in facts], [r["radius"] for r in facts], [-(-r["n"] // tree) for r in facts])
    counts = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(directory.chunks)], "region int, chunks int"))
    chunked = placed.join(counts, "region").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).select("region", "chunk", "id", "row", "vector")
    stream = chunked.repartition(partitions(spark), "region", "chunk").sortWithinPartitions("region", "chunk", "row")
    pages = table(stream.mapInArrow(lambda b: _pages_of(b, PAGE, space, directory, capacity), PAGE), "pages")

    queries = placed.filter("asks").select(F.col("row").alias("query"), "id", "vector")

    def route(first: bool):
        """Home tree of each query, or all other trees in which something may reach its floor."""

        def work(batches):
            for batch in in_pieces(batches):
                q = _matrix(batch.column("vector"))
                squares = (q * q).sum(1)
                of = batch.column("query").to_numpy()
                home, _ = directory.place(space, q)  # where the row itself lies
                turn = of % directory.chunks[home]
                take, region, chunk, router = [], [], [], []
                floors = [None] * len(q) if first else batch.column("floor").to_pylist()
                for i in range(len(q)):
                    if first:
                        found = [(home[i], float(space.query(squares[i], directory.routers[home[i]] @ q[i])))]
                    else:
                        limit = math.inf if floors[i] is None else float(space.query(squares[i], floors[i])) + space.slack(squares[i])
                        found = zip(*directory.within(space, q[i], limit), strict=True)
                    for g, away in found:
                        for c in range(directory.chunks[g]):
                            if ((g, c) == (home[i], turn[i])) == first:
                                take.append(i)
                                region.append(g)
                                chunk.append(c)
                                router.append(away)
                for at in range(0, len(take), 4096):
                    part = np.array(take[at : at + 4096], np.int64)
                    g = np.array(region[at : at + 4096], np.int32)
                    floor = pa.nulls(len(part), pa.float64()) if first else batch.column("floor").take(pa.array(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g), pa.array(np.array(chunk[at : at + 4096], np.int32)), pa.array(of[part]), batch.column("vector").take(pa.array(part)), pa.array(np.array(router[at : at + 4096], np.float64)), floor],
                        names=["region", "chunk", "query", "vector", "to_router", "floor"],
                    )

        return work

    asked = "region int, chunk int, query long, vector array<double>, to_router double, floor double"
    near = table(_search(pages, queries.select("query", "vector").mapInArrow(route(True), asked), space, dim, k), "near")
    # with k hits the k-th score; with fewer nothing is ruled out yet
    floors = near.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    floored = split_join(queries.select("query", "vector"), floors, ["query"], "left").select("query", "vector", "floor")
    rest = _search(pages, floored.mapInArrow(route(False), asked), space, dim, k)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = near.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = split_join(ranked, queries.select("query", F.col("id").alias("query_id")), ["query"])
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
