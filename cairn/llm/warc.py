"""Deterministic sharded WARC writer, and a reader for what it wrote."""

from __future__ import annotations

import base64
import bisect
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_pieces, partitions, qualified, small_batches, split_join, table
from .sharding import balanced_shards

#: Capture time is not among the inputs, so all records carry the same one.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, shard int, part int, records long, bytes long, sha1 string"
PRINTABLE = "".join(map(chr, range(33, 127)))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(kind: str, *parts: object) -> str:
    """A record's id, which only its content decides."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, (kind, *parts))))}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member; no time stamp, so equal records give equal bytes."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page: str | None, url: str | None, html: bytes, size: int, digest: str, first: str | None, revisit: bool) -> bytes:
    """The response or revisit record of a page; of a revisit only the HTTP header is stored."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_uri("page", page, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", urllib.parse.quote(url or "", safe=PRINTABLE) or "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        fields.append(("X-Page-Key", urllib.parse.quote(page, safe=PRINTABLE)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri("page", first, digest)), ("X-Refers-To-Key", urllib.parse.quote(first or "", safe=PRINTABLE))]
    return _record(fields, head if revisit else head + html)


class _Roll:
    """Files of one shard; each is written under a temporary name and renamed when it is whole."""

    def __init__(self, folder: str, shard: int, limit: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.shard, self.limit, self.part, self.out = folder, shard, limit, 0, None
        self.fs.create_dir(self.root, recursive=True)

    def add(self, record: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.temporary = f"{self.root}/.{uuid.uuid4().hex}.open"
            self.out, self.records, self.size, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1()
            info = f"software: cairn\r\nformat: WARC File Format 1.1\r\nshard: {self.shard}\r\npart: {self.part}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_uri("info", self.shard, self.part)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self.records += 1
        if self.size >= self.limit:
            yield from self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.fs.move(self.temporary, f"{self.root}/{name}")
            yield f"{self.folder}/{name}", self.shard, self.part, self.records, self.size, self.sha.hexdigest()
            self.part, self.out = self.part + 1, None


def _place(key: object, digest: str) -> tuple:
    """Sorts as Spark sorts (key, digest): null keys first."""
    return (key is not None, key if key is not None else 0, digest)


def write_warc(
    pages: DataFrame, folder: str, key: str = "page_id", min_revisit_bytes: int = 0, shard_bytes: int = 256 << 20, min_shards: int = 64, roll_bytes: int = 32 << 20
) -> DataFrame:
    """Write a record per row of ``pages`` (key, url, html) below ``folder``; returns the manifest.

    Records are sorted by key and digest and cut into contiguous shards of near-equal payload
    bytes, ``min_shards`` at least; a shard's files roll over at ``roll_bytes`` compressed bytes.
    Equal inputs give equal files, whatever the cluster: a lost task's second run renames the
    same bytes to the same names. Readers only trust files in the manifest, which Spark commits
    when all are written. Of equal payloads of at least ``min_revisit_bytes`` that with the
    smallest key is a response, the rest are revisits of it. A null html counts as empty, a null
    url as about:blank. Rows repeated as a whole give a record each: responses if their key is
    the smallest. A row with a null key revisits one with a key; among nulls all are responses.
    Of ``pages`` only these three columns are read, so others don't clash. Payloads of any length
    are written whole, a record at a time; an empty table gives an empty manifest and no files.
    A lost task's unfinished file stays under its hidden temporary name, which no manifest holds.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)  # the tasks open files by themselves, in the same store as Spark
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("key"), "url", payload.alias("payload"))
    size, digest = F.octet_length("payload").cast("long"), F.sha1("payload")
    facts = table(rows.select("key", digest.alias("digest"), size.alias("size")).groupBy("key", "digest").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("rows")), "facts")
    firsts = facts.filter(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    facts = split_join(facts, firsts, ["digest"], "left").withColumn("revisit", F.coalesce(~F.col("key").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    facts = facts.withColumn("stored", F.col("rows") * F.when(F.col("revisit"), 1).otherwise(F.col("size") + 1))
    total = facts.agg(F.coalesce(F.sum("stored"), F.lit(0))).first()[0]
    sharded = balanced_shards(facts, "stored", ["key", "digest"], max(min_shards, -(-total // shard_bytes)))
    plan = table(sharded.select("key", "digest", "size", F.col("first").cast("string").alias("first"), "revisit", "shard"), "plan")
    # where each shard begins: a row per shard, which payload rows are placed by
    starts = plan.groupBy("shard").agg(F.min(F.struct(F.col("key").isNotNull().alias("some"), "key", "digest")).alias("at")).orderBy("shard").collect()
    bounds = [_place(r["at"]["key"], r["at"]["digest"]) for r in starts]
    shards = [r["shard"] for r in starts]
    small_batches(spark)
    kind = pages.schema[key].dataType.simpleString()

    def place(batches):
        for batch in in_pieces(batches):
            of = [bisect.bisect_right(bounds, _place(k, d)) - 1 for k, d in zip(batch.column("key").to_pylist(), batch.column("digest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shards[i] for i in of], pa.int32())], names=[*batch.schema.names, "shard"])

    placed = rows.select("key", "url", "payload", digest.alias("digest")).mapInArrow(place, f"key {kind}, url string, payload binary, digest string, shard int")
    both = plan.withColumn("kind", F.lit(0)).unionByName(placed.withColumn("kind", F.lit(1)), allowMissingColumns=True).withColumn("name", F.col("key").cast("string"))
    # of each (key, digest) the planned fact comes first, then its pages: payloads are shuffled once
    records = both.repartition(max(partitions(spark), len(shards)), "shard").sortWithinPartitions("shard", F.asc_nulls_first("key"), "digest", "kind", "url")

    def work(batches):
        roll, done, fact = None, [], None
        for batch in in_pieces(batches, rows=128):
            for r in batch.select(["kind", "name", "url", "payload", "digest", "size", "first", "revisit", "shard"]).to_pylist():
                if r["kind"] == 0:
                    fact = r
                    continue
                if roll is None or roll.shard != r["shard"]:
                    done += [] if roll is None else roll.close()
                    roll = _Roll(folder, r["shard"], roll_bytes)
                sha = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                done += roll.add(page_record(r["name"], r["url"], r["payload"], fact["size"], sha, fact["first"], fact["revisit"]))
        done += [] if roll is None else roll.close()
        names = [n.split()[0] for n in MANIFEST.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)

    manifest = records.mapInArrow(work, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    rest, z, out = b"", zlib.decompressobj(31), []
    while data := rest or stream.read(1 << 20):
        out.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the last record is cut off")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record, whose length and digest must be right."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("damaged record " + fields.get("WARC-Record-ID", ""))
    return fields, block


def read_warc(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the files in ``manifest``: key (string), url, payload_bytes, payload_digest, record_type, refers_to.

    Every block's digest is checked, and of responses the payload's. The files are opened with
    pyarrow's file systems, in the store that the manifest names.
    """
    schema = "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: len(names)]
    small_batches(spark)

    def work(batches):
        from pyarrow import fs

        for batch in in_pieces(batches):
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for member in _members(stream):
                        fields, block = parse_record(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.decode().rsplit("Content-Length: ", 1)[1])
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError("damaged payload " + fields["WARC-Record-ID"])
                        text = lambda k: urllib.parse.unquote(fields[k]) if k in fields else None  # noqa: E731, B023
                        rows.append((text("X-Page-Key"), fields["WARC-Target-URI"], size, digest, kind, text("X-Refers-To-Key"), payload)[: len(names)])
                        held += len(payload)
                        if len(rows) >= 1024 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # one row a file, so that a task has about one
    return manifest.select("path").repartition(max(partitions(spark), manifest.count()), "path").mapInArrow(work, schema)


def round_trip(pages: DataFrame, folder: str, key: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` below ``folder`` and read the archives back, key and refers_to in the key's type."""
    kind: T.DataType = pages.schema[key].dataType
    back = read_warc(pages.sparkSession, write_warc(pages, folder, key, **options))
    return back.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
