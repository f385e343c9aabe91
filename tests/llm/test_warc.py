"""WARC archives: round trips, equal bytes for equal inputs, commits, damage."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairn.llm.warc import _members, parse_record, read_warc, round_trip, write_warc

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a.example/ü?q=1 2\r\nX: y", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "é€𝄞 \x00\r\n\r\n" * 3), (6, "x", "same"), (7, "x", "L" * 3_000_000)]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows):
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    return sorted(((i, len((h or "").encode()), sha(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"shard": F.lit("clash"), "digest": F.lit(1), "key": F.lit(2), "payload": F.lit(b"x"), "size": F.lit(None).cast("int")})
    assert rows_of(round_trip(df, str(tmp_path / "w"))) == brute(ROWS)


def test_payloads_and_urls_come_back(spark, tmp_path):
    back = read_warc(spark, write_warc(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "w")), with_payload=True)
    got = {r["key"]: r for r in back.collect()}
    assert bytes(got["5"]["payload"]).decode() == ROWS[4][2]
    assert len(got["7"]["payload"]) == 3_000_000
    assert bytes(got["2"]["payload"]) == b""  # a revisit stores none
    assert "\r" not in got["1"]["url"]


def test_small_payloads_are_never_revisits(spark, tmp_path):
    got = rows_of(round_trip(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "w"), min_revisit_bytes=5))
    assert {r[3] for r in got} == {"response"}


def test_null_and_repeated_keys(spark, tmp_path):
    rows = [(None, "u", "t"), (None, "u", "t"), (4, "u", "t"), (4, "u", "t"), (5, "u", "t"), (None, "u", "alone"), (4, "u", "other")]
    got = rows_of(round_trip(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w")))
    kinds = sorted((r[0], r[1], r[3], r[4]) for r in got if r[0] is not None)
    assert kinds == [(4, 1, "response", None), (4, 1, "response", None), (4, 5, "response", None), (5, 1, "revisit", 4)]
    assert sorted((r[1], r[3], r[4]) for r in got if r[0] is None) == [(1, "revisit", 4), (1, "revisit", 4), (5, "response", None)]


def test_empty(spark, tmp_path):
    df = round_trip(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert df.count() == 0
    assert df.schema["page_id"].dataType.simpleString() == "bigint"


def test_same_files_whatever_the_partitions(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 40} " * (i % 90)) for i in range(300)]
    seen = []
    for n, parts in enumerate((1, 7)):
        write_warc(spark.createDataFrame(rows, SCHEMA).repartition(parts), str(tmp_path / str(n)), roll_bytes=2000, min_shards=5)
        seen.append({p.name: p.read_bytes() for p in (tmp_path / str(n)).glob("*.warc.gz")})
    assert len(seen[0]) > 5
    assert seen[0] == seen[1]
    assert not list(tmp_path.glob("*/.*.open"))


def test_manifest_decides(spark, tmp_path):
    manifest = write_warc(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "w"))
    (tmp_path / "w" / "stray.warc.gz").write_bytes(b"left behind by a lost task")
    assert read_warc(spark, manifest).count() == len(ROWS)
    for r in manifest.collect():
        data = Path(r["path"].removeprefix("file:")).read_bytes()
        assert (len(data), hashlib.sha1(data).hexdigest()) == (r["bytes"], r["sha1"])
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_damage_is_found(spark, tmp_path):
    path = write_warc(spark.createDataFrame(ROWS[:1], SCHEMA), str(tmp_path / "w")).first()["path"].removeprefix("file:")
    data = Path(path).read_bytes()
    with open(path, "rb") as f:
        records = list(_members(f))
    fields, block = parse_record(records[1])
    assert fields["WARC-Type"] == "response"
    assert block.endswith(b"same")
    with pytest.raises(ValueError, match="damaged"):
        parse_record(records[1].replace(b"same", b"sane"))
    Path(path).write_bytes(data[:-20])
    with open(path, "rb") as f, pytest.raises(Exception, match="cut off|incomplete"):
        list(_members(f))
