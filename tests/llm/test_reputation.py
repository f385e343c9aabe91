"""Url rules and host reputation."""

from urllib.parse import urlsplit

from oracle import assert_same
from pyspark.sql import functions as F

from cairn.llm.oracle import SQL
from cairn.llm.queries import URL_RULES, op3_url_reputation
from cairn.llm.reputation import filter_urls, suffix_and_domain

SCHEMA = "page_id long, url string"


def judge(spark, urls, outcomes=None, **options):
    df = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    labels = None if outcomes is None else spark.createDataFrame(outcomes, "page_id long, bad int")
    return {r["page_id"]: r for r in filter_urls(df, labels, URL_RULES, **options).collect()}


def test_host_path_and_rules(spark):
    urls = ["http://WWW.Example.COM/en/x?q#f", "https://a.example.com/en/1", "https://example.com/EN/", "ftp://b.net/es/", "x://net/fr/1", "http://planet/fr/", None, "no scheme", "http://h?x/", "http://h#/en/", "a://b://c/d", "http://x.com", "://ÄB.com/ü"]
    got = judge(spark, urls)
    host = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"])
    assert host(0) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert host(1) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert host(2) == ("example.com", "/EN/", "com/", "allow")
    assert host(3) == ("b.net", "/es/", "net/es/", "block")
    assert host(4) == ("net", "/fr/1", "net/fr/", "block")
    assert host(5) == ("planet", "/fr/", None, "allow")
    assert host(6) == host(7) == ("", "", None, "allow")
    assert host(8) == ("h", "", None, "allow")
    assert host(9) == ("h", "", None, "allow")
    assert host(10) == ("b:", "//c/d", None, "allow")
    assert host(11) == ("x.com", "", None, "allow")
    assert host(12) == ("Äb.com", "/ü", "com/", "allow")
    assert urlsplit(urls[1]).netloc == host(1)[0]


def test_bad_hosts_are_blocked_and_share_their_domain(spark):
    urls = [f"http://bad.evil.org/{i}" for i in range(60)] + [f"http://good.fine.org/{i}" for i in range(60)] + ["http://other.evil.org/", "http://unseen.org/", "http://bad.evil.org/new"]
    outcomes = [(i, 1) for i in range(60)] + [(60 + i, int(i == 0)) for i in range(60)]
    got = judge(spark, urls, outcomes)
    assert {got[i]["verdict"] for i in range(60)} == {"block"}
    assert {got[60 + i]["verdict"] for i in range(60)} == {"allow"}
    assert got[122]["verdict"] == "block"
    assert got[121]["verdict"] == "allow"
    assert got[60]["bad_rate"] < got[121]["bad_rate"] < got[120]["bad_rate"] < got[0]["bad_rate"]
    assert all(r["bad_bound"] <= r["bad_rate"] for r in got.values())


def test_one_bad_page_is_not_a_bad_host(spark):
    got = judge(spark, [f"http://h{i}.org/" for i in range(50)], [(i, int(i == 7)) for i in range(50)])
    assert {r["verdict"] for r in got.values()} == {"allow"}


def test_edges(spark):
    rows = [(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/"), (2, None), (3, ""), (4, "http://" + "a" * 300_000 + ".org/" + "p" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"host": F.lit(1), "verdict": F.lit("old"), "n": F.lit(2), "suffix": F.lit(3), "m": F.lit(4)})
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, 1), (4, None)], "page_id long, bad int")
    got = filter_urls(df, outcomes, URL_RULES)
    assert got.count() == 6
    assert got.columns == ["page_id", "url", "n", "suffix", "m", "host", "path", "rule", "verdict", "bad_rate", "bad_bound"]
    assert filter_urls(df.limit(0), outcomes, URL_RULES).count() == 0
    assert filter_urls(df, outcomes.limit(0), []).filter("verdict != 'allow'").count() == 0


def test_suffixes(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.org",), ("",), ("single",)], "h string")
    got = df.select(*suffix_and_domain(F.col("h"), ("co.uk",))).collect()
    assert [tuple(r) for r in got] == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("org", "x.org"), ("", ""), ("single", "single")]


def test_equal_rules(spark):
    """Equal length: the longer host, then allow."""
    df = spark.createDataFrame([(1, "http://x.ab.org/cd/e")], SCHEMA)
    rule = lambda rules: tuple(filter_urls(df, None, rules).select("rule", "verdict").first())
    assert rule([("block", "ab.org", "/cd/"), ("allow", "x.ab.org", "/c")]) == ("x.ab.org/c", "allow")
    assert rule([("block", "ab.org", "/cd"), ("allow", "ab.org", "/cd")]) == ("ab.org/cd", "allow")


def test_a_planted_bad_host_is_blocked_by_the_query(spark, tmp_path):
    """Hundreds of ordinary hosts, and one with some dozens of pages, all of them toxic."""
    urls = [f"http://h{i % 300}.site{i % 40}.org/{i}" for i in range(3000)] + [f"http://bad.host.org/{3000 + i}" for i in range(48)]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i >= 3000 or i % 13 == 0)) for i in range(len(urls))], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op3_url_reputation(spark, str(tmp_path)).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(3000, 3048))
    assert_same(op3_url_reputation(spark, str(tmp_path)), str(tmp_path), SQL["op3_url_reputation"])
