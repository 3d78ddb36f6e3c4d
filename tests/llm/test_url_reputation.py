import pytest

from dawnchorus.llm.queries import URL_RULES
from dawnchorus.llm.url_reputation import Reputation, domain_of, host_of, host_reputation, judge_urls, path_of, suffix_of
from pyspark.sql import functions as F

URLS = [
    (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    (2, "https://example.net", "example.net", "", None, None),
    (3, "https://example.net/", "example.net", "/", "net/", "block"),
    (4, "x://b.example.com/de/1", "b.example.com", "/de/1", "example.com/de/", "block"),
    (5, "x://notexample.com/de/1", "notexample.com", "/de/1", None, None),
    (6, "x://c.org/fr/", "c.org", "/fr/", "org/fr/", "allow"),
    (7, "x://c.org/fr", "c.org", "/fr", None, None),
    (8, "no scheme", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "", "", "", None, None),
    (11, "a://net#x", "net", "", None, None),
    (12, "a\n://net/\n?x", "net", "/\n", "net/", "block"),
    (12, "a\n://net/\n?x", "net", "/\n", "net/", "block"),
    (None, "http://e.com/a://b", "e.com", "/a://b", None, None),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(u[0], u[1], "h", "r") for u in URLS], "page_id long, url string, host string, rule string")
    outcomes = spark.createDataFrame([], "url string, bad boolean")
    got = judge_urls(pages, outcomes, URL_RULES).collect()
    key = lambda r: str(r[:4])
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == \
        sorted(((u[0], u[2], u[3], u[4]) for u in URLS), key=key)
    for r in got:
        want = next(u[5] for u in URLS if u[0] == r.page_id)
        assert r.verdict == (want or "allow")


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(pages, spark.createDataFrame([], "url string, bad boolean"), URL_RULES).collect() == []


def test_domain_and_suffix(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("com",), ("",)], "h string")
    got = df.select(domain_of(F.col("h")), suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", "")]


def test_shrinkage_and_block(spark):
    """A host with much bad evidence is blocked, one with a single bad page is not; unseen hosts lean on their domain."""
    rows = []
    for d in range(30):
        bad_domain = d < 5
        for h in range(4):
            for i in range(20):
                rows.append((f"h{h}.d{d}.com", i < (19 if bad_domain else 1)))
    rows += [("lone.d20.com", True), ("new.d1.com", None), ("new.d20.com", None)]
    got = {r.host: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["h0.d0.com"].verdict == "block" and got["h0.d20.com"].verdict == "allow"
    assert got["new.d1.com"].verdict == "block" and got["new.d20.com"].verdict == "allow"
    assert got["lone.d20.com"].verdict == "allow"
    assert 0.05 < got["lone.d20.com"].bad_rate < 0.9
    assert all(0 <= r.bad_rate <= 1 and r.bad_rate_low < r.bad_rate for r in got.values())


def test_equal_rates_shrink_fully(spark):
    rows = [(f"h{h}.d{h % 3}.com", i < 2) for h in range(12) for i in range(8)]
    got = host_reputation(spark.createDataFrame(rows, "host string, bad boolean"), Reputation()).collect()
    assert max(r.bad_rate for r in got) - min(r.bad_rate for r in got) < 0.01


def test_too_many_rules(spark):
    pages = spark.createDataFrame([(1, "a://b")], "page_id long, url string")
    with pytest.raises(ValueError):
        judge_urls(pages, spark.createDataFrame([], "url string, bad boolean"), [(f"h{i}/", "block") for i in range(1001)])


def test_host_and_path_columns(spark):
    df = spark.createDataFrame([("http://u@H:80/p;x?y#z",)], "url string")
    assert tuple(df.select(host_of(F.col("url")), path_of(F.col("url"))).first()) == ("u@h:80", "/p;x")
