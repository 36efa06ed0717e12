"""URL filters: addresses, rule precedence, odd rows, agreement with SQL."""

import pytest

import oracle
from sparkaudit.llm import queries as Q
from sparkaudit.llm import url_filter as U

URLS = [
    ("HTTP://WWW.Example.ORG/es/x?y", "www.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12#z", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://a.b.com/de/", "a.b.com", "/de/", "com/de/", "block"),
    ("http://a.com/de", "a.com", "/de", None, "allow"),
    ("http://org", "org", "", None, "allow"),
    ("//no.scheme.org/", "", "", None, "allow"),
    ("x://h?u://org/", "h", "", None, "allow"),
    ("http://a.org:80/", "a.org:80", "/", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://É.org/" + "p" * 50_000, "É.org", "/" + "p" * 50_000, "org/", "allow"),
]


def rules_of(spark, rows=Q.URL_RULES):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


@pytest.mark.parametrize("bound", [U.BROADCAST_RULES, 0])
def test_judged(spark, monkeypatch, bound):
    monkeypatch.setattr(U, "BROADCAST_RULES", bound)
    rows = [(i, u, "kept", "old") for i, (u, *_) in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id int, url string, _Address string, Host string")
    got = U.judge_urls(pages, rules_of(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]] and r["_Address"] == "kept"


def test_precedence_and_odd_rules(spark):
    rules = [("b.c", "/", "allow"), ("c", "/ab", "block"), ("c", "/x", "allow"), ("c", "/x", "block"), (None, "/", "block"), ("", "/", "block"), ("d", None, "block"), ("E", "", "block")]
    urls = ["s://a.b.c/abq", "s://c/xy", "s://z/", "s://d/", "s://e", "s://f.e/q"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in U.judge_urls(pages, rules_of(spark, rules)).collect()}
    assert [got[u] for u in urls] == [
        ("b.c/", "allow"), ("c/x", "block"), (None, "allow"), (None, "allow"), ("e", "block"), ("e", "block")
    ]


def test_empty_tables(spark):
    pages = spark.createDataFrame([("http://a.org/",)], "url string")
    assert U.judge_urls(pages, rules_of(spark, []), default="block").first()["verdict"] == "block"
    assert U.judge_urls(pages.limit(0), rules_of(spark)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    assert oracle.difference(spark, oracle.connect(d), Q.op1_url_filter, Q.URL_SQL, d) == ""
