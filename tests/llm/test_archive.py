"""Legacy archives: header lines, lengths, conversion, revisits and the round trip of whole payloads."""

import base64
import hashlib

import pytest

from sparkaudit.llm import archive as A
from sparkaudit.llm.queries import op3_warc

PAGES = "page_id long, url string, html string, key int"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
def test_parse_by_declared_lengths(version):
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nhello\n\nhttp://x 0.0.0.0 20240101000000 text/html 3\nabc", b"", "ö".encode() * 9]
    data = A.arc_head(version) + b"".join(A.arc_record(f"http://h/{i} x", b, version) for i, b in enumerate(blocks))
    got = list(A.parse_arc(data))
    assert [r["block"] for r in got] == blocks
    assert [r["url"] for r in got] == [f"http://h/{i}%20x" for i in range(3)]
    assert all(r["problem"] is None for r in got)


def test_parse_url_with_blank_and_faults():
    line = b"http://a b 1.2.3.4 20240101000000 text/html 3\nabc\n"
    cut = b"http://c 1.2.3.4 20240101000000 text/html 99\nabc"
    got = list(A.parse_arc(A.arc_head(1) + line + b"no header\n" + cut))
    assert [r["url"] for r in got] == ["http://a b", "http://c"]
    assert got[0]["problem"] is None and got[1]["problem"] == "cut short"
    assert list(A.parse_arc(b"")) == []


def test_round_trip_and_revisits(spark, scratch):
    long = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 300_000
    rows = [
        (5, "http://a/", "same", 1), (2, "http://b/", "same", 1), (9, None, "same", 1), (3, "http://c/ d\n", "", 1),
        (4, "http://d/", None, 1), (None, "http://e/", "same", 1), (7, "http://f/", long, 1), (8, "http://g/", "WARC/1.1\r\n\r\n", 1),
    ]
    A.converted(spark.createDataFrame(rows, PAGES), f"{scratch}/w", "page_id", "url", "html")
    got = {r["key"]: r for r in A.read_warc(spark, f"{scratch}/w").collect()}
    assert len(got) == len(rows)
    for key, _, html, _ in rows:
        assert got[key]["payload_digest"] == b32(html)
        assert got[key]["payload_bytes"] == len((html or "").encode())
    assert {k for k, r in got.items() if r["record_type"] == "response"} == {2, 3, 7, 8}
    assert {k for k, r in got.items() if r["refers_to"] == got[2]["record_id"]} == {5, 9, None}
    assert got[4]["refers_to"] == got[3]["record_id"]
    assert got[7]["payload"] == long and got[8]["payload"] == "WARC/1.1\r\n\r\n"
    assert got[9]["url"] is None and got[3]["url"] == "http://c/%20d%0A"


def test_keys_of_all_longs(spark, scratch):
    keys = [(1 << 63) - 1, -(1 << 63), 10**18, 10**18 + 1, -(10**18)]
    rows = [(k, "u", "same", 1) for k in keys]
    A.converted(spark.createDataFrame(rows, PAGES), f"{scratch}/w", "page_id", "url", "html")
    got = {r["key"]: r["record_type"] for r in A.read_warc(spark, f"{scratch}/w").collect()}
    assert got == {k: "response" if k == min(keys) else "revisit" for k in keys}
    assert A.long_of(str(1 << 63)) is None and A.long_of(str(-(1 << 63) - 1)) is None and A.long_of("x") is None


def test_smaller_payloads_are_responses(spark, scratch):
    rows = [(1, "u", "abc", 1), (2, "u", "abc", 1), (3, "u", "abcdef", 1), (4, "u", "abcdef", 1), (3, "u", "abcdef", 1)]
    A.converted(spark.createDataFrame(rows, PAGES), f"{scratch}/w", "page_id", "url", "html", least_bytes=4)
    got = sorted((r["key"], r["record_type"]) for r in A.read_warc(spark, f"{scratch}/w").collect())
    assert got == [(1, "response"), (2, "response"), (3, "response"), (3, "response"), (4, "revisit")]


def test_empty_table(spark, scratch):
    A.converted(spark.createDataFrame([], PAGES), f"{scratch}/w", "page_id", "url", "html")
    assert A.read_warc(spark, f"{scratch}/w").count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k] or "", k)
    got = {r["page_id"]: r for r in op3_warc(spark, d).collect()}
    assert set(got) == set(pages)
    for k, html in pages.items():
        kept = first[html or ""]
        want = (len((html or "").encode()), b32(html), "response" if kept == k else "revisit", None if kept == k else kept)
        assert tuple(got[k][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def test_query_keeps_one_row_per_repeated_page(spark, scratch):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (3, "w", "same"), (None, "x", "same"), (4, "y", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{scratch}/pages.parquet")
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in op3_warc(spark, scratch).collect()]
    want = [(1, "response", None)] * 2 + [(2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (4, "response", None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
