from __future__ import annotations

import random

import pytest

from corvex.llm import warc
from tests.llm import brute
from tests.llm.data import got, wanted

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
PAGES = "page_id long, url string, html string"


def pages() -> list[tuple]:
    rng = random.Random(6)
    big, exact = "<p>é</p>" * 200, "x" * 1000
    html = [None, "", "short", "short", big, big, big, exact, exact, "y" * 999, "y" * 999, "\r\n\r\nHTTP/1.1\r\n" * 90, "z" * 300_000]
    html += ["".join(rng.choice("ab\n") for _ in range(1500)) for _ in range(40)]
    urls = ["http://www.Example.com/a?b=2&a=1", "https://example.com:8443/", None, "", "not a url", "http://[bad", "http://é.fr/ ü", "x\r\nInjected: 1", "http://a.b/same"]
    return [(i * 3, rng.choice(urls), h) for i, h in enumerate(html)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES + ", digest string, key string").repartition(parts)


def test_awkward_pages(spark):
    rows = pages()
    assert got(warc.round_trip(frame(spark, rows)), *COLUMNS) == wanted(brute.warc(rows))


def test_payloads_come_back(spark):
    rows = pages()
    found = dict(got(warc.read(warc.index(warc.write(frame(spark, rows)))).filter("record_type = 'response'"), "page_id", "payload"))
    of = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(v) == of[i] for i, v in found.items())
    assert set(found) == {w[0] for w in brute.warc(rows) if w[3] == "response"}


def test_null_ids_repeated_rows_and_empty_table(spark):
    big = "q" * 2000
    rows = [(5, "http://a", big), (5, "http://a", big), (None, "http://a", big), (None, None, None)]
    found = got(warc.round_trip(frame(spark, rows)), "page_id", "payload_bytes", "record_type", "refers_to")
    assert found == wanted([(5, 2000, "response", None), (5, 2000, "response", None), (None, 2000, "revisit", 5), (None, 0, "response", None)])
    assert got(warc.round_trip(frame(spark, [])), *COLUMNS) == []


def test_lookup_by_url(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 11}", f"page {i}") for i in range(300)]
    directory = warc.index(warc.write(frame(spark, rows)), block=5)
    index = warc.CaptureIndex.load(directory)
    assert len(index.directory) >= 60 and index.keys == sorted(index.keys)
    for url in ("http://h3.example.com/p4", "http://h0.example.com/p0", "HTTP://www.h3.example.com:80/p4"):
        want = {i for i, u, _ in rows if warc.url_key(u) == warc.url_key(url)}
        assert {e["page_id"] for e in index.entries(url)} == want
        assert {b.decode() for _, b in index.records(url)} == {f"page {i}" for i in want}
    assert index.entries("http://nowhere.example.com/") == []


@pytest.mark.parametrize(("url", "key"), [("http://www.Example.com/A?b=2&a=1", "com,example)/a?a=1&b=2"), ("https://x.org:8443", "org,x:8443)/"), (None, ")/"), ("www.com", "com,www)/")])
def test_keys(url, key):
    assert warc.url_key(url) == key
