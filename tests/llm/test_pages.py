from __future__ import annotations

import gzip
import hashlib
import io

import compare
import pytest

from ledgertree.llm import url_filters, warc
from ledgertree.llm.page_queries import RULES
from ledgertree.llm.registry import CHECKS, QUERIES, ship
from ledgertree.session import new_path

PAGES = "page_id long, url string, html string"


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def test_rules_and_parsing(spark):
    ship(spark)
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?x=/de/#y", "http://net", "http://net/", "x://example.com/de/1",
            "http://b.example.com/de", "http://xexample.com/de/1", "a://b://c/d", "http://é.ORG/fr/2\n3", "http://h?q", "http://h#q", "://",
            "http://example.net/en/", "http://example.net/enx"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    rows = {r.page_id: r for r in url_filters.judged(pages, RULES).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        host, path = parts(url)
        assert (rows[i].host, rows[i].path) == (host, path)
        rule, verdict = rule_of(host, path)
        assert rows[i].rule == rule
        assert rows[i].verdict == (verdict or rows[i].verdict) and rows[i].verdict in ("allow", "block")
    assert url_filters.judged(pages.limit(0), RULES).collect() == []


def test_templates(spark):
    """Blocked and allowed branches stay apart, ids become wildcards, purity decides."""
    ship(spark)
    rules = [url_filters.Rule("h.x", "/shop/item/1", "block"), url_filters.Rule("h.x", "/news/2", "allow")]
    urls = [f"http://h.x/shop/item/{i}" for i in range(1, 60)] + [f"http://h.x/news/{i}" for i in range(1, 60)]
    urls += [f"http://h.x/blog/p{i}/deep/er/and/more/{i}" for i in range(20)] + ["http://other.x/shop/item/7"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    rows = {r.page_id: r for r in url_filters.judged(pages, rules).collect()}
    by = {}
    for i, url in enumerate(urls):
        by.setdefault((url.split("/")[2], url.split("/")[3]), set()).add((rows[i].template, rows[i].verdict))
    assert by["h.x", "shop"] == {("/shop/item/<n>", "block")}
    assert {v for _, v in by["h.x", "news"] | by["h.x", "blog"] | by["other.x", "shop"]} == {"allow"}
    assert len(by["h.x", "blog"]) == 1
    labelled = [u for u in urls if u.startswith("http://h.x/shop/item/1")]
    assert rows[0].purity == pytest.approx((len(labelled) + 0.4) / (len(labelled) + 2))


def test_round_trip(spark):
    ship(spark)
    long = "é" * 40_000 + "WARC/1.0\r\nContent-Length: 3\r\n\r\n\r\n\r\n0\r\n\r\n" + "x" * 30_000
    html = [None, "", "a", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "é" * 500, "é" * 500, long, long, "z" * 70_000, "\r\n\r\n" * 20_000]
    pages = [(i, None if i % 3 else f"http://h/{i} \r\n", h) for i, h in enumerate(html)]
    pages += [(6, "again", "y" * 1000), (None, "no id", "only here"), (None, None, "y" * 1000)]
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(3), path)
    found = warc.read_records(spark, path).collect()
    assert len(found) == len(pages) and {r.problem for r in found} == {None}
    kept = {r.page_id: r for r in found if r.page_id is not None and r.record_type == "response"}
    for i, h in enumerate(html):
        data = (h or "").encode()
        same = [k for k, x in enumerate(html) if (x or "").encode() == data]
        if len(data) >= 1000 and i != max(same):
            assert i not in kept and [r.refers_to for r in found if r.page_id == i] == [max(same)]
        else:
            assert bytes(kept[i].payload) == data
    digests = {r.page_id: r for r in warc.resolved(warc.read_records(spark, path)).collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert (digests[i].payload_bytes, digests[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())


def test_broken_segments():
    (first, *rest) = warc.records(1, 0, "u", b"q" * 100_000, None)
    parsed = [next(warc.parse(io.BytesIO((x + warc.END).encode()))) for x in (first, *rest)]
    rows = [
        ("o", f["warc-type"], None, f.get("warc-payload-digest"), None, int(f["warc-segment-number"]),
         int(f.get("warc-segment-total-length", -1)), b)
        for f, b in parsed
    ]
    assert warc.joined(rows)[5:] == (b"q" * 100_000, None)
    assert "missing" in warc.joined([rows[0], *rows[2:]])[6]
    assert warc.joined(rows[:-1])[5] is None
    broken = [*rows[:-1], (*rows[-1][:6], rows[-1][6] + 1, rows[-1][7])]
    assert "bytes, not" in warc.joined(broken)[6]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(io.BytesIO(first.encode()[:-5])))
    assert list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(b""))))) == []


def test_warc_against_sql(spark):
    con = compare.connect("/root/testdata/sf0.001")
    found = compare.differences(spark, con, "op8_warc", QUERIES["op8_warc"], CHECKS["op8_warc"], "/root/testdata/sf0.001")
    assert found == []
    empty = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], PAGES), empty)
    assert warc.read_records(spark, empty).collect() == []
