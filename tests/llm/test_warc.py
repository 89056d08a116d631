"""Records by hand, linked identifiers, and what a reader of the files finds."""

import gzip
import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

from tidalpanel.llm import warc

PAGE = """<html><head><title>A &amp; B</title><style>x{}</style></head><body><!-- <p>no</p> --><h1>Head&nbsp;1</h1>
<p>one <b>two</b>&#33;&#x41;&lt;p&gt;&amp;lt;</p><script>if (a < b) "<p>"</script><a href="/x">in</a> <a class=c href="y?z">rel</a><a href="#f">f</a><a href="//o.example/q">o</a>
<a href="mailto:a@b.example">m</a>1 < 2</body></html>"""


def _docs(spark):
    rows = [(1, "http://h.example/d/e?q#t", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "http://h.example", "no tags & <!-- open <p>x", "x"), (None, "u", "<p>" * 20_000 + "<" * 20_000, None), (4, "http://h.example/bad", "&#0;&#xD800;&#1114112;&#9999999;<script>never closed", "r")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record string")


def test_text_and_links(spark):
    out = {(r.page_id, r.kind): r for r in warc.derive(warc.responses(_docs(spark))).collect()}
    text = out[1, "conversion"].block
    assert text == "A & B\nHead 1\none two!A<p>&lt;\nin relfo\nm1 < 2"
    lines = out[1, "metadata"].block.split("\r\n")
    assert [x for x in lines if x.startswith("http-")] == ["http-status: HTTP/1.1 200 OK", "http-header: Content-Type: text/html; charset=utf-8", f"http-header: Content-Length: {len(PAGE)}"]
    assert [x.split(": ")[1] for x in lines if x.startswith("source-header: ")] == (
        "WARC-Type WARC-Record-ID WARC-Date WARC-Target-URI WARC-Payload-Digest WARC-Block-Digest Content-Type Content-Length".split()
    )
    assert [x for x in lines if not x.startswith(("http-", "source-"))] == ["via: http://h.example/d/e?q#t", "title: A & B"] + [
        f"outlink: {u} L a/@href" for u in ("http://h.example/x", "http://h.example/d/y?z", "http://h.example/d/e?q#f", "http://o.example/q", "mailto:a@b.example")
    ] + [""]
    assert out[2, "conversion"].block == "" and out[3, "conversion"].block == "no tags &"
    assert out[4, "conversion"].block == "�" * 4
    assert set(out[None, "conversion"].block) == {"<"}


def test_records_link_and_verify(spark, tmp_path):
    source = warc.responses(_docs(spark))
    kept = {r.headers["warc-record-id"]: r for r in warc.parse(source).collect()}
    made = warc.derive(source).collect()
    assert len(made) == 12
    for r in warc.parse(spark.createDataFrame(made).select("record")).collect():
        h = r.headers
        first = kept[h["warc-refers-to"]].headers
        assert h["warc-target-uri"] == first["warc-target-uri"] and h["warc-date"] == first["warc-date"]
        assert h["warc-refers-to-payload-digest"] == first["warc-payload-digest"]
        block = r.block.encode()
        assert int(h["content-length"]) == len(block) and h["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    warc.write(spark.createDataFrame(made), str(tmp_path / "out"))
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "out").glob("part-*")))
    at = n = 0
    while at < len(data):
        head = data[at : data.index(b"\r\n\r\n", at)].decode()
        at += len(head.encode()) + 4 + int(re.search(r"Content-Length: (\d+)", head)[1]) + 4
        n += 1
    assert n == 12 and at == len(data)


def test_whole_pages_against_the_library(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.block for r in warc.derive(warc.responses(pages)).filter("kind = 'conversion'").collect()}
    for p in pages.collect():
        bare = re.sub(r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", p.html)
        words = html.unescape(re.sub(r"<[^<>]*>", " ", bare)).split()
        assert "".join(words) == "".join(got[p.page_id].split())
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
    assert warc.query(spark, "/root/testdata/sf0.001").agg(F.countDistinct("refers_to")).first()[0] <= pages.count()


@pytest.mark.parametrize(
    "page, text",
    [
        ("x <scripture>keep me</scripture> tail", "x keep me tail"),
        ("<style-guide>a</style-guide><script-x>b</script-x>", "ab"),
        ("a<SCRIPT src=x>no</Script >b<style/>c</style>d", "abd"),
        ('<img alt="a > b">c 1 < 2 > 1 <p title=\'x\'>d</p><p id="open>e', "c 1 < 2 > 1\nd\ne"),
        ("&eacute;&uuml;&euro;&laquo;&#146;&NotEqualTilde;&amp;copy; &copy &nosuch;", "éü€«’≂̸&copy; © &nosuch;"),
        ("a&nbsp;&nbsp;b<br/>c<!-- <title>t</title> -->", "a b\nc"),
    ],
)
def test_text_of_odd_markup(page, text):
    assert warc.plain_text(warc._HIDDEN.sub("", page)) == text


@pytest.mark.parametrize(
    "link, to",
    # the examples of RFC 3986, section 5.4
    [
        ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"),
        ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("", "http://a/b/c/d;p?q"),
        (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"),
        ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"), ("..g", "http://a/b/c/..g"),
        ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("g#s/./x", "http://a/b/c/g#s/./x"),
    ],
)
def test_links_resolve(link, to):
    assert warc.Base("http://a/b/c/d;p?q").resolve(link) == to


def test_links_of_odd_markup():
    page = """<a name=x><a href='s/t'><a title="href=no" HREF=bare?a=1&amp;b=2><abbr href="no"><a href = " sp ace\n"><a href=""><a data-href="no">"""
    assert warc.links(page, "http://h.example") == ["http://h.example/s/t", "http://h.example/bare?a=1&b=2", "http://h.example/sp ace", "http://h.example"]
    assert warc.links('<base href="/q/"><a href="r">', "http://h.example/p") == ["http://h.example/q/r"]
    assert warc.links('<a href="y">', "http://h.example/d/e?p=2") == ["http://h.example/d/y"]
    assert warc.links('<a href="?p=2">', "http://h.example/d/e") == ["http://h.example/d/e?p=2"]
    assert warc.links('<a href="y">', "") == ["y"]


def test_foreign_records(spark):
    record = "WARC/1.1\r\nWARC-Type:response\r\nWARC-Record-ID: <a>\r\nWARC-Concurrent-To: <b>\r\nWARC-Concurrent-To: <c>\r\nWARC-Target-URI: http://h.example/\r\n\r\nHTTP/1.1 200 OK\r\nX: 1\r\n\r\n<title>t</title>\r\n\r\n"
    rows = [("k", record, 1), ("k", record.replace("response", "request"), 1), (None, None, 1), ("m", "no record", 1)]
    table = spark.createDataFrame(rows, "page_id string, record string, headers int")
    got = {r.kind: r for r in warc.derive(table).collect()}
    assert set(got) == {"metadata", "conversion"} and got["conversion"].page_id == "k" and got["conversion"].block == "t"
    assert got["metadata"].source_digest is None and got["metadata"].block.count("source-header: WARC-Concurrent-To: <") == 2 and "http-header: X: 1\r\n" in got["metadata"].block
    parsed = warc.parse(table.drop("headers")).filter("page_id = 'k'").first()
    assert parsed.headers["warc-concurrent-to"] == "<b>" and [f.value for f in parsed.fields if f.name == "WARC-Concurrent-To"] == ["<b>", "<c>"]
