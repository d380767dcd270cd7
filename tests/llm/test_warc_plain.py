"""op10 against a plain second version of its records: a standard HTML parser over every page, records written out by hand."""

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest
import zstandard
from pyspark.sql import functions as F

from helixar.llm import queries, warc

SF = "/root/testdata/sf0.001"
LINES = set("p div br hr li ul ol h1 h2 h3 h4 h5 h6 tr table td th article section nav header footer aside main pre blockquote form title body html".split())
HIDDEN = ("script", "style", "noscript", "template")


class Plain(HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.parts, self.links, self.titles, self.hidden, self.head, self.in_title = [], [], [], 0, False, False
        self.feed(page)
        self.close()
        self.text = "\n".join(x for x in (" ".join(y.split()) for y in "".join(self.parts).split("\n")) if x)
        self.title = " ".join(self.titles[0].split()) if self.titles else ""

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.head |= tag == "head"
        if tag == "body":
            self.head = False
        if tag == "title":
            self.in_title = True
            self.titles.append("")
        if tag in LINES:
            self.parts.append("\n")
        if tag == "a" and not self.hidden:
            self.links += [v for k, v in attrs if k == "href" and v is not None][:1]

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN
        self.in_title &= tag != "title"
        if tag in ("head", "body"):
            self.head = False
        if tag in LINES:
            self.parts.append("\n")

    def handle_decl(self, decl):
        self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.titles[-1] += data
        if not self.hidden and not self.head:
            self.parts.append(data)


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_records(page_id, url, html):
    body = (html or "").encode()
    key = hashlib.md5(f"{'' if page_id is None else page_id}\n{url or ''}".encode()).hexdigest()
    source = f"<urn:uuid:{key[:8]}-{key[8:12]}-{key[12:16]}-{key[16:20]}-{key[20:]}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    page, space = Plain(html or ""), uuid.uuid5(uuid.NAMESPACE_URL, "urn:helixar:warc")
    text = page.text.encode()
    about = [("source-block-digest", sha(block)), ("source-payload-digest", sha(body)), ("source-content-length", len(block)), ("http-status", "HTTP/1.1 200 OK"), ("http-header-content-type", "text/html; charset=utf-8"), ("http-header-content-length", len(body)), ("charset", "utf-8"), ("title", page.title), ("text-length", len(text)), ("text-digest", sha(text)), *(("outlink", x) for x in page.links)]
    meta = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in about).encode()
    for kind, mime, made in (("conversion", "text/plain; charset=utf-8", text), ("metadata", "application/warc-fields", meta)):
        yield page_id, kind, f"<urn:uuid:{uuid.uuid5(space, f'{source}\n{kind}')}>", source, " ".join((url or "").split()), "1970-01-01T00:00:00Z", mime, len(made), sha(made), sha(made)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_records_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = Counter(x for r in pages for x in plain_records(r.page_id, r.url, r.html))
    got = Counter(tuple(r) for r in queries.op10_warc_derivatives(spark, SF).collect())
    assert sum(want.values()) == 2 * len(pages) and got == want


def test_records_of_odd_pages(spark):
    odd = [(1, "http://a/ b", "<html><head><title> a &amp; b\n</title><style>p{}</style></head><body><p>x&lt;y <a HREF='/q?a=1&amp;b=2'>l</a><br>z<!-- no --><script>1<2</script></body></html>"), (2, None, None), (None, "u", "plain"), (3, "u", "<!DOCTYPE html><p>é&nbsp;ü</p><noscript>no</noscript><a href=bare>t</a>"), (3, "u", "<!DOCTYPE html><p>é&nbsp;ü</p><noscript>no</noscript><a href=bare>t</a>")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string").withColumns({"Kind": F.lit("x"), "RECORD_ID": F.lit("y")})
    made = warc.derive(warc.responses_of_pages(pages), carry=["page_id"])
    got = Counter((r.page_id, r.kind, r.record_id, r.refers_to, r.target_uri, r.date, r.content_type, r.content_length, r.block_digest, r.payload_digest) for r in made.collect())
    assert got == Counter(x for r in odd for x in plain_records(*r))


def test_columns_that_differ_in_case_give_way(spark):
    r = warc.responses_of_pages(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")).withColumn("Kind", F.lit("k"))
    assert warc.derive(r, carry=["page_id", "Kind"]).columns[:2] == ["page_id", "source_id"]


def raw_deflate(data):
    stream = zlib.compressobj(wbits=-15)
    return stream.compress(data) + stream.flush()


@pytest.mark.parametrize(("name", "pack"), [("gzip", gzip.compress), ("x-gzip", gzip.compress), ("deflate", zlib.compress), ("deflate", raw_deflate), ("zstd", lambda x: zstandard.ZstdCompressor().compress(x))])
def test_bodies_that_grow_without_bound_stay(name, pack):
    bomb = pack(b"\0" * (64 << 20))
    assert warc.decoded([("content-encoding", name)], bomb) == (bomb, [name])
    meta = warc.derive_one("<urn:x>", "http://h", "", b"HTTP/1.1 200 OK\r\nContent-Encoding: " + name.encode() + b"\r\n\r\n" + bomb)[1]["block"].decode()
    assert f"undecoded: {name}" in meta
    page = os.urandom(1 << 20) + b"x" * (15 << 20)
    assert warc.decoded([("content-encoding", name)], pack(page)) == (page, [])


def test_members_and_layers():
    two = gzip.compress(b"one ") + gzip.compress(b"two") + b"\0\0"
    assert warc.decoded([("content-encoding", "gzip")], two) == (b"one two", [])
    assert warc.decoded([("content-encoding", "deflate, gzip")], gzip.compress(zlib.compress(b"x"))) == (b"x", [])
    assert warc.decoded([("content-encoding", "gzip")], two[:10])[1] == ["gzip"]
    layers = gzip.compress(gzip.compress(b"\0" * (40 << 20)))
    assert warc.decoded([("content-encoding", "gzip, gzip")], layers)[1] == ["gzip"]  # the bound is that of what was received
