"""WARC derivatives: links between records, digests, text, and the bytes of a file."""

import base64
import hashlib
import re
import time
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

from tessel.llm import warc

PAGE = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p>One<br>two &lt;3&gt;</p><a href="/x?a=1&amp;b=2">link</a><div> a  <b>b</b>c</div></body></html>'


def fields(block):
    out = {}
    for line in bytes(block).decode().split("\r\n")[:-1]:
        name, _, value = line.partition(": ")
        out.setdefault(name, []).append(value)
    return out


def test_plain_text():
    assert warc.plain_text(PAGE) == "A & B\nOne\ntwo <3>\nlink\na bc"
    assert warc.plain_text("") == "" and warc.plain_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


class Reader(HTMLParser):
    """Visible text by the standard library's parser."""

    BREAKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav main aside title head body html blockquote pre hr form figure".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if tag in self.BREAKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template") and self.hidden > 0
        self.out.append("\n" if tag in self.BREAKS else " " if tag in ("script", "style", "noscript", "template") else "")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)

    @classmethod
    def read(cls, page):
        reader = cls()
        reader.feed(page)
        reader.close()
        return "\n".join(" ".join(line.split()) for line in "".join(reader.out).split("\n") if line.split())


def test_plain_text_is_that_of_a_parser(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page in [PAGE, *filter(None, pages)]:
        assert " ".join(warc.plain_text(page).split()) == " ".join(Reader.read(page).split())


def test_hidden_parts_by_a_plain_pattern():
    hidden = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!\[CDATA\[.*?\]\]>", re.S | re.I)
    rng = np.random.default_rng(3)
    pieces = ["<!--", "-->", "<script>", "<SCRIPT a", ">", "</script >", "<style>", "</style>", "<![CDATA[", "]]>", "text ", "<", "</script", "<template>", "</template>"]
    for _ in range(3000):
        page = "".join(rng.choice(pieces, rng.integers(1, 14)))
        assert warc.shown(page) == hidden.sub(" ", page), page


def test_hostile_pages_take_linear_time():
    for piece in ("<!--", "<script", "<script>", "<a<a", "<title>", "<html ", "<![CDATA[", "</script ", "<a href=", '<a href="'):
        for end in ("", ">", "-->", "</title>"):
            page = piece * 200_000 + end
            began = time.process_time()
            warc.derived(warc.response("http://a.example/", page))
            assert time.process_time() - began < 20, piece


def test_derivatives(spark):
    rows = [(1, "http://a.example/d/p.html", PAGE), (2, None, None), (3, "not a url [", "<a href='http://[x'>q</a>"), (None, "http://b.example/", "plain"), (1, "http://a.example/d/p.html", PAGE), (4, "http://c.example/", "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS type", "1 AS block", "2 AS id")
    sources = warc.responses(pages).collect()
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(sources) == len(rows) and len(made) == 2 * len(rows)
    by_id = {r["record_id"]: r for r in sources}
    assert len(by_id) == len(sources) and len({r["record_id"] for r in made}) == len(made)  # repeated pages too
    for r in made:
        source, named = by_id[r["refers_to"]], {h["name"]: h["value"] for h in r["headers"]}
        assert r["page_id"] == source["page_id"] and r["target_uri"] == source["target_uri"] and r["date"] == source["date"]
        assert named["WARC-Source-Payload-Digest"] == source["payload_digest"]
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r["block"])).digest()).decode()
        assert named["WARC-Concurrent-To"] in {x["record_id"] for x in made if x["refers_to"] == r["refers_to"] and x["type"] != r["type"]}
    one = {r["type"]: r for r in made if r["page_id"] == 1}
    told = fields(one["metadata"]["block"])
    assert told["title"] == ["A & B"] and told["language"] == ["fr"] and told["outlink"] == ["http://a.example/x?a=1&b=2"]
    assert told["http-status"] == ["HTTP/1.1 200 OK"] and told["http-header-content-type"] == ["text/html; charset=UTF-8"]
    assert bytes(one["conversion"]["block"]).decode() == warc.plain_text(PAGE)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_ids_stay_under_another_partitioning(spark, monkeypatch):
    monkeypatch.setattr(warc, "_COPIES", 4)
    rows = [(i, f"http://a.example/{i}", f"page {i % 3}") for i in range(20)] + [(7, "http://a.example/7", "page 1")] * 9 + [(None, None, None), (None, None, None), (None, "", None), (None, None, ""), (3, None, "page"), (3, "", "page")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, dealt = (sorted((str(r["page_id"]), str(r["target_uri"]), r["record_id"]) for r in warc.responses(p).collect()) for p in (pages.coalesce(1), pages.orderBy(F.desc("page_id")).repartition(7)))
    assert whole == dealt and len({x[2] for x in whole}) == len(rows)


def test_bytes(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", PAGE)], "page_id long, url string, html string")
    for (data,) in warc.files(warc.derivatives(warc.responses(pages))).collect():
        head, _, rest = bytes(data).partition(b"\r\n\r\n")
        named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and named["WARC-Refers-To"].startswith("<urn:uuid:")
        assert rest[int(named["Content-Length"]) :] == b"\r\n\r\n" and warc.digest(rest[:-4]) == named["WARC-Block-Digest"]


def test_query(spark):
    name = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{name}/pages.parquet").collect()}
    rows = warc.op2_warc_derivatives(spark, name).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        page = pages[r["page_id"]]["html"]
        assert r["source_digest"] == warc.digest(page.encode())
        if r["type"] == "conversion":
            assert r["block_sha256"] == hashlib.sha256(warc.plain_text(page).encode()).hexdigest()
