"""WARC derivatives: every response record gets a metadata and a plain-text conversion record.

Records are rows (record_id, type, refers_to, target_uri, date, content_type, headers
array<struct<name, value>>, block binary, block_digest, payload_digest).  A derivative
names its source in WARC-Refers-To, and repeats the source's target URI, date and payload
digest, so each pair can be traced and checked without the source at hand.  Record ids
are UUIDs made from the page's id, url and text; rows equal in all three are numbered, so
each record has its own id, whatever the order or the number of the table's files.

A metadata block has ``application/warc-fields``: the source's HTTP status and headers, its
digests and length, title, language, description and links, resolved against the target
URI.  A conversion block is the page's visible text in UTF-8: scripts, styles and comments
go, block elements break lines, entities are decoded, white space is collapsed.

One pass makes the records, without a shuffle; a row's work is its own page's.  Before it,
hashes of the rows are counted to find those that repeat.

Edge cases: a null page is an empty payload; a null URL leaves the URI out; rows are kept
one for one, repeated ones and null ids included.  Work is linear in a page's length,
whatever is left unclosed in it.
Other columns are left out.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.shared import table, written

DATE = "2020-01-01T00:00:00Z"
_COPIES = 1024  # copies of a row that one task writes out at once
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_FIELDS = [
    ("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()),
    ("headers", _HEADERS), ("block", pa.binary()), ("block_digest", pa.string()), ("payload_digest", pa.string()),
]
RECORD = "record_id string, type string, refers_to string, target_uri string, date string, content_type string, headers array<struct<name: string, value: string>>, block binary, block_digest string, payload_digest string"

_OPENS = re.compile(r"<!--|<!\[CDATA\[|<(script|style|noscript|template)\b", re.I)
_CLOSES = re.compile(r"</(script|style|noscript|template)\s*>", re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|aside|title|head|body|html|blockquote|pre|hr|form|figure)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_TITLE_ENDS = re.compile(r"</title", re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LANGUAGE = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def shown(page: str) -> str:
    """A page without comments, CDATA and elements that aren't displayed; unclosed ones stay.  Every stretch is searched once."""
    closes: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSES.finditer(page):
        closes.setdefault(m[1].lower(), []).append(m.span())
    ends: dict[str, int] = {}  # where the next end of each kind is, as far as looked

    def after(mark: str, at: int) -> int:
        if mark not in ends or 0 <= ends[mark] < at:
            ends[mark] = page.find(mark, at)
        return ends[mark]

    out, at = [], 0
    for m in _OPENS.finditer(page):
        if m.start() < at:
            continue
        if m[1] is None:
            mark = "-->" if m[0] == "<!--" else "]]>"
            found = after(mark, m.end())
            end = found + 3 if found >= 0 else -1
        else:
            begins, own = after(">", m.end()), closes.get(m[1].lower(), [])
            k = bisect.bisect_left(own, (begins + 1, 0)) if begins >= 0 else len(own)
            end = own[k][1] if k < len(own) else -1
        if end >= 0:
            out += (page[at : m.start()], " ")
            at = end
    return "".join([*out, page[at:]])


def _without(tag: re.Pattern, page: str, instead: str) -> str:
    """Tags replaced; what follows the last > holds none."""
    last = page.rfind(">") + 1
    return tag.sub(instead, page[:last]) + page[last:]


def _title(visible: str) -> str | None:
    """The text between the first title tag and the next end of one."""
    last = max((m.start() for m in _TITLE_ENDS.finditer(visible)), default=-1)
    for m in _TAG.finditer(visible[: visible.rfind(">", 0, max(0, last)) + 1]):
        if re.match(r"<title\b", m[0], re.I):
            end = _TITLE_ENDS.search(visible, m.end())
            return visible[m.end() : end.start()] if end else None
    return None


def plain_text(page: str) -> str:
    """A page's visible text: one line for each block that has any."""
    return _lines(shown(page))


def _lines(visible: str) -> str:
    text = html.unescape(_without(_TAG, _without(_BREAK, visible, "\n"), ""))
    return "\n".join(line for raw in text.split("\n") if (line := " ".join(raw.split())))


def _clean(text: str) -> str:
    return " ".join(html.unescape(_without(_TAG, text, "")).split())


def response(url: str | None, page: str | None, key: str = "") -> dict:
    """A response record with its HTTP head and payload; ``key`` tells pages of one url and text apart."""
    payload = (page or "").encode("utf-8")
    head = [("Content-Type", "text/html; charset=UTF-8"), ("Content-Length", str(len(payload)))]
    block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head).encode() + b"\r\n" + payload
    found = digest(payload)
    return {"record_id": _id("response", url or "", found, key), "type": "response", "refers_to": None, "target_uri": url, "date": DATE, "content_type": "application/http; msgtype=response", "headers": [], "block": block, "block_digest": digest(block), "payload_digest": found}


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message; one without a head is all payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(n.strip(), v.strip()) for n, _, v in (line.partition(":") for line in lines[1:])], payload


def derived(record: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    status, headers, payload = split_http(record["block"] or b"")
    page, source = payload.decode("utf-8", "replace"), record["record_id"]
    fields = [("http-status", status), *((f"http-header-{n.lower()}", v) for n, v in headers), ("source-block-digest", record["block_digest"] or ""), ("source-payload-digest", record["payload_digest"] or ""), ("payload-length", str(len(payload)))]
    visible = shown(page)
    tags = [m[0] for m in _TAG.finditer(visible[: visible.rfind(">") + 1])]
    if (title := _title(visible)) is not None:
        fields.append(("title", _clean(title)))
    if language := next(filter(None, map(_LANGUAGE.match, tags)), None):
        fields.append(("language", language[1]))
    for link in dict.fromkeys(html.unescape("".join(x or "" for x in m.groups())).strip() for m in map(_LINK.match, tags) if m):
        try:
            fields.append(("outlink", " ".join(urljoin(record["target_uri"] or "", link).split())))
        except ValueError:  # no URL
            fields.append(("outlink-unresolved", " ".join(link.split())))
    blocks = {"metadata": ("application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in fields).encode("utf-8")), "conversion": ("text/plain; charset=UTF-8", _lines(visible).encode("utf-8"))}
    ids = {kind: _id(kind, source) for kind in blocks}
    out = []
    for kind, (content_type, block) in blocks.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        linked = [("WARC-Refers-To-Target-URI", record["target_uri"]), ("WARC-Refers-To-Date", record["date"]), ("WARC-Source-Payload-Digest", record["payload_digest"]), ("WARC-Concurrent-To", other)]
        out.append(
            {"record_id": ids[kind], "type": kind, "refers_to": source, "target_uri": record["target_uri"], "date": record["date"], "content_type": content_type, "headers": [{"name": n, "value": v} for n, v in linked if v], "block": block, "block_digest": digest(block), "payload_digest": digest(block)}
        )
    return out


def serialised(record: dict) -> bytes:
    """A record as it stands in a WARC/1.1 file."""
    block = bytes(record["block"] or b"")
    named = [("WARC-Type", record["type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Refers-To", record["refers_to"])]
    named += [(h["name"], h["value"]) for h in record["headers"]] + [("WARC-Block-Digest", record["block_digest"]), ("WARC-Payload-Digest", record["payload_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in named if v is not None).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def _rows(make, columns: list[str], first: str):
    """A function for ``mapInArrow``: each row's records, after its first column."""
    schema = lambda kind: pa.schema([(first, kind), *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                out = [{first: row[first]} | record for row in part.to_pylist() for record in make(*(row[c] for c in columns))]
                yield pa.RecordBatch.from_pylist(out, schema=schema(part.schema.field(0).type))

    return run


def numbered(pages: DataFrame) -> DataFrame:
    """Rows (id, url, html) with ``copy``: 0, and 1, 2, .. for further rows that equal one in all three, however the rows are dealt.

    Only hashes of the rows are shuffled to find those that repeat; these are counted and written out again in blocks of ``_COPIES``.
    """
    keyed = pages.withColumn("key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in pages.columns]))
    again = written(keyed.groupBy("key").count().where("count > 1").select("key"), "repeated")
    counted = keyed.join(again, "key", "left_semi").groupBy(*pages.columns).agg(F.count(F.lit(1)).alias("n"))
    first = F.col("block") * _COPIES
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _COPIES)))).repartition("id", "block")
    copies = blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + _COPIES, F.col("n")) - 1)))
    return keyed.join(again, "key", "left_anti").select(*pages.columns, F.lit(0).cast("long").alias("copy")).union(copies.select(*pages.columns, "copy"))


def responses(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, response record) of each page; record ids depend on the page's id, url and text alone, copies of a row are numbered."""
    kind = pages.schema[id_column].dataType.simpleString()
    rows = numbered(pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html")))
    named = [F.coalesce(F.col("id").cast("string"), F.lit("")), *[F.col(c).isNull().cast("string") for c in ("id", "url", "html")], F.col("copy").cast("string")]
    rows = rows.withColumn("key", F.concat_ws(" ", *named))
    made = rows.mapInArrow(_rows(lambda url, page, key: [response(url, page, key)], ["url", "html", "key"], "id"), f"id {kind}, {RECORD}")
    return made.withColumnRenamed("id", id_column)


def derivatives(records: DataFrame, id_column: str = "page_id") -> DataFrame:
    """(id, metadata or conversion record): two rows for each response record; other records have none."""
    kind = records.schema[id_column].dataType.simpleString()
    names = [n for n, _ in _FIELDS]
    rows = records.where("type = 'response'").select(F.col(id_column).alias("id"), *names)
    return rows.mapInArrow(_rows(lambda *values: derived(dict(zip(names, values))), names, "id"), f"id {kind}, {RECORD}").withColumnRenamed("id", id_column)


def files(records: DataFrame) -> DataFrame:
    """(warc binary): each record as bytes; concatenated they are a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([serialised(r) for r in batch.to_pylist()], pa.binary())], names=["warc"])

    return records.select(*[n for n, _ in _FIELDS]).mapInArrow(run, "warc binary")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivatives of all pages; blocks by length and digest."""
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    source = F.get(F.filter("headers", lambda h: h["name"] == "WARC-Source-Payload-Digest"), F.lit(0))["value"]
    return made.select("page_id", "type", "record_id", "refers_to", "target_uri", "date", "content_type", source.alias("source_digest"), F.length("block").cast("long").alias("length"), "block_digest", F.sha2("block", 256).alias("block_sha256"))
