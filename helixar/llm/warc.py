"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A response is (record_id, target_uri, date, block), block being the HTTP message. For each one comes
- a `conversion` record: text/plain of an HTML payload, with its own digests,
- a `metadata` record (application/warc-fields): the source's headers, digests, charset, title, links and size of text.
Both hold WARC-Refers-To with the response's id, its target URI and its date; their ids are name-based UUIDs of the
response's id and the kind, so a second run writes the same records. Digests are sha1 in base 32, as usual in WARC.
Chunked transfers and gzip, deflate and zstd contents are undone before text is taken; what cannot be undone is taken as it is,
and the metadata say so. HTML is read in one pass, linear in its length whatever it holds.
write_records() makes gzip members of whole records in the shared folder, one file a partition, after a warcinfo record;
read_records() streams such files, a record at a time, and its `response` rows can go to derive().

Cases: a null block is an empty one (its records are made); a null record_id is treated as an empty id; text of another charset
than the one named is decoded with replacement; repeated responses give repeated records, repeated headers are kept in source
order; an empty table gives none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixar.llm.tokenfiles import Files
from helixar.llm.wordtok import slices

RECORD = "source_id string, record_id string, kind string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, headers string, block binary"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:helixar:warc")
_SKIPPED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template")}
_BLOCKS = frozenset("p div br hr li ul ol h1 h2 h3 h4 h5 h6 tr table td th article section nav header footer aside main pre blockquote form title body html".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_TITLE_END = re.compile(r"</title\s*>", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(names))}>"


class Page(NamedTuple):
    text: str
    title: str
    links: list[str]


def read_page(page: str) -> Page:
    """Visible text (a line per block element, entities resolved, blank lines dropped), title and link targets of HTML."""
    out: list[str] = []
    links: list[str] = []
    title, in_head, at, closed, titled = "", False, 0, True, True
    while True:
        i = page.find("<", at)
        if not in_head:
            out.append(page[at:] if i < 0 else page[at:i])
        if i < 0:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            if end < 0:
                break
            at = end + 3
            continue
        name = _NAME.match(page, i + 1)
        end = page.find(">", i) if closed and (name or page[i + 1 : i + 2] in ("!", "?")) else -1
        if end < 0:  # no tag; without a > ahead, nothing after is one
            closed = closed and not (name or page[i + 1 : i + 2] in ("!", "?"))
            if not in_head:
                out.append("<")
            at = i + 1
            continue
        at, kind, opens = end + 1, name[1].lower() if name else "", page[i + 1] != "/"
        if kind in _BLOCKS or not name:
            out.append("\n")
        if opens and kind in _SKIPPED:
            stop = _SKIPPED[kind].search(page, at)
            if stop is None:
                break
            at = stop.end()
        elif opens and kind == "title" and titled:
            stop = _TITLE_END.search(page, at)
            titled = stop is not None
            if stop:
                title = title or " ".join(html.unescape(page[at : stop.start()]).split())
                at = stop.end() if in_head else at
        elif kind == "head":
            in_head = opens
        elif kind == "body":
            in_head = False
        elif opens and kind == "a":
            m = _HREF.search(page, name.end(), end)
            if m:
                links.append(html.unescape(next(x for x in m.groups() if x is not None)))
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return Page("\n".join(x for x in lines if x), title, links)


def _dechunk(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if len(data) < end + 2 + size:
            raise ValueError("a chunk is cut")
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


class TooLarge(ValueError):
    """A payload that grows beyond what is undone."""


def _inflate(data: bytes, most: int, kinds: tuple[int, ...]) -> bytes:
    """The zlib stream (gzip: all its members) in the first of the kinds of window that fits."""
    for kind in kinds:
        out, rest = [], data
        try:
            while rest:
                stream = zlib.decompressobj(kind)
                out.append(stream.decompress(rest, most + 1 - sum(map(len, out))))
                if sum(map(len, out)) > most:
                    raise TooLarge
                if not stream.eof:
                    raise EOFError
                rest = stream.unused_data.lstrip(b"\0") if kind == 31 else b""
            return b"".join(out)
        except zlib.error:
            if kind == kinds[-1]:
                raise
    return b""


def _unzstd(data: bytes, most: int) -> bytes:
    with zstandard.ZstdDecompressor().stream_reader(data) as stream:
        out = stream.read(most + 1)
    if len(out) > most:
        raise TooLarge
    return out


_UNDO = {"chunked": lambda x, _: _dechunk(x), "gzip": lambda x, n: _inflate(x, n, (31,)), "x-gzip": lambda x, n: _inflate(x, n, (31,)), "deflate": lambda x, n: _inflate(x, n, (15, -15)), "zstd": _unzstd, "identity": lambda x, _: bytes(x)}


def decoded(http: list[tuple[str, str]], payload: bytes, times: int = 64, least: int = 16 << 20) -> tuple[bytes, list[str]]:
    """The payload without its transfer and content codings (the last one named is undone first), and those left in it.

    A coding stays if the payload would be over `times` its length as received, and over `least` bytes.
    """
    named = [[c.strip().lower() for k, v in http if k == field for c in v.split(",") if c.strip()] for field in ("content-encoding", "transfer-encoding")]
    left, most = named[0] + named[1], max(least, times * len(payload))
    while left:
        try:
            payload = _UNDO[left[-1]](payload, most)
        except (KeyError, ValueError, EOFError, OSError, zlib.error, zstandard.ZstdError):
            break
        left.pop()
    return payload, left


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers (lower-case names, in source order, repeated ones too) and payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *lines = head.decode("latin-1").split("\r\n")
    return first, [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def _headers(fields: list[tuple[str, str]]) -> str:
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)


def derive_one(source: str, uri: str, date: str, block: bytes) -> list[dict]:
    """The two derivatives of one response."""
    uri, date = " ".join(uri.split()), " ".join(date.split())
    status, http, payload = split_http(block)
    kind = next((v for k, v in http if k == "content-type"), "text/html")
    charset = (re.search(r"charset=[\"']?([\w-]+)", kind, re.I) or [None, "utf-8"])[1]
    body, left = decoded(http, payload)
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    found = read_page(page) if "html" in kind.lower() and not left else Page("" if left else page, "", [])
    text = found.text.encode("utf-8", "replace")
    fields = [("source-block-digest", digest(block)), ("source-payload-digest", digest(payload)), ("source-content-length", str(len(block))), ("http-status", status), *((f"http-header-{k}", v) for k, v in http), ("charset", charset), *(("undecoded", x) for x in left), ("title", found.title), ("text-length", str(len(text))), ("text-digest", digest(text)), *(("outlink", x) for x in found.links)]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    out = []
    for what, mime, made in (("conversion", "text/plain; charset=utf-8", text), ("metadata", "application/warc-fields", meta)):
        own = record_id(source, what)
        head = [("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", mime), ("WARC-Block-Digest", digest(made)), ("WARC-Payload-Digest", digest(made)), ("Content-Length", str(len(made)))]
        out.append(dict(zip(_NAMES, (source, own, what, source, uri, date, mime, len(made), digest(made), digest(made), _headers(head), made), strict=True)))
    return out


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id") -> DataFrame:
    """Response records of raw pages: id, uri, date and the HTTP block (columns of SOURCE, and the page's id)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), url))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    return pages.select(F.col(id_col), urn.alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).cast("binary").alias("block"))


def derive(responses: DataFrame, carry: list[str] | None = None, with_blocks: bool = True) -> DataFrame:
    """RECORD's columns for both derivatives of every response, after `carry` columns; block is null unless with_blocks."""
    carry = [c for c in carry or [] if c.lower() not in _NAMES]
    rows = responses.select(*[F.col(f"`{c}`") for c in carry], F.coalesce(F.col("record_id"), F.lit("")).alias("record_id"), F.coalesce(F.col("target_uri"), F.lit("")).alias("target_uri"), F.coalesce(F.col("date"), F.lit("")).alias("date"), F.col("block"))
    schema = responses.select(*[F.col(f"`{c}`") for c in carry]).schema
    for x in RECORD.split(", "):
        schema = schema.add(*x.split())
    kinds = [pa.int64() if n == "content_length" else pa.binary() if n == "block" else pa.string() for n in _NAMES]

    def run(batches):
        for batch in batches:
            for part in slices(batch, len(carry) + 3, 8 << 20, 512):
                ids, uris, dates, blocks = (part.column(c) for c in ("record_id", "target_uri", "date", "block"))
                made = [r for a, u, d, b in zip(ids.to_pylist(), uris.to_pylist(), dates.to_pylist(), blocks, strict=True) for r in derive_one(a, u, d, b.as_py() or b"")]
                if not with_blocks:
                    for r in made:
                        r["block"] = None
                twice = pa.array([k // 2 for k in range(2 * part.num_rows)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(twice) for c in carry), *(pa.array([r[n] for r in made], k) for n, k in zip(_NAMES, kinds, strict=True))], [*carry, *_NAMES])

    return rows.mapInArrow(run, schema)


def write_records(records: DataFrame, root: str, date: str = "1970-01-01T00:00:00Z") -> list[tuple[str, int]]:
    """Write records (headers, block) as gzip members to `part-*.warc.gz` under root, after a warcinfo record of that date:
    file names and numbers of records."""
    Files(root).mkdir()

    def run(batches):
        from pyspark import TaskContext

        files, name, n, out, mark = Files(root), f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0, None, uuid.uuid4().hex

        def member(head: str, block: bytes) -> bytes:
            return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", mtime=0)

        for batch in batches:
            for head, block in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    out, info = files.writer(f"{name}.{mark}"), b"software: helixar\r\nformat: WARC File Format 1.0\r\n"
                    out.write(member(_headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "warcinfo")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(info)), ("Content-Length", str(len(info)))]), info))
                out.write(member(head.as_py(), block.as_py() or b""))
                n += 1
        if out:
            out.close()
            files.rename(f"{name}.{mark}", name)
            yield pa.RecordBatch.from_pydict({"name": [name], "n": [n]})

    return [tuple(r) for r in records.select("headers", "block").mapInArrow(run, "name string, n long").collect()]  # a row per partition


def parse_records(stream):
    """(header fields by lower-case name, block) of every record of a plain WARC byte stream, one at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError(f"record {fields.get('warc-record-id')} is cut")
        yield fields, block


READ = "kind string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, block binary"


def read_records(spark: SparkSession, root: str, names: list[str], most: int = 16 << 20) -> DataFrame:
    """READ's columns of the files' records, streamed in batches of about `most` bytes; a task per file, gzip or plain."""
    keys = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest"]
    cols = [x.split()[0] for x in READ.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], cols)

    def run(batches):
        files = Files(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.stream(name) as raw:
                    plain = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if name.endswith(".gz") else io.BufferedReader(raw)
                    for fields, block in parse_records(plain):
                        rows.append((*map(fields.get, keys), block))
                        held += len(block) + 512
                        if held > most:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names))).mapInArrow(run, READ)
