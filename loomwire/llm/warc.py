"""WARC derivatives: every response becomes a metadata and a plain-text conversion record that refer to it.

Records are rows (see SCHEMA). `responses` wraps fetched pages; `derive` turns response records, of
these or of files read by `read_warc`, into derivatives; `write_warc` writes rows as gzipped WARC files.
Record ids are name-based UUIDs, so that a repeated build gives the same records. Payload digests are
of the source's payload as its header states them, or computed where it doesn't; block digests are of the
derivative's own block.

Blocks are bytes: a body that isn't UTF-8 keeps its digest and is decoded by its charset.

A null URL gives a record without a target URI, a null page an empty payload. Repeated rows, which tie in all
they hold, give repeated records with the same ids; an empty table gives none. Very long or broken pages cost their
length. Records that aren't responses, and those whose block isn't HTTP, have no derivatives. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches

SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, headers string, block binary"
FIELDS = [f.strip().split()[0] for f in SCHEMA.split(",")]
#: The capture date of pages that carry none.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122

#: Elements whose whole content is left out, and those that begin a line.
_DROPPED = frozenset("script style noscript template svg head".split())
_BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer nav main aside blockquote pre figure hr form dl dt dd".split())
_NAME = re.compile(r"</?([a-z][a-z0-9]*)", re.I)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_DROPPED, "title")}
_TITLE = re.compile(r"<title\b", re.I)
_HTML = re.compile(r"<html\b", re.I)
_HREF = re.compile(r"\bhref\s*+=\s*+[\"']?([^\"'\s>]+)", re.I)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


def read_page(page: str) -> tuple[str, list[str]]:
    """Visible text, a line for each block element, and the targets of links.

    One pass from left to right: an end that isn't found is looked for once, so that any page costs its length.
    An unclosed comment or element is an ordinary tag, but all after an unclosed script or style is left out.
    """
    out: list[str] = []
    links: list[str] = []
    open_ended: set[str] = set()
    at = 0
    while (lt := page.find("<", at)) >= 0:
        out.append(page[at:lt])
        if page.startswith("<!--", lt) and "!" not in open_ended:
            if (end := page.find("-->", lt + 4)) >= 0:
                out.append(" ")
                at = end + 3
                continue
            open_ended.add("!")
        if (gt := page.find(">", lt)) < 0:
            at = lt
            break
        found = _NAME.match(page, lt)
        name = found[1].lower() if found else ""
        at = gt + 1
        if page[lt + 1] == "/":
            out.append("\n" if name in _BREAKS else "")
            continue
        if name in _DROPPED and name not in open_ended:
            if end := _END[name].search(page, at):
                out.append(" ")
                at = end.end()
                continue
            open_ended.add(name)
            if name in ("script", "style"):
                at = len(page)
        elif name in _BREAKS:
            out.append("\n")
        elif name == "a" and (href := _HREF.search(page, found.end(), gt)):
            links.append(html.unescape(href[1]))
    out.append(page[at:])
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape("".join(out)))).strip(), links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def title_and_language(page: str) -> tuple[str, str]:
    """Of the first title and the first html element; empty where there is none or it isn't closed."""
    title = language = ""
    if (m := _TITLE.search(page)) and (gt := page.find(">", m.end())) >= 0 and (end := _END["title"].search(page, gt)):
        title = html.unescape(page[gt + 1 : end.start()]).strip()
    if (m := _HTML.search(page)) and (gt := page.find(">", m.end())) >= 0 and (found := _LANG.search(page, m.end(), gt)):
        language = found[1]
    return title, language


def decoded(page: bytes, head: str) -> str:
    """The page by the charset of its HTTP header, UTF-8 where there is none or an unknown one."""
    named = _CHARSET.search(head)
    try:
        return page.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return page.decode("utf-8", "replace")


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _row(page_id, kind, rid, refers, uri, date, content_type, payload, block: bytes, extra: tuple = ()) -> list:
    own = digest(block)
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), *([("WARC-Target-URI", _clean(uri))] if uri is not None else []), *([("WARC-Refers-To", refers)] if refers else []), *extra]
    head += [("WARC-Payload-Digest", payload), ("WARC-Block-Digest", own), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return [page_id, kind, rid, refers, uri, date, content_type, payload, own, len(block), "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head), block]


def response(page_id, url, page) -> list:
    raw = (page or "").encode("utf-8", "surrogatepass")
    payload = digest(raw)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n"
    return _row(page_id, "response", record_id(str(page_id), url or "", payload), None, url, DATE, "application/http; msgtype=response", payload, head.encode() + raw)


def header(headers: str, name: str) -> str | None:
    m = re.search(rf"^{re.escape(name)}:[ \t]*(.*?)\r?$", headers, re.M | re.I)
    return m[1] if m else None


def derivatives(page_id, kind, rid, uri, date, payload, headers, block) -> Iterator[list]:
    if kind != "response" or not (block or b"").startswith(b"HTTP/"):
        return
    raw_head, _, raw = block.partition(b"\r\n\r\n")
    head = raw_head.decode("utf-8", "replace")
    page = decoded(raw, head)
    payload = payload or digest(raw)
    source = ([("WARC-Refers-To-Target-URI", _clean(uri))] if uri is not None else []) + [("WARC-Refers-To-Date", date)]
    (title, language), (text, links) = title_and_language(page), read_page(page)
    fields = [("source-record-id", rid), ("source-status", head.split("\r\n", 1)[0]), *((f"source-http-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:]))]
    fields += [("source-payload-digest", payload), *([("source-block-digest", d)] if (d := header(headers or "", "WARC-Block-Digest")) else []), ("title", _clean(title)), ("languages", language)]
    fields += [("outlink", _clean(x)) for x in links]
    conversion = record_id(rid, "conversion")
    told = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    yield _row(page_id, "metadata", record_id(rid, "metadata"), rid, uri, date, "application/warc-fields", payload, told, (*source, ("WARC-Concurrent-To", conversion)))
    yield _row(page_id, "conversion", conversion, rid, uri, date, "text/plain; charset=utf-8", payload, text.encode("utf-8", "surrogatepass"), tuple(source))


def _typed(df: DataFrame) -> tuple[str, pa.DataType]:
    """The schema of records whose page ids have df's own type, and that type in Arrow."""
    kind = df.schema["page_id"].dataType
    return SCHEMA.replace("page_id long", f"page_id {kind.simpleString()}"), to_arrow_type(kind)


def _batch(rows: list[list], page_id: pa.DataType = pa.int64()) -> pa.RecordBatch:  # noqa: B008
    kinds = {"page_id": page_id, "content_length": pa.int64(), "block": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(f, pa.string())) for f, c in zip(FIELDS, columns, strict=True)], FIELDS)


def responses(pages: DataFrame) -> DataFrame:
    """A response record of each page (page_id, url, html); ids of any type stay as they are."""
    small_batches(pages.sparkSession)
    schema, kind = _typed(pages)

    def wrap(batches):
        for b in batches:
            yield _batch([response(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)], kind)

    return pages.select("page_id", "url", "html").mapInArrow(wrap, schema)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records."""
    small_batches(records.sparkSession)
    schema, kind = _typed(records)

    def convert(batches):
        for b in batches:
            yield _batch([d for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for d in derivatives(*r)], kind)

    return records.select("page_id", "record_type", "record_id", "target_uri", "warc_date", "payload_digest", "headers", "block").mapInArrow(convert, schema)


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped files of whole records, through Spark's own committer."""
    records.select(F.concat("headers", F.lit("\r\n"), F.col("block").cast("string"))).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[list]:
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = data[at : end + 2].decode("utf-8", "replace")
        size = int(header(headers, "Content-Length") or 0)
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        get = lambda n, h=headers: header(h, n)
        yield [None, get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Date"), get("Content-Type"), get("WARC-Payload-Digest"), get("WARC-Block-Digest"), size, headers, block]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of plain or gzipped WARC files; each file is read by one task, so files should stay near 1 GB, as is usual."""

    def records(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                rows: list[list] = []
                for r in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append(r)
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, SCHEMA)
