"""Operator 10, WARC derivatives: metadata and plain-text conversion records of responses."""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import Cutter
from ..shipping import ship

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_UNSHOWN = frozenset(("script", "style", "noscript", "template"))
_BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_BLANKS = re.compile(r"[^\S\n]+")
#: Names of codecs that are no charsets of pages.
_NO_CHARSETS = frozenset(("idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "mbcs", "oem"))
#: Bytes that one body may have when its coding is undone.
MAX_BODY = 1 << 30


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record: version, WARC-Type, the headers, the block's digest and length, the block."""
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block) of one WARC record; ValueError if it is none or is cut short."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in lines[1:]) if colon]
    size = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not size.isdigit() or len(rest) < int(size):
        raise ValueError("cut short")
    return headers, rest[: int(size)]


def _first(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name), None)


def _joined(body: bytes) -> bytes:
    """The chunks of a chunked body; what follows the last is left out."""
    parts, at = [], 0
    while at < len(body):
        line = body.find(b"\r\n", at)
        size = body[at : line if line >= 0 else len(body)].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise ValueError("chunk of no size")
        n, at = int(size, 16), line + 2 if line >= 0 else len(body)
        if not n:
            break
        parts.append(body[at : at + n])
        at += n + 2
    return b"".join(parts)


def _inflated(body: bytes, coding: str) -> bytes:
    """gzip or deflate undone, the latter with or without its header."""
    for form in (47, -15) if coding == "deflate" else (47,):
        one = zlib.decompressobj(form)
        try:
            out = one.decompress(body, MAX_BODY)
        except zlib.error as e:
            why = e
            continue
        if one.unconsumed_tail:
            raise ValueError(f"{coding}: over {MAX_BODY} bytes")
        if not one.eof:
            raise ValueError(f"{coding}: cut short")
        return out
    raise ValueError(f"{coding}: {why}")


def http_body(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """(status, headers, body) of an HTTP response, chunks joined and gzip or deflate undone; ValueError if it is none or has another coding."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    first = lines[0].split(" ", 2)
    if not gap or not first[0].startswith("HTTP/") or len(first) < 2 or not re.fullmatch("[0-9]{1,9}", first[1]):
        raise ValueError("no HTTP response")
    headers = [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in lines[1:]) if colon]
    if (_first(headers, "transfer-encoding") or "").lower() == "chunked":
        body = _joined(body)
    coding = (_first(headers, "content-encoding") or "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        body = _inflated(body, coding)
    elif coding not in ("", "identity"):
        raise ValueError(f"content coding {coding[:40]} is not read")
    return int(first[1]), headers, body


def decoded(body: bytes, content_type: str) -> str:
    """The text of a body by the charset that its type names; UTF-8 if it names none, one that is unknown or one that is none of texts."""
    charset = re.search(r"charset=[\"']?([\w.-]+)", content_type)
    try:
        codec = codecs.lookup(charset[1] if charset else "utf-8")
        if codec.name.replace("-", "_") not in _NO_CHARSETS:
            return body.decode(codec.name, "replace")
    except (LookupError, ValueError):
        pass
    return body.decode("utf-8", "replace")


def read_page(page: str) -> tuple[str, str | None, list[str]]:
    """(text, title, links) of a page, in one pass over its tags.

    The text has no scripts, styles, comments or tags; entities are resolved and
    each block has a line of its own. Links are the distinct href values of
    anchors, in order. A comment, script or style that is not closed goes on to
    the end; a tag that is not closed is text. The title is that of the first title
    element that is closed.
    """
    parts, links, title, named, hidden, depth = [], [], None, None, "", 0
    for kind, first, *rest in Cutter(page).tokens():
        if hidden:  # until the element that is not shown ends
            if first == hidden and kind != "text":
                depth += 1 if kind == "start" else -1
                hidden = hidden if depth else ""
        elif kind == "text":
            parts.append(first)
        elif kind == "start" and first in _UNSHOWN:
            if not rest[1]:
                hidden, depth = first, 1
        else:
            if first in _BLOCKS:
                parts.append("\n")
            if first == "a" and kind == "start" and "href" in rest[0]:
                links.append(rest[0]["href"])
            elif first == "title" and title is None:
                if kind == "start":
                    named = len(parts)
                elif named is not None:
                    title = " ".join("".join(parts[named:]).split())
    parts = (_BLANKS.sub(" ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in parts if x), title, list(dict.fromkeys(links))


def plain_text(page: str) -> str:
    """A page's text."""
    return read_page(page)[0]


def response(url: str | None, page: str | None, key: object, date: str = DATE) -> bytes:
    """A response record for a fetched page; its id follows from the key, the URL and the page."""
    body = (page or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    ident = f"<urn:uuid:{uuid.uuid5(_NAMES, f'response {key} {url} {digest(body)}')}>"
    headers = [("WARC-Record-ID", ident), *([("WARC-Target-URI", re.sub(r"\s", "%20", url))] if url else []), ("WARC-Date", date), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response")]
    return record("response", headers, http + body)


def derived(raw: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response record.

    Both name the response in WARC-Refers-To and keep its target URI and date;
    the metadata record holds the response's HTTP headers, digests, title and
    outlinks. A response that is no text gets the metadata alone. Anything that
    cannot be read gives one entry of kind invalid with the reason.
    """
    try:
        if raw is None:
            raise ValueError("no record")
        headers, block = parsed(raw)
        if (_first(headers, "warc-type") or "").lower() != "response":
            raise ValueError("no response")
        status, http, body = http_body(block)
        ident = _first(headers, "warc-record-id")
        if not ident:
            raise ValueError("no record id")
    except ValueError as e:
        return [{"kind": "invalid", "error": str(e)}]
    target, date = _first(headers, "warc-target-uri"), _first(headers, "warc-date") or DATE
    kind = (_first(http, "content-type") or "").lower()
    page = decoded(body, kind)
    is_html, is_text = "html" in kind, kind.startswith("text/") or "html" in kind
    linked = [("WARC-Refers-To", ident), *([("WARC-Target-URI", target), ("WARC-Refers-To-Target-URI", target)] if target else []), ("WARC-Refers-To-Date", date), ("WARC-Date", date)]
    own = {k: f"<urn:uuid:{uuid.uuid5(_NAMES, f'{k} {ident}')}>" for k in ("metadata", "conversion")}
    shown, title, links = read_page(page) if is_html else (page, None, [])
    fields = [
        ("source-status", str(status)), *((f"source-{k.lower()}", v) for k, v in http), ("source-block-digest", _first(headers, "warc-block-digest") or digest(block)),
        ("source-payload-digest", _first(headers, "warc-payload-digest") or digest(body)), *([("title", title)] if title is not None else []), *(("outlink", " ".join(x.split())) for x in links),
    ]
    block = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    out = [{"kind": "metadata", "record_id": own["metadata"], "refers_to": ident, "target_uri": target, "block": block, "n_links": len(links), "record": record("metadata", [("WARC-Record-ID", own["metadata"]), *linked, ("Content-Type", "application/warc-fields")], block)}]
    if is_text:
        text = shown.encode("utf-8", "replace")
        source = [("WARC-Source-Payload-Digest", _first(headers, "warc-payload-digest") or digest(body)), ("Content-Type", "text/plain; charset=utf-8")]
        out.append({"kind": "conversion", "record_id": own["conversion"], "refers_to": ident, "target_uri": target, "block": text, "record": record("conversion", [("WARC-Record-ID", own["conversion"]), *linked, *source], text)})
    return out


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """(key, record binary): a response record of every row.

    A null page is empty, a null URL leaves its header out. Rows that are equal
    in all three are one capture and give the same record, id included; null keys
    are kept; an empty table gives an empty result; other columns are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page"))
    kind = rows.schema["key"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = [response(u, p, k, date) for k, u, p in zip(*(part.column(c).to_pylist() for c in range(3)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["key", "record"])

    return rows.mapInArrow(build, f"key {kind}, record binary").withColumnRenamed("key", key)


def derivatives(records: DataFrame, key: str = "page_id", column: str = "record") -> DataFrame:
    """(key, kind, record_id, refers_to, target_uri, block_digest, n_bytes, n_links, record binary, error): two rows a text response.

    Each record is read by itself, so that no group forms. Null, cut or foreign
    records, and bodies in a coding that is not read, give one row of kind
    invalid. Repeated rows and null keys are kept, with the same ids; very long
    pages take time in proportion; an empty table gives an empty result; other columns are not read.
    """
    ship(records.sparkSession)
    rows = records.select(F.col(key).alias("key"), F.col(column).alias("record"))
    kind = rows.schema["key"].dataType.simpleString()
    types = {"kind": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "block_digest": pa.string(), "n_bytes": pa.int64(), "n_links": pa.int64(), "record": pa.binary(), "error": pa.string()}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [(k, d) for k, raw in enumerate(part.column(1).to_pylist()) for d in derived(raw)]
                for _, d in found:
                    if (block := d.get("block")) is not None:
                        d["block_digest"], d["n_bytes"] = digest(block), len(block)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([k for k, _ in found], pa.int64())), *(pa.array([d.get(n) for _, d in found], t) for n, t in types.items())], names=["key", *types])

    return rows.mapInArrow(build, f"key {kind}, kind string, record_id string, refers_to string, target_uri string, block_digest string, n_bytes bigint, n_links bigint, record binary, error string").withColumnRenamed("key", key)
