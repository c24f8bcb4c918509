"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Each derived record refers to its response by ``WARC-Refers-To`` and keeps its target, date and payload
digest, the digest as ``WARC-Refers-To-Payload-Digest``, since ``WARC-Payload-Digest`` would speak of
the derived record's own payload. The metadata record also holds the response's own record and HTTP
headers. Record identifiers are a function of the response's identifier and the record type, so a task
that runs again writes the same records. A response's parts never leave its row; nothing is shuffled.

The payload is the body without its transfer coding (chunks). For the conversion its content coding
(gzip, deflate, zstd) is undone too; HTML is rendered, other text stands as it is, and what is no text
(images, PDF) or has a coding that cannot be undone (br) gets a metadata record only. Archives that
keep the headers but store bodies already decoded are read as they are.

Characters are those of the byte-order mark, else of the header's charset, else of a page's ``<meta>``, else
UTF-8. ``WARC-Refers-To-Payload-Digest`` is no field of the standard, which has none for this. A coded body that
would grow beyond ``MOST_BYTES`` has no conversion record, as one record could else fill a task's memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_layout import visible_text

VERSION = "WARC/1.1"
RESULT = (
    "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, "
    "payload_digest string, block_digest string, block binary, record binary"
)
#: The most that a coding may make of a body or record.
MOST_BYTES = 1 << 28
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_META = re.compile(rb"<meta[^>]{0,500}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_BLANK_LINE = re.compile(rb"\r?\n\r?\n")
_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")
_LENGTH = re.compile("[0-9]{1,15}")
_HTML = frozenset(["text/html", "application/xhtml+xml", "application/vnd.wap.xhtml+xml"])
_TEXT = re.compile(r"text/.+|application/(?:.+\+)?(?:json|xml)|application/(?:x-)?(?:javascript|ecmascript|ndjson|yaml)")


class TooLarge(Exception):
    """A coding makes more of a body than MOST_BYTES."""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def to_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, headers, length, block."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def split_headers(data: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, headers in order, and what follows them. Lines may end in bare line feeds."""
    blank = _BLANK_LINE.search(data)
    head, rest = (data[: blank.start()], data[blank.end() :]) if blank else (data, b"")
    first, *lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif colon:
            headers.append((name.strip(), value.strip()))
    return first, headers, rest


def value_of(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def read_record(record: bytes) -> tuple[list[tuple[str, str]], bytes] | None:
    """Headers and block of a record, plain or gzipped; None if it is no WARC record."""
    if record[:2] == b"\x1f\x8b":
        record, whole = _inflate(record, 31)
        if not whole:
            return None
    first, headers, rest = split_headers(record)
    if not first.startswith("WARC/"):
        return None
    length = value_of(headers, "Content-Length")
    return headers, rest[: int(length)] if length and _LENGTH.fullmatch(length) else rest


def without_chunks(body: bytes) -> bytes:
    """A chunked body's data; of a cut one what there is, and a body that is not chunked as it stands."""
    parts, at = [], 0
    while head := _CHUNK.match(body, at):
        size = int(head[1], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[head.end() : head.end() + size])
        at = head.end() + size
        at += 2 * (body[at : at + 2] == b"\r\n")
    return b"".join(parts) if parts and at >= len(body) else body


def _inflate(body: bytes, bits: int) -> tuple[bytes, bool]:
    """A zlib or raw stream or all gzip members, and whether it came to its end; of a cut or broken one what comes before."""
    out, at, size = [], 0, 0
    while True:
        stream = zlib.decompressobj(bits)
        try:
            # Small pieces, so that what comes before an error is kept.
            while at < len(body) and not stream.eof:
                out.append(stream.decompress(body[at : at + 1024]))
                at, size = at + 1024, size + len(out[-1])
                if size > MOST_BYTES:
                    raise TooLarge
        except zlib.error:
            return b"".join(out), False
        at = min(at, len(body)) - len(stream.unused_data)
        if not stream.eof or bits != 31 or body[at : at + 2] != b"\x1f\x8b":
            return b"".join(out), stream.eof


def _gunzipped(body: bytes) -> bytes:
    return _inflate(body, 31)[0] if body[:2] == b"\x1f\x8b" else body


def _undeflated(body: bytes) -> bytes:
    """A zlib stream, or the raw one that some servers send; UTF-8 that is no whole raw stream is a decoded body."""
    if len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0:
        return _inflate(body, 15)[0]
    data, whole = _inflate(body, -15)
    if not whole:
        try:
            body.decode()
            return body
        except UnicodeDecodeError:
            pass
    return data or body


def _unzstd(body: bytes) -> bytes:
    out = []
    if body[:4] != b"\x28\xb5\x2f\xfd":
        return body
    with zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True) as stream:
        try:
            while piece := stream.read(1 << 16):
                out.append(piece)
                if len(out) << 16 > MOST_BYTES:
                    raise TooLarge
        except zstandard.ZstdError:
            pass
    return b"".join(out)


_DECODERS: dict[str, Callable[[bytes], bytes]] = {
    "identity": bytes, "chunked": without_chunks, "gzip": _gunzipped, "x-gzip": _gunzipped, "deflate": _undeflated, "zstd": _unzstd,
}


def without_codings(headers: list[tuple[str, str]], name: str, body: bytes) -> bytes | None:
    """The body without the codings of the header, the last one first; None if one of them is unknown."""
    codings = [c.strip().lower() for k, v in headers if k.lower() == name for c in v.split(",") if c.strip()]
    for coding in reversed(codings):
        decoder = _DECODERS.get(coding)
        if not decoder:
            return None
        body = decoder(body)
    return body


def decoded(body: bytes, charset: str | None, html: bool) -> str:
    """The body's characters; what its character set does not know, and an unknown set's name, are replaced."""
    marked = next((name for mark, name in _MARKS if body.startswith(mark)), None)
    if not marked and not charset and html and (meta := _META.search(body, 0, 4096)):
        charset = meta[1].decode("ascii", "replace")
    try:
        return body.decode(marked or charset or "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):
        return body.decode("utf-8", "replace")


def converted(http: list[tuple[str, str]], payload: bytes) -> str | None:
    """The text of a payload; None if it is not text. Without a type, a body without null bytes is HTML."""
    content_type = value_of(http, "Content-Type") or ""
    kind = content_type.partition(";")[0].strip().lower()
    try:
        body = without_codings(http, "content-encoding", payload)
    except TooLarge:
        return None
    if body is None or not (kind in _HTML or _TEXT.fullmatch(kind) or (not kind and b"\0" not in body)):
        return None
    named, html = _CHARSET.search(content_type), kind in _HTML or not kind
    text = decoded(body, named[1] if named else None, html)
    return visible_text(text) if html else text


def derive(record: bytes) -> list[dict]:
    """The metadata and conversion records of one response record; none of other records."""
    try:
        parsed = read_record(record)
    except TooLarge:
        return []
    if not parsed or value_of(parsed[0], "WARC-Type") != "response":
        return []
    headers, block = parsed
    status, http, payload = split_headers(block) if block.startswith(b"HTTP/") else ("", [], block)
    own = value_of(headers, "WARC-Record-ID") or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest(record))}>"
    target, date = value_of(headers, "WARC-Target-URI"), value_of(headers, "WARC-Date")
    try:
        entity = without_codings(http, "transfer-encoding", payload)
    except TooLarge:
        entity = None
    payload = payload if entity is None else entity
    payload_digest = value_of(headers, "WARC-Payload-Digest") or digest(payload)
    text = None if entity is None else converted(http, payload)
    about = {"status": status, "headers": http, "record_headers": headers, "payload_length": len(payload), "payload_digest": payload_digest}
    blocks = {"metadata": ("application/json", json.dumps(about, ensure_ascii=False).encode())}
    if text is not None:
        blocks["conversion"] = ("text/plain; charset=utf-8", text.encode("utf-8", "replace"))
    out = []
    for kind, (content_type, data) in blocks.items():
        fields = {
            "warc_type": kind, "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {own}')}>", "refers_to": own,
            "target_uri": target, "warc_date": date, "payload_digest": payload_digest, "block_digest": digest(data), "content_type": content_type,
        }
        names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Refers-To-Payload-Digest", "WARC-Block-Digest", "Content-Type")
        record_headers = [(n, v or "") for n, v in zip(names, fields.values(), strict=True)]
        out.append(fields | {"block": data, "record": to_record(record_headers, data)})
    return out


def _clean(column: Column | str) -> Column:
    """A header value without line breaks."""
    return F.regexp_replace(column, r"[\r\n]+", " ")


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``record``: a response record per page, for tables that hold pages and no archive. Null texts are empty."""
    url, html = _clean(F.coalesce(F.col(url_col), F.lit(""))), F.coalesce(F.col(html_col), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html), F.lit("\r\n\r\n"), html)
    name = F.md5(F.concat_ws(" ", url, html))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), F.concat_ws("-", *parts), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http), F.lit("\r\n\r\n"),
    )
    return pages.select(F.encode(F.concat(head, http, F.lit("\r\n\r\n")), "UTF-8").alias("record"))


def derivatives(records: DataFrame, record_col: str = "record") -> DataFrame:
    """A metadata row for each response record of ``record_col``, plain or gzipped, and a conversion row if it has text.

    Null values, records of other types and what is no record give no rows; repeated records give
    repeated rows. A response without identifier gets one from its bytes, one without payload digest the
    digest of its payload. An unknown charset is read as UTF-8. Damaged or oversized gzip records are no records,
    damaged bodies give what comes before the damage. Other columns are not read.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split()[0] for f in RESULT.split(",")]
        for batch in batches:
            rows = [row for record in batch.column("record").to_pylist() if record for row in derive(record)]
            kinds = [pa.binary() if n in ("block", "record") else pa.string() for n in names]
            yield pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return records.select(F.col(record_col).cast("binary").alias("record")).mapInArrow(convert, RESULT)


def write_archive(derived: DataFrame, path: str) -> None:
    """Write the records as files of gzip members, a folder of one file per task, ``path/part-*``.

    Files hold a base64 line per member, as text sinks need; ``read_archive`` gives the records back.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [base64.b64encode(gzip.compress(r, mtime=0)).decode() for r in batch.column("record").to_pylist() if r]
            yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])

    derived.select("record").mapInArrow(members, "value string").write.text(path)


def read_archive(spark, path: str) -> DataFrame:
    """``record``: the gzip members that ``write_archive`` wrote."""
    return spark.read.text(path).select(F.unbase64("value").alias("record"))
