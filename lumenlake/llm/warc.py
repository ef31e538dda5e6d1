"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Both derivatives refer to their response by WARC-Refers-To and keep its target, its date, its HTTP headers and its block
and payload digests. Record ids are named by what they stand for, so a job that runs twice gives the same records.

Targets are written with control characters and blanks percent-encoded, so no url can add a header. `records` reads
responses from WARC files.

Defined cases: a null page is an empty body; a null url leaves the target out; a response that isn't HTTP is taken as a
payload without headers; unclosed scripts, styles and comments reach to the end of the page; rows that repeat are all
kept and have equal ids; extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOFTWARE = "lumenlake-derivatives/1"
#: Pages carry no time of capture; this stands in for it.
DATE = "2024-01-01T00:00:00Z"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)</title", re.I | re.S)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s<>\"']+))", re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>",
    re.I,
)
_TAG = re.compile(r"<[!/?A-Za-z][^<>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def plain_text(page: str) -> str:
    """The text that a page shows, one line for each block."""
    shown = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", entities.unescape(shown))).strip()


def target(url: Column) -> Column:
    """A url that fits on a header's line: control characters and blanks are percent-encoded."""
    for b in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(b)), F.lit(f"%{b:02X}"))
    return url


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record_id, target_uri, date, block): pages(page_id, url, html) as response records."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        "page_id",
        _named(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"),
        target(F.col("url")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.encode(head, "utf-8"), body).alias("block"),
    )


_RECORDS = "\r\n\r\nWARC/1.1\r\n"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, target_uri, date, block, whole) of the records in WARC/1.1 files at `path`.

    Files are cut at the line between two records, by Spark's reader of texts, which splits files that aren't compressed
    and streams those that are; no file is held whole. A block that holds that line itself is cut there: it is shorter
    than its header says, and `whole` is false. Lines that begin no record are left out."""
    raw = spark.read.option("lineSep", _RECORDS).text(path).select(F.col("value").cast("binary").alias("raw"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [_record(r) for r in batch.column("raw").slice(at, 256).to_pylist()]
                columns = zip(*(r for r in rows if r), strict=True)
                kinds = (*[pa.string()] * 4, pa.binary(), pa.bool_())
                made = [pa.array(c, k) for c, k in zip(columns, kinds)] or [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays(made, ["record_type", "record_id", "target_uri", "date", "block", "whole"])

    return raw.mapInArrow(parse, "record_type string, record_id string, target_uri string, date string, block binary, whole boolean")


def _record(raw: bytes) -> tuple | None:
    head, mark, block = raw.removeprefix(b"WARC/1.1\r\n").partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
    if not mark or "warc-type" not in fields:
        return None
    length = fields.get("content-length", "")
    n = int(length) if length.isdigit() else -1
    return fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), block[:n] if n >= 0 else block, 0 <= n <= len(block)


def _named(*parts: Column) -> Column:
    """A record id by SHA-1 of the parts, with the version and variant bits of a named uuid."""
    x = F.sha1(F.array_join(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), "\n").cast("binary"))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(x, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    piece = lambda a, n: F.substring(x, a, n)
    return F.concat(
        F.lit("<urn:uuid:"), piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-5"), piece(14, 3), F.lit("-"), variant, piece(18, 3), F.lit("-"), piece(21, 12), F.lit(">")
    )


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, m, v in (line.partition(":") for line in lines) if m], payload


def derived(response_id: str, target: str | None, date: str, block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = _http(block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = re.search(r"charset=\"?([\w.:-]+)", kind)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source = [("source-block-digest", digest(block)), ("source-payload-digest", digest(payload))]
    fields = [*source, ("http-status", status), *((f"http-header-{k}", " ".join(v.split())) for k, v in headers)]
    for name, found in (("title", _TITLE.search(page)), ("language", _LANG.search(page))):
        if found:
            fields.append((name, " ".join(entities.unescape(found[1]).split())))
    fields += [("outlink", " ".join(entities.unescape(a or b or c).split())) for a, b, c in _LINK.findall(_HIDDEN.sub(" ", page))]
    out = []
    for type_, mime, data in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
        ("conversion", "text/plain; charset=utf-8", plain_text(page)),
    ):
        raw = data.encode("utf-8", "replace")
        own = {
            "record_type": type_,
            "record_id": record_id(type_, response_id),
            "refers_to": response_id,
            "target_uri": target,
            "date": date,
            "content_type": mime,
            "content_length": len(raw),
            "block_digest": digest(raw),
            "source_block_digest": source[0][1],
            "source_payload_digest": source[1][1],
            "source_headers": "\r\n".join([status, *(f"{k}: {v}" for k, v in headers)]) if status else "",
            "block": raw.decode(),
        }
        out.append(own)
    return out


SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, "
    "block_digest string, source_block_digest string, source_payload_digest string, source_headers string, block string"
)


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for every row of records(key, record_id, target_uri, date, block)."""
    kind = records.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [derived(*r) for r in zip(*(part.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "block")), strict=True)]
                keys = pa.array([k for k in part.column(key).to_pylist() for _ in range(2)], part.column(key).type)
                rows = [x for pair in own for x in pair]
                columns = [pa.array([r[n] for r in rows], pa.int64() if n == "content_length" else pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([keys, *columns], [key, *names])

    return records.select(key, "record_id", "target_uri", "date", "block").mapInArrow(derive, f"{key} {kind}, {SCHEMA}")


def serialized(records: DataFrame) -> DataFrame:
    """`records` with `warc`, the whole record as bytes of WARC/1.1; joined, they are a WARC file."""
    lines = [
        ("WARC-Type", "record_type"),
        ("WARC-Record-ID", "record_id"),
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
        ("Content-Length", "content_length"),
    ]
    controls = "".join(map(chr, (*range(0x20), 0x7F)))
    value = lambda c: target(F.col(c)) if c == "target_uri" else F.translate(F.col(c).cast("string"), controls, "")
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(k + ": "), value(c)) for k, c in lines))
    return records.withColumn("warc", F.encode(F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")), "utf-8"))


def parsed(warc: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in bytes of a WARC file, by their content lengths."""
    out, at = [], 0
    while at < len(warc):
        end = warc.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in warc[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        out.append((head, warc[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return out
