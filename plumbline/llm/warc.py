"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A response record is one row: target URI, record id, date, the HTTP header block and the payload. From each come a
``metadata`` record (title, links, language, sizes) and a ``conversion`` record (the visible text). Both keep the
response's target URI, date and source headers, and name its record id in ``WARC-Refers-To``; payload and block digests
are SHA-1 in base 32. A record is serialised as one gzip member, so concatenated records form a WARC file.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOFTWARE = "plumbline warc derivatives"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<svg\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+(?<=/)>|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
# a head ends at its end tag, or at the first tag or text that cannot stand in one
_HEAD = re.compile(
    r"<head\b[^>]*(?:>|\Z)(?:\s|<title\b[^>]*>.*?(?:</title\s*>|\Z)|<(?:meta|link|base|basefont|bgsound)\b[^>]*(?:>|\Z)"
    r"|</(?!(?:head|body|html|br)\b)[a-z][^>]*>|<![^>]*>)*+(?:</head\s*>)?",
    re.S | re.I,
)
_BREAK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|table|tr|article|section|nav|header|footer|blockquote|pre|main|aside|form)\b[^>]*|br\b[^>]*|hr\b[^>]*)>", re.I)
_QUOTED = r"\"[^\"]*\"|'[^']*'"
# a tag ends at the first > outside its quoted values, or where a quote stays open at the first > of all
_TAG = re.compile(rf"</?[a-zA-Z](?:{_QUOTED}|[^\"'>])*+>|</?[a-zA-Z!?][^>]*(?:>|\Z)")
_ATTRIBUTE = r"[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
_LINK = re.compile(rf"<a(?:[\s/]+(?!href\s*=){_ATTRIBUTE})*+[\s/]+href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S | re.I)
_LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_SPACES = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")


def visible_text(page: str) -> str:
    """Text a reader sees: no markup, scripts or head; block elements end lines; character references resolved."""
    page = _HEAD.sub("", _HIDDEN.sub(" ", page))
    page = html.unescape(_TAG.sub("", _BREAK.sub("\n", page.replace("\n", " "))))
    return _LINES.sub("\n", _SPACES.sub(" ", page)).strip()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(*parts: str) -> str:
    """A name-based id: the same response always gets the same derivatives."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    body = b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each gzip member of a WARC file, in order."""
    while data:
        unpacker = zlib.decompressobj(31)
        body = unpacker.decompress(data) + unpacker.flush()
        data = unpacker.unused_data
        head, _, rest = body.partition(b"\r\n\r\n")
        headers = [tuple(line.split(": ", 1)) for line in head.decode("utf-8").split("\r\n")[1:]]
        yield headers, rest[: int(dict(headers)["Content-Length"])]


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of ``pages(page_id, url, html)`` that were kept without their headers.

    The header block is made up from what is known, type and length of the payload, with a status line of 200; the date is
    the given one. A null page has an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n"))
    name = F.sha2(F.concat_ws("\0", F.lit("response"), F.col("page_id").cast("string"), "url").cast("binary"), 256)
    uuid_text = F.regexp_replace(F.substring(name, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    return pages.select(
        "page_id", F.col("url").alias("target_uri"), uuid_text.alias("record_id"), F.lit(date).alias("date"), payload.alias("payload")
    ).withColumn("http_headers", head)


_OUT = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, source_headers string, "
    "content_type string, payload_digest string, block_digest string, content_length bigint, block binary, record binary"
)


def derive(responses: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows per response: its ``metadata`` and its ``conversion`` record, with the ``keep`` columns.

    ``responses(target_uri, record_id, date, http_headers, payload)``. ``refers_to`` is the response's record id,
    ``source_headers`` its HTTP header block, ``payload_digest`` the digest of the response's payload in metadata records
    and of the text in conversion records, ``block_digest`` that of the record's own block; ``record`` holds the serialised
    record. Null payloads count as empty, null URIs leave the header out. Repeated responses give repeated records; an
    empty table gives none. Payloads are read as UTF-8 with replacement.
    """

    def build(row: dict) -> Iterator[dict]:
        payload = row["payload"] or b""
        source, uri = row["http_headers"] or "", row["target_uri"]
        page = payload.decode("utf-8", "replace")
        title = _TITLE.search(page)
        language = _LANGUAGE.search(page)
        links = ["".join(found) for found in _LINK.findall(_HIDDEN.sub(" ", page))]
        text = visible_text(page).encode("utf-8")
        fields = [("sourceRecord", row["record_id"] or ""), ("sourcePayloadDigest", digest(payload)), ("sourceLength", str(len(payload)))]
        fields += [("sourceHeader", line) for line in source.split("\r\n") if line]
        fields += [("title", " ".join(html.unescape(title[1]).split()))] if title else []
        fields += [("language", language[1])] if language else []
        fields += [("outlink", " ".join(html.unescape(link).split())) for link in links]
        about = "".join(f"{name}: {value}\r\n" for name, value in fields).encode("utf-8")
        for kind, content_type, block, payload_digest in (
            ("metadata", "application/warc-fields", about, digest(payload)),
            ("conversion", "text/plain; charset=utf-8", text, digest(text)),
        ):
            own = record_id(kind, row["record_id"] or "", uri or "", payload_digest)
            headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", row["date"] or "")]
            headers += [("WARC-Target-URI", uri)] if uri is not None else []
            headers += [("WARC-Refers-To", row["record_id"])] if row["record_id"] is not None else []
            headers += [("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(block))]
            headers += [("X-Source-Header", line) for line in source.split("\r\n") if line]
            headers += [("WARC-Software", SOFTWARE), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
            yield {
                "record_type": kind,
                "record_id": own,
                "refers_to": row["record_id"],
                "target_uri": uri,
                "date": row["date"],
                "source_headers": row["http_headers"],
                "content_type": content_type,
                "payload_digest": payload_digest,
                "block_digest": digest(block),
                "content_length": len(block),
                "block": block,
                "record": serialise(headers, block),
            }

    names = [part.split()[0] for part in _OUT.split(", ")]
    types = dict(responses.dtypes)
    reads = ["target_uri", "record_id", "date", "http_headers", "payload"]
    kept = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [out for row in part.select(reads).to_pylist() for out in build(row)]
                twice = pa.array([i // 2 for i in range(2 * part.num_rows)], pa.int64())
                made = [pa.array([r[n] for r in rows], kinds[n]) for n in names]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(twice) for c in kept], *made], names=[*kept, *names])

    kinds = {n: pa.string() for n in names} | {"content_length": pa.int64(), "block": pa.binary(), "record": pa.binary()}
    fields = ", ".join([*[f"`{c}` {types[c]}" for c in kept], _OUT])
    return responses.select(*dict.fromkeys([*kept, *reads])).mapInArrow(run, fields)
