"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A response record is a row (record_id, uri, date, http, body): its WARC-Record-ID, target URI, date, the
HTTP head (status line and headers) and the decoded body. Each gives

  metadata    Content-Type application/warc-fields: payload digest and length, the HTTP status line and
              headers of the source as ``http-...`` fields, title, language and links of the page
  conversion  Content-Type text/plain: the visible text, one block per line

Both have ids of their own (SHA-1 based, the same on every run), WARC-Refers-To with the response's id,
its target URI and date, a block digest and the length in bytes. Files are plain WARC/1.0, written and
read by Spark's text source: records end with CRLF CRLF, which the writer puts behind every row.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bindloom.llm.common import append_columns

VERSION = "WARC/1.0"
BATCH = 1000  # records handed on at once
_LENGTH = re.compile(r"^content-length:\s*(\d+)", re.I | re.M)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_INLINE = re.compile(
    r"</?(?:a|abbr|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|ins|kbd|label|mark|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr)(?:\s[^>]*)?/?>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S | re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def visible(html: str) -> str:
    """The page without comments, scripts and other parts that are not shown."""
    return _HIDDEN.sub(" ", html)


def plain_text(shown: str) -> str:
    """Text of the visible part: a block per line, white space as one blank, character references decoded."""
    lines = _TAG.sub("\n", _INLINE.sub("", " ".join(shown.split()))).split("\n")
    lines = (" ".join((entities.unescape(x) if "&" in x else x).split()) for x in lines)
    return "\n".join(x for x in lines if x)


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _safe_uri(uri: str) -> str:
    """White space and control characters would break the header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", uri)


def record(kind: str, ident: str, refers_to: str, uri: str | None, date: str | None, content_type: str, block: str) -> str:
    """One record without the CRLF CRLF behind it."""
    raw = block.encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Refers-To", refers_to)]
    fields += [("WARC-Target-URI", _safe_uri(uri))] if uri else []
    fields += [("WARC-Date", date)] if date else []
    fields += [("WARC-Block-Digest", digest(raw)), ("Content-Type", content_type), ("Content-Length", str(len(raw)))]
    return VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + block


def metadata_block(http: str, body: str, shown: str) -> str:
    """warc-fields of a response: digest, source headers, title, language, links of the visible part in page order."""
    raw = body.encode()
    fields = [("payload-digest", digest(raw)), ("payload-length", str(len(raw)))]
    status, *headers = [x for x in re.split(r"\r?\n", http) if x.strip()] or [""]
    fields += [("http-status-line", status)] if status else []
    fields += [("http-" + k.strip().lower(), v) for k, _, v in (h.partition(":") for h in headers)]
    if m := _TITLE.search(body):
        fields.append(("title", entities.unescape(m.group(1))))
    if m := _LANG.search(body):
        fields.append(("language", m.group(1)))
    fields += [("link", entities.unescape(a or b or c)) for a, b, c in _LINK.findall(shown)]
    return "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields)


def derive(responses: DataFrame) -> DataFrame:
    """(record_id, metadata, conversion): the text of both records for every response (record_id, uri, date, http, body).

    A null or blank record id gets one from the other fields. A null body counts as empty and gives
    an empty conversion; a null URI or date leaves its header out; a null HTTP head leaves the source
    headers out. Bodies of any length are whole. Repeated rows give repeated records with the same
    ids. Extra columns are not read; an empty table gives no records.
    """

    def start():
        def step(cols):
            out = [[], [], []]
            for ident, uri, date, http, body in zip(*(col.to_pylist() for col in cols)):
                body, http = body or "", http or ""
                date = _one_line(date) if date else None
                ident = _one_line(ident or "") or record_id("response", uri or "", date or "", http, body)
                shown = visible(body)
                blocks = (("metadata", "application/warc-fields", metadata_block(http, body, shown)), ("conversion", "text/plain", plain_text(shown)))
                out[0].append(ident)
                for i, (kind, content, block) in enumerate(blocks):
                    out[i + 1].append(record(kind, record_id(kind, ident), ident, uri, date, content, block))
            return [pa.array(x, pa.string()) for x in out]

        return step

    return append_columns(responses, ["record_id", "uri", "date", "http", "body"], [], "record_id string, metadata string, conversion string", start)


def write_records(derived: DataFrame, path: str) -> None:
    """Both records of every response in a row, as gzip-compressed WARC files, one per task."""
    rows = derived.select(F.concat("metadata", F.lit("\r\n\r\n"), "conversion").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _pieces(rows) -> Iterator[tuple[dict, int, str, bytes]]:
    """(fields, stated length, block, its bytes) of the records in (file, piece) rows, which follow each other as in the file.

    A block that holds the version line arrives in pieces; they are joined until the stated length is reached."""
    held, at, missing = "", None, 0
    for file, piece in rows:
        if at == file and missing > 0:
            held += VERSION + "\r\n" + piece
            missing = missing - len(VERSION) - 2 - len(piece.encode()) if missing < inf else _missing(held)
        elif piece:
            if at is not None:
                yield _parsed(held)
            held, at = piece, file
            missing = _missing(held)
    if at is not None:
        yield _parsed(held)


def _missing(held: str) -> float:
    """Bytes of the block that are not there yet; all, if the head is not complete."""
    head, end, block = held.partition("\r\n\r\n")
    found = _LENGTH.search(head)
    return inf if not end else int(found.group(1)) - len(block.encode()) if found else 0


def _parsed(held: str) -> tuple[dict, int, str, bytes]:
    head, _, rest = held.partition("\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n"))}
    stated = fields.get("content-length", "0")
    length = int(stated) if stated.isdigit() else -1
    block = rest.removesuffix("\r\n\r\n")
    raw = block.encode()
    if len(raw) != length:  # other line ends than those of the writer
        raw = rest.encode()[: max(0, length)]
        block = raw.decode("utf-8", "replace")
    return fields, length, block, raw


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(type, record_id, refers_to, uri, date, content_type, block_digest, length, block, whole) of WARC files with text blocks.

    Records end where their Content-Length says, whatever lines the block holds; ``whole`` says whether
    the block has its stated length and digest. A compressed file is read by one task, record after record.
    """
    names = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest"]
    schema = "type string, record_id string, refers_to string, uri string, date string, content_type string, block_digest string, length long, block string, whole boolean"
    columns = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.bool_()]

    def run(batches):
        rows = ((f, v) for batch in batches for f, v in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))))
        out: list[list] = [[] for _ in columns]
        for fields, length, block, raw in _pieces(rows):
            for i, name in enumerate(names):
                out[i].append(fields.get(name))
            out[7].append(length)
            out[8].append(block)
            out[9].append(len(raw) == length and fields.get("warc-block-digest") in (None, digest(raw)))
            if len(out[0]) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=columns)
                out = [[] for _ in columns]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=columns)

    lines = spark.read.option("lineSep", VERSION + "\r\n").text(path)
    return lines.select(F.input_file_name(), "value").mapInArrow(run, schema)


def linked(records: DataFrame) -> DataFrame:
    """One row per response: ids and digests of its two records, read from files, and how often they occur."""
    c = F.col
    field = lambda name: F.regexp_extract("block", rf"(?m)^{name}: (.*?)\r?$", 1)
    is_meta, is_text = c("type") == "metadata", c("type") == "conversion"
    rows = records.select(
        "refers_to",
        "uri",
        "date",
        "whole",
        F.when(is_meta, c("record_id")).alias("metadata_id"),
        F.when(is_text, c("record_id")).alias("conversion_id"),
        F.when(is_meta, c("block_digest")).alias("metadata_digest"),
        F.when(is_text, c("block_digest")).alias("conversion_digest"),
        F.when(is_meta, field("payload-digest")).alias("payload_digest"),
        F.when(is_meta, field("payload-length").cast("long")).alias("payload_length"),
        F.when(is_meta, field("http-content-type")).alias("source_type"),
        F.when(is_meta, field("http-x-page-id").cast("long")).alias("page_id"),
        F.when(is_meta, field("title")).alias("title"),
        F.when(is_meta, F.size(F.regexp_extract_all("block", F.lit(r"(?m)^(link): "), 1))).cast("long").alias("n_links"),
        F.when(is_text, c("length")).alias("text_bytes"),
        F.when(is_text, F.length("block")).cast("long").alias("text_chars"),
    )
    held = [x for x in rows.columns if x not in ("refers_to", "whole")]
    return rows.groupBy("refers_to").agg(*[F.max(x).alias(x) for x in held], F.min("whole").alias("whole"), (F.count(F.lit(1)) / 2).cast("long").alias("copies"))


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response rows of a table (page_id, url, html); the page id is kept in a source header."""
    c = F.col
    page = F.coalesce(c("page_id").cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), page, F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"))
    return pages.select(F.lit(None).cast("string").alias("record_id"), c("url").alias("uri"), F.lit(date).alias("date"), head.alias("http"), c("html").alias("body"))
