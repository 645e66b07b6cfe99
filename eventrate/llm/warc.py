"""Derivatives of web archives: metadata and plain-text records linked to the responses they come from.

Records are rows: ``record_id``, ``type``, ``target_uri``, ``date``, ``headers`` (other header lines by name) and the
``block`` as bytes.  They are read from and written to archive files of one gzip member per record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrate.llm.files import file_system, new_file
from eventrate.llm.site_templates import ATTRIBUTE, INLINE, RAW, TOKEN

VERSION = "WARC/1.1"
SCHEMA = "record_id string, type string, target_uri string, date string, headers map<string,string>, block binary"
ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()),
])
OWN_LINES = ("WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Date", "Content-Length")
IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:derived-records")
ROWS, READ = 64, 1 << 20
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
META_CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]+)", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- archive files ---------------------------------------------------------------------


def record_bytes(record_id: str, kind: str, uri: str | None, date: str | None, headers, block: bytes) -> bytes:
    """A record as it stands in a file."""
    own = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Date": date}
    lines = [VERSION, *(f"{k}: {v}" for k, v in [*own.items(), *headers] if v is not None)]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> None:
    """One ``.warc.gz`` per task, one gzip member per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        with new_file(folder, f"part-{TaskContext.get().partitionId():06d}.warc.gz") as out:
            for batch in batches:
                for r in batch.to_pylist():
                    raw = record_bytes(r["record_id"], r["type"], r["target_uri"], r["date"], r["headers"] or [], r["block"] or b"")
                    out.write(gzip.compress(raw, 6, mtime=0))
                    rows += 1
        yield pa.RecordBatch.from_arrays([pa.array([rows])], ["records"])

    records.select(*ARROW.names).mapInArrow(run, "records bigint").agg(F.sum("records")).first()


class _Inflated:
    """Reads on over the members of a gzip stream; a plain stream is handed through."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.held, self.left = raw, b"", raw.read(READ)
        self.plain = self.left[:2] != b"\x1f\x8b"
        self.member = None if self.plain else zlib.decompressobj(31)

    def more(self) -> bool:
        if not self.left:
            self.left = self.raw.read(READ)
            if not self.left:
                return False
        if self.plain:
            self.held, self.left = self.held + self.left, b""
            return True
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        self.held += self.member.decompress(self.left, READ)
        self.left = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        found, self.held = self.held[:at], self.held[at + len(mark):]
        return found

    def take(self, count: int) -> bytes:
        parts, need = [self.held[:count]], count - len(self.held)
        self.held = self.held[count:]
        while need > 0 and self.more():
            parts.append(self.held[:need])
            self.held, need = self.held[need:], need - len(parts[-1])
        return b"".join(parts)


def read_records(raw: BinaryIO) -> Iterator[dict]:
    """Records of an archive file one after the other; a cut-off last record is left out."""
    stream = _Inflated(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts with {lines[0][:40]!r}")
        fields = [tuple(x.strip() for x in line.partition(":")[::2]) for line in lines[1:] if ":" in line]
        own = {k.lower(): v for k, v in fields}
        length = int(own.get("content-length", 0))
        block = stream.take(length)
        if len(block) < length:
            return
        stream.take(4)
        known = {k.lower() for k in OWN_LINES}
        rest: dict[str, str] = {}
        for k, v in fields:
            if k.lower() not in known:
                rest[k] = f"{rest[k]}, {v}" if k in rest else v
        yield {
            "record_id": own.get("warc-record-id"), "type": own.get("warc-type"), "target_uri": own.get("warc-target-uri"),
            "date": own.get("warc-date"), "headers": list(rest.items()), "block": block,
        }


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all ``.warc`` and ``.warc.gz`` files of a folder, each file streamed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = file_system(path)
                with store.open_input_file(name) as raw:
                    held = []
                    for record in read_records(raw):
                        held.append(record)
                        if len(held) == ROWS or len(record["block"]) > READ:
                            yield pa.RecordBatch.from_pylist(held, ARROW)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder)
    return files.select("path").mapInArrow(run, SCHEMA)


# --- derivatives -----------------------------------------------------------------------


def http_parts(block: bytes) -> tuple[list[str], bytes]:
    """Header lines (the status line first) and payload of an HTTP response; no lines without a header."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return [], block
    return head.decode("iso-8859-1").split("\r\n"), payload


def decoded(payload: bytes, content_type: str) -> str:
    """Text of a payload by the charset of the header, else of the page, else UTF-8."""
    named = CHARSET.search(content_type)
    inside = META_CHARSET.search(payload, 0, 2048)
    name = named.group(1) if named else inside.group(1).decode() if inside else "utf-8"
    try:
        return payload.decode(name, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def page_text(source: str) -> tuple[str, list[str]]:
    """All visible text, one line per block, and the targets of links in page order."""
    blocks, words, links, at = [], [], [], 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            blocks.append(text)

    while (match := TOKEN.search(source, at)) is not None:
        words.append(source[at:match.start()])
        at = match.end()
        if match.group(2) is None:
            words.append("<" if match.group() == "<" else "")
            continue
        tag, attributes = match.group(2).lower(), match.group(3)
        if not match.group(1) and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag == "br" or tag not in INLINE:
            flush()
        elif tag == "a" and not match.group(1):
            links += [html.unescape(a or b or c) for n, a, b, c in ATTRIBUTE.findall(attributes) if n.lower() == "href"]
    words.append(source[at:])
    flush()
    return "\n".join(blocks), links


def derive(record: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    block, source = record["block"] or b"", dict(record["headers"] or [])
    lines, payload = http_parts(block)
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    content_type = named.get("content-type", "")
    body, payload_digest, block_digest = decoded(payload, content_type), digest(payload), digest(block)
    is_text = content_type.split(";")[0].strip().lower() in ("", "text/html", "application/xhtml+xml")
    text, links = page_text(body) if is_text else (body if content_type.lower().startswith("text/") else "", [])
    told = source.get("WARC-Payload-Digest")
    check = "absent" if told is None else "match" if told == payload_digest else "mismatch"
    title = TITLE.search(body) if is_text else None
    base = record["record_id"] or f"{record['target_uri']} {record['date']} {block_digest}"
    ids = {kind: f"<urn:uuid:{uuid.uuid5(IDS, f'{kind} {base}')}>" for kind in ("metadata", "conversion")}
    fields = [
        ("conversion", ids["conversion"]), ("status-line", lines[0] if lines else None),
        *(("source-header", x) for x in lines[1:]), ("source-block-digest", block_digest),
        ("source-payload-digest", payload_digest), ("digest-check", check),
        ("title", " ".join(html.unescape(title.group(1)).split()) if title else None),
        *(("outlink", " ".join(x.split())) for x in links),
    ]
    metadata = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode("utf-8", "replace")
    out = []
    for kind, mime, content in (
        ("metadata", "application/warc-fields", metadata),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    ):
        headers = [
            ("WARC-Refers-To", record["record_id"]), ("WARC-Refers-To-Target-URI", record["target_uri"]),
            ("WARC-Refers-To-Date", record["date"]), ("WARC-Block-Digest", digest(content)), ("Content-Type", mime),
        ]
        out.append({
            "record_id": ids[kind], "type": kind, "target_uri": record["target_uri"], "date": record["date"],
            "headers": [(k, v) for k, v in headers if v is not None], "block": content,
        })
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for every response: ``metadata`` and ``conversion``, in the columns of the input's records.

    Both refer to the response by id, target and date.  The metadata record names the conversion record and holds
    the response's HTTP lines, its digests, whether the payload digest it declared is right, title and links.
    The conversion record holds the visible text; responses that are neither HTML nor text have an empty one.
    Derived ids follow from the response's id alone (from its target, date and digest if it has none), so a job that
    is run again gives equal records, and repeated rows give repeated records.  A NULL block is an empty one;
    NULL fields are left out; blocks without HTTP header are payload throughout.  Records of
    other types give nothing; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                made = [d for r in batch.slice(a, ROWS).to_pylist() for d in derive(r)]
                yield pa.RecordBatch.from_pylist(made, ARROW)

    return records.where("type = 'response'").select(*ARROW.names).mapInArrow(run, SCHEMA)


def responses(
    pages: DataFrame, date: str, key: str = "page_id", url: str = "url", source: str = "html",
) -> DataFrame:
    """A response record for every page, as a crawler would have stored it at ``date``."""
    body = F.coalesce(F.col(source), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    # A digest in base 32: five hexadecimal digits are four of base 32.
    hexed = F.sha1(body)
    digits = F.concat(*[
        F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ])
    base32 = F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    named = F.md5(F.concat_ws(" ", F.col(key).cast("string"), F.col(url)))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    name = F.concat_ws("-", *[F.substring(named, a, n) for a, n in cuts])
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), name, F.lit(">")).alias("record_id"), F.lit("response").alias("type"),
        F.col(url).alias("target_uri"), F.lit(date).alias("date"),
        F.create_map(
            F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), base32),
            F.lit("Content-Type"), F.lit("application/http; msgtype=response"),
        ).alias("headers"),
        F.concat(head.cast("binary"), body).alias("block"),
    )
