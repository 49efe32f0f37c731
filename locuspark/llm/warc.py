"""WARC derivatives: each response record gives a linked metadata record and a plain-text conversion record.

Both refer to the response by WARC-Refers-To and keep its target URI and date.  The metadata record's fields hold the
response's HTTP status and headers as they were sent, the response's other WARC headers, its block and payload digests,
its title and its links; the conversion record's block is the page's text, with a digest of its own.  New record ids
follow from the response's id, so a second run gives the same records.

Bodies are taken out of chunked and gzip or deflate encodings before they are read, all members of them; what can't be
decoded is named in the metadata, and so is a body that breaks off, of which what is there is read.  Title and links come
from the page's scan, so comments and scripts have none.  Pages of HTML are converted to the text of their blocks, other text as it is; payloads of any other type
(images, archives, bodies in an unknown encoding) have no conversion record, only metadata.

Files hold one gzip member for each record, as crawlers write them, in segments of bounded size; a task writes under
its own name and renames at the end.  Files are read as streams, record by record, so their size doesn't matter.

Rows: a response without an id gets one from its target and block; null url or page is an empty one; a response
whose block has no HTTP head is all payload, and read as HTML; a payload digest that doesn't fit is reported as a
mismatch, never dropped; repeated rows give repeated records; an empty table gives none; other record types are passed
over; a file that breaks off ends there, within a gzip member without that record; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.html_blocks import Marks, blocks
from locuspark.llm.workers import lean

SEGMENT_BYTES = 64 << 20
#: Members are small, so a higher level takes more time than it saves.
COMPRESSION = 4
#: Bytes of records that are handed on at once.
BATCH_BYTES = 4 << 20
#: Where records come from that have no date of their own.
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = "source_key string, warc_type string, record_id string, refers_to string, target_uri string, date string, record binary"

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = [a + b for a in _LETTERS for b in _LETTERS]
# Headers of a response that its derivatives carry in fields of their own, or that speak of its own block.
_OWN = frozenset("warc-type warc-record-id warc-target-uri warc-date warc-block-digest warc-payload-digest content-type content-length".split())
# Types that are read as HTML.
_HTML = frozenset("text/html application/xhtml+xml".split())
_CHARSET = re.compile(r"charset\s*=\s*\"?([A-Za-z0-9_-]+)", re.I)


def digest(block: bytes) -> str:
    """SHA-1 in base 32, which has a character for five bits; two are looked up at once."""
    n = int.from_bytes(hashlib.sha1(block).digest())
    return "sha1:" + "".join([_BASE32[n >> s & 1023] for s in range(150, -1, -10)])


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case; folded lines joined) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    size = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else max(0, len(rest) - 4)
    return headers, rest[:size]


def http_parts(block: bytes) -> tuple[str, list[str], bytes]:
    """Status line, header lines and payload of a response's block."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, lines, payload


def response(key: str, url: str, page: str, date: str = NO_DATE) -> bytes:
    """A response record around a page."""
    payload = page.encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    whole = digest(block)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key} {url} {whole}")
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Target-URI", url), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", whole), ("WARC-Payload-Digest", digest(payload))],
        block,
    )


def plain_text(page: str, marks: Marks | None = None) -> str:
    return "\n".join(b.text for b in blocks(page, marks)[0])


def header(lines: list[str], name: str) -> str:
    """The last value of an HTTP header, '' where there is none."""
    return next((v.strip() for k, _, v in (x.partition(":") for x in reversed(lines)) if k.strip().lower() == name), "")


def dechunked(body: bytes) -> bytes:
    """The chunks' content, as far as it goes."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size) or not (n := int(size, 16)):
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def inflated(payload: bytes, name: str) -> tuple[bytes, bool] | None:
    """All members of a compressed body, and whether it is whole; None if it isn't compressed like that."""
    for bits in (47, -15) if name == "deflate" else (31,):
        out, rest, whole = [], payload, False
        while rest:
            opened = zlib.decompressobj(bits)
            try:
                out.append(opened.decompress(rest))
                whole = opened.eof
            except zlib.error:
                # What stands behind a whole member and is none itself is padding; a first member must hold.
                if not out:
                    break
                return b"".join(out), whole
            rest = opened.unused_data
        else:
            return b"".join(out), whole
    return None


def body_of(lines: list[str], payload: bytes) -> tuple[bytes, str]:
    """The payload without its transfer and content encodings, and the encoding that can't be undone, if any, or breaks off."""
    if "chunked" in header(lines, "transfer-encoding").lower() and re.match(rb"[0-9A-Fa-f]{1,8}[ ;\r]", payload):
        payload = dechunked(payload)
    encodings = [x.strip().lower() for x in header(lines, "content-encoding").split(",") if x.strip()]
    broken = ""
    for name in reversed(encodings):
        if name == "identity" or not payload:
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return payload, name
        if name != "deflate" and payload[:2] != b"\x1f\x8b":
            continue  # the crawler has undone it already
        found = inflated(payload, name)
        if found is None:
            return payload, name
        payload, whole = found
        broken = broken if whole else f"{name} (breaks off)"
    return payload, broken


def derivatives(raw: bytes, key: str | None = None) -> list[tuple[str, str, str, str, str, bytes]]:
    """(type, record id, refers-to, target, date, record) of the metadata and the conversion of one response."""
    headers, block = parse(raw)
    if headers.get("warc-type", "response") != "response":
        return []
    status, lines, payload = http_parts(block)
    target, date = headers.get("warc-target-uri", ""), headers.get("warc-date", NO_DATE)
    source = headers.get("warc-record-id") or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, target + digest(block))}>"
    sent, found = headers.get("warc-payload-digest", ""), digest(payload)
    body, unknown = body_of(lines, payload)
    kind = header(lines, "content-type").split(";")[0].strip().lower() or "text/html"
    readable = (not unknown or unknown.endswith("(breaks off)")) and (kind in _HTML or kind.startswith("text/"))
    fields = [("http-status", status), *(("http-header", x) for x in lines), *(("warc-header", f"{k}: {v}") for k, v in headers.items() if k not in _OWN)]
    fields += [("source-block-digest", headers.get("warc-block-digest") or digest(block)), ("source-payload-digest", found), ("payload-digest-match", "unknown" if not sent else str(sent == found).lower())]
    fields += [("undecoded", unknown)] if unknown else []
    text = None
    if readable:
        charset = m[1] if (m := _CHARSET.search(header(lines, "content-type"))) else "utf-8"
        try:
            page = body.decode(charset, "replace")
        except LookupError:
            page = body.decode("utf-8", "replace")
        text = page
        if kind in _HTML:
            marks = Marks()
            text = plain_text(page, marks)
            fields += [("title", marks.title)] if marks.title is not None else []
            fields += [("outlink", x) for x in marks.links]
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace"), [])]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"), [("WARC-Source-Payload-Digest", found)]))
    out = []
    for kind, content, block_out, more in made:
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"
        head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Target-URI", target), ("WARC-Date", date), ("Content-Type", content), ("WARC-Block-Digest", digest(block_out)), *more]
        head += [("WARC-Source-Key", key)] if key is not None else []
        out.append((kind, name, source, target, date, record(head, block_out)))
    return out


def responses(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(source_key, record): a response record for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(k or "", u or "", p or "") for k, u, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["source_key", "record"])

    return pages.select(F.col(key).cast("string"), F.col(url).cast("string"), F.col(page).cast("string")).mapInArrow(lean(run), "source_key string, record binary")


def derive(records: DataFrame, *, key: str = "source_key", column: str = "record") -> DataFrame:
    """RECORD: two rows for each response record that can be read as text, one for any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 6 + [pa.binary()]
        for batch in batches:
            rows = [(k, *d) for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if raw for d in derivatives(raw, k)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return records.select(F.col(key).cast("string"), F.col(column)).mapInArrow(lean(run), RECORD)


def write(records: DataFrame, path: str, *, column: str = "record", key: str = "source_key", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes segments of gzip members below path; returns (segment, offset, length, source_key) of each record, once written."""
    from locuspark.llm.token_store import _open
    from locuspark.storage import written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        task, attempt, number, at, out = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, 0, None
        names: list[tuple[str, str]] = []
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or at >= segment_bytes:
                    if out:
                        out.close()
                    names.append((f"{folder}/_{task:06d}-{number:04d}.{attempt}", f"{folder}/part-{task:06d}-{number:04d}.warc.gz"))
                    out, at, number = system.open_output_stream(names[-1][0], compression=None), 0, number + 1
                packed = gzip.compress(raw, COMPRESSION, mtime=0)
                out.write(packed)
                rows.append((names[-1][1].rsplit("/", 1)[1], at, len(packed), k))
                at += len(packed)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["segment", "offset", "length", "source_key"])
        if out:
            out.close()
        for own, final in names:
            system.move(own, final)

    return written(records.select(F.col(key).cast("string"), F.col(column)).mapInArrow(lean(run), "segment string, offset bigint, length bigint, source_key string"), "warc-places")


def members(f: BinaryIO) -> Iterator[bytes]:
    """The records of a segment: of gzip members, or of plain records one after the other.  Reads on as they are taken."""
    start = f.read(2)
    f = gzip.GzipFile(fileobj=_Behind(start, f)) if start == b"\x1f\x8b" else io.BufferedReader(_Behind(start, f))
    with f:
        try:
            while head := f.readline():
                if not head.startswith(b"WARC/"):
                    continue
                lines = [head]
                while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                    lines.append(line)
                size = next((int(x.split(b":", 1)[1]) for x in lines[1:] if x.lower().startswith(b"content-length:") and x.split(b":", 1)[1].strip().isdigit()), 0)
                yield b"".join(lines) + b"\r\n" + f.read(size)
        except (EOFError, zlib.error, gzip.BadGzipFile):  # the file breaks off within a member
            return


class _Behind(io.RawIOBase):
    """A stream with what has been read of it put back."""

    def __init__(self, start: bytes, rest: BinaryIO):
        self.start, self.rest = start, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.start[: len(buffer)] if self.start else self.rest.read(len(buffer))
        self.start = self.start[len(data) :]
        buffer[: len(data)] = data
        return len(data)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the records of all segments below path, of any type; each file is one stream in one task."""
    schema = "file string, record binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from locuspark.llm.token_store import _open

        pack = lambda name, rows: pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.binary())], names=["file", "record"])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, place = _open(re.sub(r"^file:/+", "file:///", name))
                rows, held = [], 0
                with system.open_input_stream(place, compression=None) as f:
                    for raw in members(f):
                        rows.append(raw)
                        held += len(raw)
                        if held >= BATCH_BYTES:
                            yield pack(name, rows)
                            rows, held = [], 0
                if rows:
                    yield pack(name, rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select(F.col("path").alias("file")).mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the segments below path: type, ids, target, date, digests and block."""
    schema = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_key string, digest_holds boolean, block binary"
    fields = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest", "warc-source-key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.string()] * 8 + [pa.bool_(), pa.binary()], [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows = []
            for raw in batch.column(0).to_pylist():
                headers, block = parse(raw)
                rows.append((*(headers.get(f) for f in fields), headers.get("warc-block-digest") == digest(block), block))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return records(spark, path).select("record").mapInArrow(run, schema)
