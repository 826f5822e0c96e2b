"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader deals out byte ranges of the archives. A task scans its range for the gzip magic, takes a candidate for a
member only if its header decodes and its first bytes inflate to a WARC version line, and owns every record that starts
inside its range; the last one it reads beyond the range's end. Compressed data that happens to hold the magic fails
the validation.

Records with equal payloads of at least ``REVISIT_BYTES`` are written once as ``response``; the others become
``revisit`` records that name it. A revisit's block keeps the HTTP header with the full payload's length.

Defined results: a null payload is empty; a null page_id is written as ``null`` and read back as null; of repeated
page_ids with the largest number all are responses; control characters and spaces in a URL are percent-encoded; an
empty table gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, own_dir, sized, written

REVISIT_BYTES = 1000
#: Bytes of a range that one task scans.
SPLIT_BYTES = 8 << 20
#: A new archive is begun after so many bytes.
ARCHIVE_BYTES = 256 << 20
_MAGIC = b"\x1f\x8b\x08"
_READ, _STEP = 1 << 20, 1 << 14
_DATE = "2024-01-01T00:00:00Z"


def _filesystem(path: str):
    """The file system of a URI and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _member(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _quoted(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def _record(page, url, payload: bytes, digest: str, kind: str, refers) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", f"<urn:page:{'null' if page is None else page}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _quoted(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>")]
    return _member(kind, headers, http if kind == "revisit" else http + payload)


def plan_revisits(pages: DataFrame) -> DataFrame:
    """pages with payload, digest, record_type and refers_to."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keyed = rows.withColumn("key", F.when(F.length("payload") >= REVISIT_BYTES, F.col("digest")))
    # Partial aggregation leaves one row per task and payload; only payloads that occur again are joined back.
    again = keyed.where("key is not null").groupBy(F.col("key").alias("again")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = keyed.join(sized(written(again, "warc-again")), F.col("key") == F.col("again"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes archives under ``folder``; returns (path, bytes, records) of those that committed tasks wrote.

    Every attempt of a task writes files of its own names; the manifest, written as a table, names only those of
    attempts that Spark committed, so a lost or repeated attempt leaves nothing that is read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        out, path, size, count, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out:
                out.close()
                done.append((path, size, count))
                out = None

        for b in batches:
            for row in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, count = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None, buffer_size=_READ)
                    size += out.write(info := _member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")) or len(info)
                size += out.write(member := _record(*(x.as_py() for x in row))) or len(member)
                count += 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "bytes", "records"])

    return written(map_arrow(records, write, "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """A file read forward in steps; keeps only what is still needed."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data, self.over = file, start, bytearray(), False
        file.seek(start)

    def more(self, least: int = _READ) -> bool:
        got = self.file.read(least)
        self.over = not got
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.start += n


def _inflate(window: _Window, at: int):
    """The record at ``at`` of the window and the place after its member; None if no WARC record begins there."""
    unpack, out, pos, head = zlib.decompressobj(31), [], at, b""
    try:
        while not unpack.eof:
            if pos >= len(window.data) and not window.more():
                return None
            piece = unpack.decompress(bytes(window.data[pos : pos + _STEP]))
            pos = min(pos + _STEP, len(window.data))
            out.append(piece)
            if len(head) < 7:
                head += piece[:7]
                if not b"WARC/1.".startswith(head[:7]):
                    return None
    except zlib.error:
        return None
    return (b"".join(out), pos - len(unpack.unused_data)) if head[:7] == b"WARC/1." else None


def _parse(member: bytes) -> Iterator[dict]:
    """The records of a member: one, or several in a row. Folded header lines are joined with a space."""
    while member.startswith(b"WARC/1."):
        head, _, rest = member.partition(b"\r\n\r\n")
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = headers.get("content-length", "")
        length = int(length) if length.isdecimal() else len(rest)
        yield {"headers": headers, "block": rest[:length]}
        member = rest[length:].lstrip(b"\r\n")


def scan_range(path: str, start: int, end: int) -> Iterator[dict]:
    """The records whose first byte lies in [start, end) of the archive."""
    store, inner = _filesystem(path)
    with store.open_input_file(inner) as file:
        window = _Window(file, start)
        window.more(min(_READ, end - start + 4096))
        at, sure = 0, False  # sure: at a place where a member must begin
        while window.start + at < end:
            found = at if sure else window.data.find(_MAGIC, at)
            if not sure and found < 0:
                keep = max(0, len(window.data) - 2)
                window.drop(keep)
                at = 0
                if not window.more():
                    return
                continue
            if window.start + found >= end:
                return
            while len(window.data) < found + 10 and window.more():
                pass
            if sure and len(window.data) <= found:
                return
            flags_ok = window.data[found : found + 3] == _MAGIC and len(window.data) > found + 3 and window.data[found + 3] < 32
            whole = _inflate(window, found) if flags_ok else None
            if not whole:
                at, sure = found + 1, False
                continue
            yield from _parse(whole[0])
            at, sure = whole[1], True
            if at > _READ:
                window.drop(at)
                at = 0


def _page(identifier: str) -> int | None:
    """The page of an identifier that ``write_warc`` has given; None for others."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", identifier)
    return int(found[1]) if found else None


def _declared(digest: str) -> str | None:
    """A SHA-1 in hex, from base32 or hex after ``sha1:``; None if there is none that can be read."""
    kind, _, value = digest.partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def _row(record: dict) -> tuple | None:
    h = record["headers"]
    kind = h.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    own = h.get("warc-record-id", "")
    page, declared = _page(own), _declared(h.get("warc-payload-digest", ""))
    is_http = h.get("content-type", "application/http").lower().startswith("application/http")
    http, _, payload = record["block"].partition(b"\r\n\r\n") if is_http else (b"", b"", record["block"])
    if kind == "revisit":
        stated = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        size, payload, digest = int(stated[1]) if stated else None, None, declared
        refers = _page(h.get("warc-refers-to", ""))
    else:
        size, digest, refers = len(payload), hashlib.sha1(payload).hexdigest(), None
        if declared not in (None, digest) and own.startswith("<urn:page:"):
            raise ValueError(f"payload of {own} does not match its digest")
    return (page, unquote(h.get("warc-target-uri", "").strip("<>")), kind, size, digest, refers, own or None, declared, payload)


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of ``archives`` (path, bytes), read in byte ranges.

    Archives of others are read like the engine's own: ``page_id`` and ``refers_to`` are null where identifiers are not the
    engine's, a response's digest is computed, and ``declared_digest`` has what its record says, null if that can't be read.
    """
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    tasks = max(1, min(10_000, ranges.count()))
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "declared_digest", "payload")
    width = len(names) - (not payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, size = [], 0
                for record in scan_range(path, start, end):
                    if row := _row(record):
                        rows.append(row[:width])
                        size += len(record["block"]) if payloads else 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[:width], strict=True)], names[:width])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[:width], strict=True)], names[:width])

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, declared_digest string" + ", payload binary" * payloads
    return map_arrow(ranges.repartition(tasks), read, schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page into WARC archives in the shared folder, and all records read back from them."""
    folder = f"{own_dir(spark)}/warc/{uuid.uuid4().hex}"
    archives = write_warc(plan_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read_warc(spark, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM w
    """,
}
