"""Legacy web archives: ARC files into WARC files, and WARC files into rows.

An ARC file begins with a version block, whose body's first number says which
header line each record has:

    1: URL IP-address Archive-date Content-type Archive-length
    2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The converter reads the version block, parses each header line by it, takes
exactly the declared length as content, splits an HTTP head from the payload,
and makes up what WARC asks for: a record id (a name-based UUID of the header
line and the payload's digest), WARC-Date from the 14 digits, the type, block
and payload digests (base32 SHA-1).  Records whose payload another record has
become revisits of the one with the largest key.  The key of a record is the
number in the HTTP header ``X-Source-Key``; archives without it have null keys.

Archives may be gzipped, as a whole or by record; they are inflated and parsed
piece by piece.  WARC files have a gzip member per record and are cut by
bytes.  Spark's text writer writes them: a row is a file, whose last byte, a
zero, is the line separator.  Payloads are any bytes.

A null payload is empty, a null URL is ``-``; keys are integers, a null key
stays null.  Of records with equal payloads and equal largest keys all are
responses.  Malformed header lines, lengths and truncated records raise an
error.  Repeated rows: a record each.  No pages: no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.arrow import chunks, map_chunks
from timeloom.llm.storage import new_path

#: Fixed values of the formats.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
VERSION_URL = b"filedesc://"
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY_HEADER = "X-Source-Key"
#: Bytes at which a WARC file ends; its last record may go beyond.
FILE_BYTES = 32 << 20
#: Bytes inflated at a time, and bytes of payload handed on at a time.
PIECE = 1 << 20

_SPACE = re.compile(r"[\x00-\x20\x7f]+")
_KEY = re.compile(rf"^{KEY_HEADER}:\s*(-?\d+)\s*$".encode(), re.IGNORECASE | re.MULTILINE)
_PARTS = "key bigint, uri string, date string, head binary, payload binary, digest string, record_id string, payload_bytes bigint"
_READ = "key bigint, uri string, date string, record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, of all its gzip members if it is gzipped, in pieces."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield data[at : at + PIECE]
        return
    rest = memoryview(data)
    while len(rest):
        member = zlib.decompressobj(31)
        given = 0
        while not member.eof:
            # what the last call left over comes first
            part = member.unconsumed_tail
            if not part:
                part = rest[given : given + PIECE]
                given += len(part)
                if not part:
                    raise ValueError("the archive ends inside a gzip member")
            yield member.decompress(part, PIECE)
        rest = rest[given - len(member.unused_data) :]


class Source:
    """Lines and stretches of bytes of an archive, read ahead by a piece."""

    def __init__(self, data: bytes):
        self.pieces, self.held, self.at, self.before = inflated(data), b"", 0, 0

    def _more(self) -> bool:
        for piece in self.pieces:
            if piece:
                self.before += self.at
                self.held, self.at = self.held[self.at :] + piece, 0
                return True
        return False

    def position(self) -> int:
        return self.before + self.at

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to ``mark``, which is passed over; None if there is none."""
        start = self.at
        while (end := self.held.find(mark, start)) < 0:
            left = len(self.held) - self.at
            if not self._more():
                return None
            start = max(0, left - len(mark) + 1)
        out, self.at = self.held[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        """``n`` bytes, or fewer at the end."""
        parts, got = [], 0
        while got < n:
            if self.at == len(self.held) and not self._more():
                break
            part = self.held[self.at : self.at + n - got]
            self.at += len(part)
            got += len(part)
            parts.append(part)
        return b"".join(parts)

    def skip(self, byte: bytes) -> None:
        while self.at < len(self.held) or self._more():
            if self.held[self.at : self.at + 1] != byte:
                return
            self.at += 1


def arc_file(records: list[tuple[str | None, str, str, str, bytes]], version: int = 1) -> bytes:
    """An ARC file of (url, ip, date, mime, content) records behind its version block."""
    body = f"{version} 0 converter\n{ARC_NAMES[version]}\n".encode()
    out = []
    for url, ip, date, mime, content in [("filedesc://pages.arc", "0.0.0.0", "20200101000000", "text/plain", body), *records]:
        clean = _SPACE.sub("%20", url or "") or "-"
        fields = {
            "url": clean, "ip": ip, "date": date, "mime": mime, "result": "200", "checksum": "-", "location": "-",
            "offset": "0", "filename": "-", "length": str(len(content)),
        }
        out.append(" ".join(fields[x] for x in ARC_FIELDS[version]).encode() + b"\n" + content + b"\n")
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Header fields and content of each record of an ARC file, by the version block."""
    source, names = Source(data), None
    while True:
        source.skip(b"\n")
        at = source.position()
        line = source.until(b"\n")
        if line is None:
            if source.take(1):
                raise ValueError(f"the ARC file ends inside the header line at byte {at}")
            return
        values = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        block = line.startswith(VERSION_URL)
        if not block and names is None:
            raise ValueError("the ARC file has no version block")
        if not block and len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"ARC header line at byte {at} has {len(values)} fields: {line[:200]!r}")
        length = int(values[-1])
        content = source.take(length)
        if len(content) != length:
            raise ValueError(f"the ARC record at byte {at} declares {length} bytes and has {len(content)}")
        if block:
            version = content.split(None, 1)[0].decode("ascii", "replace") if content.split() else ""
            if version not in ("1", "2"):
                raise ValueError(f"ARC version {version!r}")
            names = ARC_FIELDS[int(version)]
        else:
            yield dict(zip(names, values, strict=True)) | {"content": content, "line": line}


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its empty line, and payload."""
    if content.startswith(b"HTTP/"):
        head, gap, payload = content.partition(b"\r\n\r\n")
        if gap:
            return head + gap, payload
    return b"", content


def warc_date(date: str) -> str:
    """ISO 8601 from up to 14 digits; missing ones are the smallest."""
    digits = (date + "19700101000000"[len(date):])[:14] if date.isdigit() else "19700101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(line: bytes, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(line + digest.encode()).digest()[:16], version=5)}>"


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of (row, bytes) with some megabytes each."""
    held, total = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([r[j] for r in held], t) for j, t in enumerate(schema.types)], schema=schema)
    for row, size in rows:
        held.append(row)
        total += size + 200
        if total >= PIECE:
            yield out()
            held, total = [], 0
    if held:
        yield out()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def convert(archives: DataFrame) -> DataFrame:
    """Reads ARC files (column content) into the parts of WARC records: key, uri, date, head, payload, digest, id.  No shuffle."""

    def rows(data: bytes) -> Iterator[tuple[tuple, int]]:
        for parsed in parse_arc(data):
            head, payload = split_http(parsed["content"])
            key = _KEY.search(head.replace(b"\r", b""))
            digest = sha1_base32(payload)
            row = (int(key[1]) if key else None, parsed["url"], warc_date(parsed["date"]), head, payload, digest, record_id(parsed["line"], digest), len(payload))
            yield row, len(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _batches(rows(content.as_py()), _arrow(_PARTS))

    return archives.select("content").mapInArrow(run, _PARTS)


def with_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to (key) and refers_id: of the largest key with an equal payload of at least ``least_bytes``; null for responses.

    One small aggregation over digests; only digests of several records go into the join.
    """
    large = records.where(F.col("payload_bytes") >= least_bytes)
    many = (
        large.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.coalesce("key", F.lit(-(1 << 63))).alias("k"), "key", "record_id")).alias("top"))
        .where("n > 1")
        .select(F.col("digest").alias("d"), F.col("top.key").alias("top_key"), F.col("top.record_id").alias("top_id"))
    )
    joined = records.join(many, (records["digest"] == many["d"]) & (records["payload_bytes"] >= least_bytes), "left")
    revisit = F.col("d").isNotNull() & ~F.col("key").eqNullSafe(F.col("top_key"))
    return joined.select(
        records["*"], F.when(revisit, F.col("top_key")).alias("refers_to"), F.when(revisit, F.col("top_id")).alias("refers_id")
    )


def warc_record(row: dict) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    revisit = row["refers_id"] is not None
    head = row["head"] or f"HTTP/1.0 200 OK\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = head if revisit else head + row["payload"]
    text = lambda x: "" if x is None else str(x)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["uri"]), ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("X-Payload-Length", row["payload_bytes"]), (KEY_HEADER, text(row["key"])),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", row["refers_id"]), ("X-Refers-To-Key", text(row["refers_to"]))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{WARC_VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes WARC files of about ``file_bytes``, a gzip member per record.

    The last byte of a member is the highest of its length, a zero below 16 MB;
    a file that would end in another one gets an empty member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        total = 0

        def file() -> pa.RecordBatch:
            data = b"".join(members)
            data = data if data[-1] == 0 else data + gzip_member(b"")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["file"])

        for batch in batches:
            for chunk in chunks([batch], "payload"):
                for row in chunk.to_pylist():
                    members.append(gzip_member(warc_record(row)))
                    total += len(members[-1])
                    if total >= file_bytes:
                        yield file()
                        members, total = [], 0
        if members:
            yield file()

    files = records.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\x00").option("compression", "none").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, by declared lengths."""
    source = Source(data)
    while True:
        at = source.position()
        lines = source.until(b"\r\n\r\n")
        if lines is None:
            if source.take(1):
                raise ValueError(f"the WARC file ends inside the headers at byte {at}")
            return
        first, *named = lines.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in named)}
        length = int(headers["content-length"])
        block = source.take(length)
        if len(block) != length or source.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not as long as declared")
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """key, uri, date, record_id, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits)."""

    def rows(data: bytes) -> Iterator[tuple[tuple, int]]:
        number = lambda x: int(x) if x else None
        for h, block in parse_warc(data):
            revisit = h["warc-type"] == "revisit"
            payload = None if revisit else split_http(block)[1]
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            if payload is not None and sha1_base32(payload) != digest:
                raise ValueError(f"payload and digest of {h['warc-record-id']} differ")
            size = number(h["x-payload-length"]) if revisit else len(payload)
            row = (number(h.get(KEY_HEADER.lower())), h["warc-target-uri"], h["warc-date"], h["warc-record-id"], h["warc-type"], size, digest, number(h.get("x-refers-to-key")), payload)
            yield row, len(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _batches(rows(content.as_py()), _arrow(_READ))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, _READ)


def pages_to_arc(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """ARC files (column content, some hundred pages each) with the HTTP heads that a crawler stores; version 1 or 2 by their number."""
    bare = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(body, F.lit("")).alias("body"))
    def work(chunk: pa.RecordBatch) -> dict:
        records = []
        for k, u, b in zip(*(chunk.column(c).to_pylist() for c in ("key", "url", "body")), strict=True):
            payload = b.encode()
            own = "" if k is None else f"{KEY_HEADER}: {k}\r\n"
            head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
            records.append((u, "0.0.0.0", "20200101000000", "text/html", head + payload))
        return {"content": pa.array([arc_file(records, 1 + len(records) % 2)], pa.binary())}

    return map_chunks(bare, "body", "content binary", work)


def archived(pages: DataFrame, **kw) -> DataFrame:
    """Pages through ARC into WARC files in the shared folder, and the files' records as rows."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(with_revisits(convert(pages_to_arc(pages, **kw))), path)
    return read_warc(spark, path)
