"""WARC writer and splittable reader over gzip members.

The writer makes one gzip member per record and one archive per task in the shared folder; only archives that the
written manifest lists count, so a repeated task leaves no double record. The reader deals byte ranges of the archives
over tasks: a task scans its range for the gzip magic, validates a candidate by decoding its member's WARC header block
(version line and Content-Length), and owns the records that start inside the range, reading past its end for the last
of them. What lies between one record's end and the next record's start, or between the last record and the file's
end, is damage: read_archives raises on it, or with damaged="rows" gives a row of what was skipped (headers with
x-damaged, the offset, and its bytes as payload).

Edge cases: a null payload is the empty payload. Equal payloads of at least min_bytes bytes have one response, the row
with the smallest id; rows that repeat this id and payload are responses too, rows without an id only if no row has
one. A null url gives no target header; characters outside printable ASCII are percent-encoded in it. An empty table
gives no archive and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, table, written

# The gzip member head that the writer makes, and the profile of revisit records.
MAGIC = b"\x1f\x8b\x08"
HEAD = MAGIC + b"\0\0\0\0\0\0\xff"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a reader's range, and of one read.
RANGE_BYTES, READ_BYTES = 4 << 20, 1 << 20
#: Bytes of a look for the gzip magic or into a record.
SCAN_BYTES = 32 << 10


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str):
    """(file system, path in it) for a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(data: bytes, level: int = 5) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    return HEAD + z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def record(page, url: str | None, payload: bytes, first, revisit: bool, date: str) -> bytes:
    """A WARC response record, or a revisit of the first page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {first}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Bytes: {len(payload)}", f"X-Page: {'' if page is None else page}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def mark(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, url, payload, first, revisit): which rows revisit the response of an equal payload."""
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha", F.sha2("payload", 256))
    keyed = p.withColumn("dedup", F.octet_length("payload") >= min_bytes)
    first = keyed.where("dedup").groupBy("sha").agg(F.min("id").alias("first"))
    return keyed.join(first, "sha", "left").select("id", "url", "payload", "first", (F.col("dedup") & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))


def write_archives(marked: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the records; the manifest (path, size) of the archives."""
    spark = marked.sparkSession
    small_batches(spark, 256)
    folder = new_path(spark, "warc")

    def run(batches):
        from pyspark import TaskContext

        out, at = None, TaskContext.get()
        for b in batches:
            if out is None and b.num_rows:
                store, root = filesystem(folder)
                store.create_dir(root, recursive=True)
                name = f"part-{at.partitionId():05d}-{at.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            for page, url, payload, first, revisit in zip(*(c.to_pylist() for c in b.columns)):
                out.write(member(record(page, url, payload, first, revisit, date)))
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], names=["path", "size"])

    return written(marked.mapInArrow(run, "path string, size long"), "warc-manifest")


class Damaged(ValueError):
    """Bytes of an archive that belong to no record."""


def announced(head: bytes) -> int | None:
    """Length of the block that a WARC header block announces."""
    found = re.search(rb"\r\ncontent-length:[ \t]*([0-9]+)", head, re.I)
    return int(found[1]) if found else None


class Window:
    """Reads of a file through its last READ_BYTES or more."""

    def __init__(self, f, size: int):
        self.f, self.size, self.base, self.data = f, size, 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        if at < self.base or at + n > self.base + len(self.data):
            self.base, self.data = at, self.f.read_at(min(max(n, READ_BYTES), self.size - at), at)
        return self.data[at - self.base : at - self.base + n]


def whole(f, at: int, size: int) -> tuple[int, int, bytes] | None:
    """(start, end, record) of the member that starts at a place; None if there is no whole one.

    A member that does not begin with a version line is given up after its first bytes; header blocks may be of any length.
    """
    z, out, used, expected, body = zlib.decompressobj(31), bytearray(), at, None, 0
    try:
        while not z.eof:
            piece = f.read_at(min(SCAN_BYTES, size - used), used) if used < size else b""
            if not piece:
                return None
            seen = len(out)
            if seen < len(VERSION):
                out += z.decompress(piece, len(VERSION))
                if out[: len(VERSION)] != VERSION[: len(out)]:
                    return None
                rest = z.unconsumed_tail
                used += len(piece) - len(rest) - len(z.unused_data)
                if not rest:
                    continue
                piece = rest
            out += z.decompress(piece)
            used += len(piece) - len(z.unused_data)
            if expected is None:
                end = out.find(b"\r\n\r\n", max(0, seen - 3))
                if end >= 0:
                    expected, body = announced(bytes(out[:end])), end + 4
                    if expected is None:
                        return None
    except zlib.error:
        return None
    return (at, used, bytes(out)) if expected is not None and len(out) - body >= expected else None


def next_record(f, pos: int, end: int, size: int) -> tuple[int, int, bytes] | None:
    """The first whole record that starts in [pos, end)."""
    base, data = pos, b""
    while pos < end:
        if pos + len(MAGIC) > base + len(data):
            base, data = pos, f.read_at(min(SCAN_BYTES, size - pos), pos)
        at = data.find(MAGIC, pos - base)
        if at < 0:
            if base + len(data) >= size:
                return None
            pos, data = base + len(data) - len(MAGIC) + 1, b""
            base = pos
            continue
        pos = base + at
        if pos >= end:
            return None
        if found := whole(f, pos, size):
            return found
        pos += 1  # not a record's start
    return None


def read_range(store, path: str, start: int, end: int, size: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, record) of the members that start in [start, end), and with None for the record the stretches that follow one of them, or the file's start, and belong to none."""
    with store.open_input_file(path) as file:
        f = Window(file, size)
        pos, after = start, 0 if start == 0 else None  # after: where a record must start, or the file end
        while found := next_record(f, pos, end, size):
            if after is not None and found[0] > after:
                yield after, found[0], None
            yield found
            pos = after = found[1]
        if after is not None and after < size:
            following = next_record(f, after, size, size)
            if (to := following[0] if following else size) > after:
                yield after, to, None


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, damaged: str = "raise") -> DataFrame:
    """(headers MAP, payload BINARY) of every record in the listed archives."""
    spark = manifest.sparkSession
    small_batches(spark, 256)
    ranges = manifest.select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = ranges.count()

    def run(batches):
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                store, root = filesystem(path)
                heads, bodies, held = [], [], 0
                for at, to, raw in read_range(store, root, start, min(size, start + range_bytes), size):
                    if raw is None:
                        if damaged == "raise":
                            raise Damaged(f"{path}: bytes {at} to {to} are no record's")
                        with store.open_input_file(root) as f:
                            fields, payload = {"x-damaged": str(at)}, f.read_at(to - at, at)
                    else:
                        fields, payload = parse(raw)
                    heads.append(list(fields.items()))
                    bodies.append(payload)
                    held += len(payload)
                    if held > 8 << 20:
                        yield pa.record_batch([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(bodies, pa.binary())], names=["headers", "payload"])
                        heads, bodies, held = [], [], 0
                yield pa.record_batch([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(bodies, pa.binary())], names=["headers", "payload"])

    return ranges.repartition(max(1, n)).mapInArrow(run, "headers map<string,string>, payload binary")


def base32(hexed) -> F.Column:
    """Base32 text of 20 bytes given in hex: five bytes make eight letters."""
    letters, parts = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), []
    for k in range(0, 40, 10):
        n = F.conv(F.substring(hexed, k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(letters, (F.shiftright(n, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*parts)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(mark(table(spark, sf_dir, "pages"))))
    h, response = F.col("headers"), F.col("headers")["warc-type"] == "response"
    return records.select(
        F.when(h["x-page"] != "", h["x-page"]).cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(h["x-payload-bytes"].cast("long")).alias("payload_bytes"),
        F.when(response, base32(F.sha1("payload"))).otherwise(F.substring_index(h["warc-payload-digest"], ":", -1)).alias("payload_digest"),
        h["warc-type"].alias("record_type"),
        h["x-refers-to-page"].cast("long").alias("refers_to"),
    )


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS sha, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first_id FROM p),
d AS (SELECT *, list_transform([1, 11, 21, 31], lambda k: ('0x' || substr(h, k, 10))::BIGINT) AS ns FROM q)
SELECT page_id, strlen(body) AS payload_bytes,
  list_aggregate(list_transform(ns, lambda n: list_aggregate(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
