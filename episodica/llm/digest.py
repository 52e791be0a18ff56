"""Quartile bucket digest of documents, and its bounded difference score.

A text's UTF-8 bytes are read in windows of five; six triplets of each window (all with its first byte) are hashed
into 256 buckets. The digest is a byte for the length on a log scale, a byte for two quartile ratios, and two bits per
bucket telling the quartile its count lies in. The difference adds quartile distances (the widest counts double) and
the two header distances; likeness falls linearly from 1 at no difference to 0 at the difference of independent
digests.

Edge cases: null is the empty text; texts under three bytes have no triplet, hence all-zero quartiles, and are told
apart by length alone. Equal texts have equal digests. The next document follows in descending id order (ties by
text hash, null ids last), the first follows the last; a single document follows itself. Repeated rows are kept. An
empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, written

BUCKETS = 256
#: Difference of two digests with independent quartiles: (4*0 + 6*1 + 4*2 + 2*6) / 16 for each bucket.
UNLIKE = BUCKETS * 26 / 16
_WEIGHT = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
# odd multipliers of the three places; the triplet's shape is told apart by an added constant
_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_SHAPES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))


def counts(data: bytes) -> np.ndarray:
    """Counts of hashed byte triplets."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    first, second, third = (b * k for k in _K)
    total = np.zeros(BUCKETS, np.int64)
    for shape, (i, j) in enumerate(_SHAPES):
        if (n := len(b) - j) > 0:
            h = first[:n] + second[i : i + n]
            h += third[j : j + n]
            h += np.uint32(shape * 0x3C6EF372 & 0xFFFFFFFF)
            h >>= np.uint32(24)
            total += np.bincount(h, minlength=BUCKETS)
    return total


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    c = counts(data)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    code = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    packed = (code[0::4] << 6) | (code[1::4] << 4) | (code[2::4] << 2) | code[3::4]
    length = min(255, round(math.log2(len(data) + 1) * 8))
    ratios = (int(q1 * 16 // q3) % 16) << 4 | int(q2 * 16 // q3) % 16 if q3 else 0
    return f"{length:02x}{ratios:02x}" + packed.astype(np.uint8).tobytes().hex()


def _codes(digest: str) -> tuple[int, int, int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    body = raw[2:]
    return int(raw[0]), int(raw[1] >> 4), int(raw[1] & 15), np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], 1).reshape(-1)


def difference(a: str, b: str) -> float:
    """Bounded difference score of two digests: 0 for equal ones, UNLIKE at most."""
    (la, qa, ra, ca), (lb, qb, rb, cb) = _codes(a), _codes(b)
    ring = lambda x, y: min((x - y) % 16, (y - x) % 16)
    return float(min(UNLIKE, _WEIGHT[ca, cb].sum() + abs(la - lb) + ring(qa, qb) + ring(ra, rb)))


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else 1.0 - difference(a, b) / UNLIKE


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edit(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _compared(text: str, following: str, own: str, other: str) -> tuple:
    changed = edit(text, following)
    new = fingerprint(changed)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), own, new, likeness(own, new), likeness(own, other)


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's digest against that of its edited text and of the next document, in descending id order.

    Compressed texts are dealt by ranges of id and text hash (so rows of one id may lie in several tasks); each task walks its sorted range. A task's first and last document are put
    out with their texts, as the neighbours of other tasks' documents; these few rows (two for each partition) are
    then matched in one more small step.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([z.compress(x) for x in raw], pa.binary()), pa.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in raw], pa.int64())], names=["id", "z", "tie"])

    def walk(batches):
        from pyspark import TaskContext

        part, z, before, first = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), None, True
        for b in batches:
            out = []
            for key, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = z.decompress(packed, max_output_size=max(1, zstandard.frame_content_size(packed))).decode()
                own = fingerprint(text)
                if first:
                    out.append((key, part, 0, packed, *[None] * 6))
                    first = False
                else:
                    out.append((before[0], part, None, None, *_compared(before[1], text, before[2], own)))
                before = (key, text, own, packed)
            yield from _rows(out)
        if before:
            yield from _rows([(before[0], part, 1, before[3], *[None] * 6)])

    types = [_arrow(docs.schema[id_col].dataType), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["id", "part", "edge", "z", *_NAMES]

    def _rows(rows):
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def close(batches):
        z, last, head = zstandard.ZstdDecompressor(), None, None
        plain = lambda x: z.decompress(x, max_output_size=max(1, zstandard.frame_content_size(x))).decode()

        def pair(a, b):
            text, following = plain(a["z"]), plain(b["z"])
            return _rows([(a["id"], a["part"], None, None, *_compared(text, following, fingerprint(text), fingerprint(following)))])

        for b in batches:  # in order of partition, first document before last; two are held at a time, and the very first
            for row in b.to_pylist():
                if row["edge"] == 0:
                    head = head or row
                    if last:
                        yield from pair(last, row)
                else:
                    last = row
        if last:
            yield from pair(last, head)

    schema = f"id {kind}, part int, edge int, z binary, {_OUT}"
    packed = docs.select(id_col, text_col).mapInArrow(squeeze, f"id {kind}, z binary, tie long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").desc_nulls_last(), F.col("tie").desc()]
    walked = written(packed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "z").mapInArrow(walk, schema), "digest")
    edges = walked.where("edge is not null").select(*names).coalesce(1).sortWithinPartitions("part", "edge").mapInArrow(close, schema)
    return walked.where("edge is null").unionByName(edges).select(F.col("id").alias(id_col), *_NAMES)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op6_digest(spark, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"))
