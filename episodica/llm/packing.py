"""Best-fit packing with bounded space: token sequences of documents into rows of fixed capacity.

Pieces are dealt over partitions in number to the input; in each, an online best-fit packer takes them as they come
and keeps a fixed number of open bins. Their free spaces are the set bits of one integer, so the tightest bin that
takes a piece is the lowest bit at or above its length; when one bin too many is open, the fullest (the lowest bit)
closes. Only the pieces' numbers and lengths are dealt; token ids join their places afterwards, evenly spread.

Edge cases: a null or empty text is its end token alone, one piece of length 1. A document over the capacity is cut
into pieces of the capacity, the last one shorter. Repeated rows are packed row by row. An empty table gives an empty
one. Other columns are ignored.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary
from .common import small_batches, table, with_rid, written

#: Tokens of a sequence, open bins of a packer, and pieces that one packer gets on average.
CAPACITY, OPEN_BINS, PIECES_PER_PACKER = 2048, 1024, 60_000


class BestFit:
    """Online best fit over a bounded number of open bins; place() gives the bin and the offset in it."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit, self.open, self.next, self.bits = capacity, open_bins, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # of each free space

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.next
            self.next += 1
        rest = free - length
        if rest:
            self.bins[rest].append(at)
            self.bits |= 1 << rest
            self.open += 1
            if self.open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return at, self.capacity - free


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids BINARY): each document's ids and the end id, cut at the capacity."""
    small_batches(docs.sparkSession)
    end, step = array("I", [end_id]).tobytes(), 4 * capacity

    def run(batches):
        code = encoder(path, decoding=False)
        for b in batches:
            keys, piece, start, ids = [], [], [], []
            for k, coded in enumerate(code.ids_batch(b.column(1).to_pylist())):
                coded += end
                for at in range(0, len(coded), step):
                    keys.append(k)
                    piece.append(at // step)
                    start.append(at // 4)
                    ids.append(coded[at : at + step])
            cols = [b.column(0).take(pa.array(keys, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.record_batch(cols, names=["id", "piece", "start", "length", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def assign(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Add sequence_id and offset to rows that have a length of 1 to the capacity.

    The rows are written once to the shared folder, so their number is known and a lost task repeats exactly.
    """
    spark = cut.sparkSession
    rows = written(cut, "pieces")
    n = max(1, -(-rows.count() // per_packer))
    fields = rows.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id long, offset long"
    length_at = fields.index("length")

    def run(batches):
        from pyspark import TaskContext

        base, packer = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for b in batches:
            at = [packer.place(n) for n in b.column(length_at).to_pylist()]
            table_ = pa.Table.from_batches([b])
            yield from table_.append_column("sequence_id", pa.array([base + s for s, _ in at], pa.int64())).append_column("offset", pa.array([o for _, o in at], pa.int64())).to_batches()

    # the order within a packer is fixed by the rows alone; hashing mixes lengths, which is what best fit wants
    mixed = rows.withColumn("_deal", F.xxhash64(fields[0], "piece", "start", "length"))
    dealt = mixed.repartition(n, "_deal").sortWithinPartitions("_deal", fields[0], "piece")
    return dealt.select(*fields).mapInArrow(run, kind)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset): each piece of docs with its ids and its place."""
    cut = with_rid(pieces(docs, path, capacity, id_col=id_col, text_col=text_col), "_row")
    places = assign(cut.select("_row", "piece", "start", "length"), capacity, open_bins)
    return cut.join(places.select("_row", "sequence_id", "offset"), "_row").drop("_row")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents"), vocabulary())
    return assign(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
