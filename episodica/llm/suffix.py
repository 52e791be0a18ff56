"""Exact repeats of fixed length across documents, by suffix order and longest-previous-factor arrays.

Bytes are looked at through windows of `length`. Every window picks its smallest k-gram hash as anchor (the leftmost
of equals), so equal windows have equal anchors and meet under the same fingerprint; consecutive windows with one
anchor form a block. Equal blocks are collapsed in the task that finds them and again where their fingerprint's blocks
meet; what differs there is put in suffix order, and previous and next smaller positions in that order give for each
window the nearest earlier match (its longest previous factor, cut at `length`), and mirrored the nearest later one.

keep="none" marks each window that also starts elsewhere; keep="first" marks those with an earlier match, so the first
copy in order of (id, row, position) stays. Null ids come last.

A fingerprint whose differing blocks are many is split by the bytes that all windows of a few neighbouring starts have
in common. Where more than CROWD windows' surroundings still share a split (the inside and the borders of a very common
passage), the windows are told apart one by one: equal ones (by md5) are counted, and the first found, in a grouped
aggregation. So no task holds more than CROWD contexts of one key. Equal blocks are told by 64-bit hashes of their
content under the 64-bit hash of their anchor.

Edge cases: null text is empty; texts shorter than `length` have no window and nothing removed. Matches never cross
documents; a repeat inside one document counts. Repeated rows are rows of their own. An empty table gives an empty
one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, replaced, small_batches, table, with_length, with_rid, written

LENGTH, GRAM = 200, 40
#: Text that a task gathers before it collapses equal blocks; bytes put in suffix order at once.
CHUNK_BYTES, ORDER_BYTES = 24 << 20, 2 << 20
#: Differing blocks of one fingerprint from which it is split, and window starts of such a split.
HOT_BLOCKS, HOT_STARTS = 512, 8
#: Contexts of a split key above which its windows are told apart one by one.
CROWD = 4096
SEGMENT = 1 << 19
_POS = np.uint64((1 << 20) - 1)
_LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base's powers 0..n-1 and their inverses, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = 1 << max(14, (n - 1).bit_length())
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def blocks(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(fingerprint, content hash, first start, last start, anchor) of the blocks of windows with one anchor."""
    out = []
    for s in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[s : s + SEGMENT + length - 1]
        n, w = len(part), length - gram + 1
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(part, np.uint8)] * up[:n], out=sums[1:])
        h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        low = h & ~_POS | np.arange(len(h), dtype=np.uint64)  # of equals the leftmost
        step = 1
        while 2 * step <= w:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if w > step:
            low = np.minimum(low[: step - w], low[w - step :])
        at = (low & _POS).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.append(first[1:] - 1, len(at) - 1)
        at = at[first]
        content = (sums[last + length] - sums[first]) * down[first]
        shape = ((at - first) << 20 | (last - first)).astype(np.uint64)
        out.append((h[at], mix(content ^ mix(shape + np.uint64(1))), first + s, last + s, at + s))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    f, c, *rest = (np.concatenate(x) for x in zip(*out))
    return (f.view(np.int64), c.view(np.int64), *rest)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows in the order of their bytes (ties by index), and each one's match with the one before: length or 0.

    Ranks of 8, 16, 32, ... bytes at every position, each from pairs of the last; the window's rank from two that cover it.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    size = 8
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while 2 * size <= length:
        ahead = np.zeros(n, np.uint64)
        ahead[: n - size] = rank[size:]
        rank = np.unique(rank << np.uint64(32) | ahead, return_inverse=True)[1].astype(np.uint64)
        size *= 2
    key = rank[starts] << np.uint64(32) | rank[starts + length - size]
    order = np.argsort(key, kind="stable")
    key = key[order]
    match = np.zeros(len(order), np.int64)
    match[1:] = np.where(key[1:] == key[:-1], length, 0)
    return order, match


def previous_factors(order: np.ndarray, match: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest match of each window with one of smaller position: that of its previous or next smaller position in suffix order.

    match holds what neighbours in the order have in common. Stretches of windows without any match are skipped.
    """
    found = np.zeros(len(order), np.int64)
    live = match > 0
    live[:-1] |= match[1:] > 0
    where = np.flatnonzero(live)
    for way in (1, -1):  # previous, then next smaller position
        stack: list[tuple[int, int]] = []  # (position, common with the one pushed after it or now looked at)
        for k in (where if way == 1 else where[::-1]).tolist():
            common = int(match[k]) if way == 1 else int(match[k + 1]) if k + 1 < len(match) else 0
            if not common:
                stack.clear()
            i = int(order[k])
            here, least = int(position[i]), common
            while stack and stack[-1][0] >= here:
                least = min(least, stack.pop()[1])
            if stack and least > found[i]:
                found[i] = least
            stack.append((here, least))
    return found


def repeats(texts: list[bytes], firsts: list[int], rank: np.ndarray, length: int, keep: str) -> list[tuple[int, int, int]]:
    """(context, first start, last start) of the runs of windows that repeat. rank: the contexts' order of precedence."""
    sizes = np.array([len(t) for t in texts])
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    order, match = suffix_order(np.frombuffer(b"".join(texts), np.uint8), offset[owner] + inner, length)
    position = np.argsort(np.argsort(rank[owner], kind="stable"), kind="stable")
    hit = previous_factors(order, match, position) >= length
    if keep == "none":
        hit |= previous_factors(order, match, -position) >= length
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) > 0)) + 1
    return [(int(owner[a]), int(inner[a]) + firsts[owner[a]], int(inner[b]) + firsts[owner[b]]) for a, b in zip(at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)])]


_FIELDS = ["fp", "content", "ord", "rid", "first", "last", "anchor", "many", "blocks"]
_KIND = "fp long, content long, ord long, rid long, first long, last long, anchor long, many boolean, blocks long"


def _batch(cols: list[np.ndarray]):
    return pa.record_batch([pa.array(c) for c in cols], names=_FIELDS)


def _collapse(cols: list[np.ndarray], both: bool) -> tuple[np.ndarray, ...]:
    """Of rows sorted by (fp, content, precedence): is it its block's first, has the block more, blocks of the fingerprint."""
    fp, content, many = cols[0], cols[1], cols[7]
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (fp[1:] != fp[:-1]) | (content[1:] != content[:-1])
    start = np.flatnonzero(new)
    rows = np.diff(np.append(start, n))
    more = (rows > 1) | np.bitwise_or.reduceat(many.astype(np.uint8), start).astype(bool)
    per = np.zeros(n, np.int64)
    if both:
        group = np.ones(len(start), bool)
        group[1:] = fp[start][1:] != fp[start][:-1]
        g = np.flatnonzero(group)
        per[start] = np.repeat(np.diff(np.append(g, len(start))), np.diff(np.append(g, len(start))))
    many = np.zeros(n, bool)
    many[start] = more
    return new, many, per


def removed_spans(numbered: DataFrame, length: int = LENGTH, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", rid: str = "_rid", crowd: int = CROWD) -> DataFrame:
    """(rid, spans): for each row with repeats the window starts (first, last) that repeat. numbered: rows with their number in the column rid, the same on every scan."""
    spark = numbered.sparkSession
    small_batches(spark)
    rows = numbered.select(F.col(text_col), F.col(rid).alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"))

    def find(batches):
        held, size = [], 0

        def collapsed():
            cols = [np.concatenate(c) for c in zip(*held)]
            by = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
            cols = [c[by] for c in cols]
            cols += [np.zeros(len(by), bool), np.zeros(len(by), np.int64)]
            new, many, _ = _collapse(cols, False)
            cols[7] = many
            cols[8] = np.where(new, 0, -1)  # -1: a later copy, found for good
            cols[0] = np.where(new, cols[0], cols[3] * 0x9E3779B1 + cols[4])  # spread these over all tasks
            for k in range(0, len(by), 100_000):
                yield _batch([c[k : k + 100_000] for c in cols])

        for b in batches:
            for rid, first, text in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode() if text else b""
                if len(data) < length:
                    continue
                f, c, lo, hi, at = blocks(data, length)
                held.append((f, c, np.full(len(f), first), np.full(len(f), rid), lo, hi, at))
                size += len(data)
                if size > CHUNK_BYTES:
                    yield from collapsed()
                    held, size = [], 0
        if held:
            yield from collapsed()

    def meet(batches):
        rest = None

        def done(cols):
            gone = cols[8] == -1
            if gone.any():
                yield _batch([c[gone] for c in cols])
                cols = [c[~gone] for c in cols]
            if not len(cols[0]):
                return
            new, many, per = _collapse(cols, True)
            cols[7] = many
            later = ~new
            out = [later, new & many] if keep == "none" else [later]
            for mask in out:
                if mask.any():
                    yield _batch([*(c[mask] for c in cols[:8]), np.full(mask.sum(), -1)])
            differ = new & (per > 1)
            if differ.any():
                yield _batch([*(c[differ] for c in cols[:8]), per[differ]])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [c[cut:] for c in cols]
            if cut:
                yield from done([c[:cut] for c in cols])
        if rest is not None:
            yield from done(rest)

    found = rows.select("rid", "ord", text_col).mapInArrow(find, _KIND)
    met = written(found.repartition("fp").sortWithinPartitions("fp", "content", "ord", "rid", "first").mapInArrow(meet, _KIND), "repeats")
    sure = met.where("blocks = -1").select("rid", "first", "last")

    # texts of the blocks that differ from others of their fingerprint
    wanted = met.where("blocks > 0").groupBy("rid").agg(F.collect_list(F.struct("fp", "ord", "first", "last", "anchor", "blocks")).alias("w"))
    packed = rows.select("rid", text_col).mapInArrow(_squeeze, "rid long, z binary")

    def cut_out(batches):
        z = zstandard.ZstdDecompressor()
        names = ["key", "ord", "rid", "first", "context"]
        for b in batches:
            for rid, zipped, want in zip(*(c.to_pylist() for c in b.columns)):
                data, out = _plain(z, zipped), []
                for x in want:
                    lo, hi, at = x["first"], x["last"], x["anchor"]
                    if x["blocks"] <= HOT_BLOCKS:
                        out.append((x["fp"], x["ord"], rid, lo, data[lo : hi + length]))
                        continue
                    # starts dealt by their distance to the anchor, then by the bytes that all of them share
                    for near in range((at - hi) // HOT_STARTS, (at - lo) // HOT_STARTS + 1):
                        a, z_ = max(lo, at - (near + 1) * HOT_STARTS + 1), min(hi, at - near * HOT_STARTS)
                        core = data[at - near * HOT_STARTS : at - (near + 1) * HOT_STARTS + 1 + length]
                        key = hashlib.blake2b(core, digest_size=8, salt=near.to_bytes(8, "little")).digest()
                        out.append((int.from_bytes(key, "little", signed=True), x["ord"], rid, a, data[a : z_ + length]))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()])], names=names)

    contexts = packed.join(wanted, "rid").select("rid", "z", "w").mapInArrow(cut_out, "key long, ord long, rid long, first long, context binary")
    contexts = written(contexts, "contexts")
    crowded = written(contexts.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    alone = None
    if not crowded.isEmpty():
        alone = _single_windows(contexts.join(crowded, "key", "left_semi"), length, keep)
        contexts = contexts.join(crowded, "key", "left_anti")

    def order(batches):
        held, size, key = [], 0, None

        def run():
            by = sorted(range(len(held)), key=lambda i: held[i][1:4])
            rank = np.empty(len(held), np.int64)
            rank[by] = np.arange(len(held))
            hits = repeats([h[4] for h in held], [h[3] for h in held], rank, length, keep)
            if hits:
                yield pa.record_batch([pa.array([held[o][2] for o, _, _ in hits], pa.int64()), pa.array([a for _, a, _ in hits], pa.int64()), pa.array([b for _, _, b in hits], pa.int64())], names=["rid", "first", "last"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != key and size > ORDER_BYTES:
                    yield from run()
                    held, size = [], 0
                key = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield from run()

    contexts = contexts.select("key", "ord", "rid", "first", "context")
    ordered = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(order, "rid long, first long, last long")
    found = sure.unionByName(ordered)
    return (found.unionByName(alone) if alone else found).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _single_windows(contexts: DataFrame, length: int, keep: str) -> DataFrame:
    """(rid, first, last) of the windows of contexts that repeat, found window by window: equal ones are counted in part before they meet."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("context") - length)).alias("i")
    windows = contexts.select("ord", "rid", "first", "context", at).select(F.expr(f"md5(substring(context, i + 1, {length}))").alias("w"), F.struct("ord", "rid", (F.col("first") + F.col("i")).alias("first")).alias("x"))
    many = windows.groupBy("w").agg(F.count("*").alias("c"), F.min("x").alias("least")).where("c > 1")
    again = windows.join(many, "w")
    if keep == "first":
        again = again.where("x <> least")
    return again.select("x.rid", "x.first", F.col("x.first").alias("last"))


def _squeeze(batches):
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([z.compress(t.encode() if t else b"") for t in b.column(1).to_pylist()], pa.binary())], names=["rid", "z"])


def _plain(z, zipped: bytes) -> bytes:
    return z.decompress(zipped, max_output_size=max(1, zstandard.frame_content_size(zipped)))


def covered(n: int, spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of removed bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["last"] + length) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept BINARY) of each row: its bytes without the removed runs."""
    rows = with_rid(docs.select(id_col, text_col), "_rid")
    spans = removed_spans(rows, length, keep, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([z.compress(t.encode() if t else b"") for t in b.column(2).to_pylist()], pa.binary())], names=["rid", "id", "z"])

    def apply(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for zipped, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = _plain(z, zipped)
                runs = covered(len(data), found, length)
                out.append((len(data), sum(e - s for s, e in runs), len(runs), kept(data, runs)))
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, [pa.int64()] * 3 + [pa.binary()]))], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    packed = rows.select(F.col("_rid").alias("rid"), F.col(id_col).alias("id"), text_col).mapInArrow(squeeze, f"rid long, id {kind}, z binary")
    return packed.join(spans, "rid", "left").select("id", "z", "spans").mapInArrow(apply, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def kept_text(text: str, spans: list[dict] | None, length: int) -> str:
    """The text without the removed runs; a character stays if any of its bytes does."""
    data = text.encode()
    runs = covered(len(data), spans, length)
    whole = []
    for a, b in runs:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        whole.append((a, b))
    return kept(data, whole).decode()


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with the repeats removed from the text."""
    names = docs.columns
    rid, found = free_name(names, "_rid"), free_name(names, "_spans")
    rows = with_rid(docs, rid)
    spans = removed_spans(rows, length, keep, id_col, text_col, rid).withColumnsRenamed({"rid": rid, "spans": found})

    def apply(batches):
        for b in batches:
            texts = [kept_text(t, s, length) if t and s else t for t, s in zip(b.column(text_col).to_pylist(), b.column(found).to_pylist())]
            yield replaced(b, text_col, texts).select(names)

    return with_length(rows.join(spans, rid, "left").drop(rid).mapInArrow(apply, docs.schema), text_col)


def op8_suffix(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
