"""Exact components of documents linked by word-shingle Jaccard similarity.

Shingle sets are ordered by (frequency of the frequent shingles, hash), and each puts the prefix that any linked
partner must meet into inverted lists. Equal word sequences are one class. Lists are read in blocks: a block has a lead set, and
entries whose size and position cannot reach the threshold with it skip to the next block. Every entry is checked
against its block's lead only; checked links give first components. What is left are pairs of components that meet in
a list. Sizes, positions and parity sketches of the sets (whose bits differ in no more places than the sets do) rule
out most of them. The leaders of the others are checked, and the answers of all other members are derived from the
leaders' and from each member's distance to its own leader (Jaccard distance is a metric): only if these leave a link
possible are the members themselves paired by size and position and checked. No pair is lost, and no group is expanded
into all its pairs. Lists of more than LIST_MOST entries are dealt over a grid of tasks, each of which holds two parts.

Edge cases: words are lower-cased in A-Z; a text with fewer words than a shingle is one shingle; null, empty and blank
texts have no shingle and link with nothing. A component's id is its smallest document id (null if it has none); rows
with a null id or repeated rows link as any other. An empty table gives an empty one. Other columns are ignored.
Shingles and word sequences are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, removed, small_batches, table, with_rid, written
from .suffix import _BYTE, _plain, mix, powers

#: Text gathered by a task before equal sets are collapsed and frequent shingles counted.
CHUNK_BYTES = 24 << 20
#: A shingle counts as frequent from this many sets in a chunk; so many of the most frequent order the lists (any bound is right, it only moves work).
FREQUENT, FREQUENT_MOST = 3, 1 << 19
#: Leads of a list that an entry is tried against before it leads a block of its own.
LEADS = 8
#: Orders in which lists are read: a set meets leads of so many different orders, so large groups of near copies join early.
ORDERS = 4
#: Entries of a list that one task holds; longer lists are dealt over the cells of a grid.
LIST_MOST = 4096
#: Bytes of sets that a task keeps while it checks pairs.
CACHE_BYTES = 32 << 20
#: Rounds in which components that may link are tried by single members before all members are.
ROUNDS = 4


def normal(text: str | None) -> bytes:
    """The text's words with A-Z in lower case, one space between two of them, in UTF-8."""
    return b" ".join(text.encode().lower().split()) if text else b""


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a normal text."""
    if not data:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(data, np.uint8)
    n = len(codes)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[codes] * up[:n], out=sums[1:])
    gaps = np.flatnonzero(codes == 32)
    start, end = np.append(0, gaps + 1), np.append(gaps, n)
    k = min(words, len(start))
    start, end = start[: len(start) - k + 1], end[k - 1 :]
    return np.unique(mix((sums[end] - sums[start]) * down[start]))


def text_id(data: bytes) -> int:
    """Number of a normal text, by which its set goes."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles of each of 512 hash classes, or of a multiple of them for larger sets.

    Sketches of two sets differ in no more bits than the sets do in shingles; a longer one folds to half its length.
    """
    bits = 512 << max(0, (len(s) - 1).bit_length() - 9)
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit words, all as long as the shortest."""
    rows, least = [np.frombuffer(x, np.uint64) for x in sketches], min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(r.reshape(-1, least), 0) for r in rows])


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded."""
    if len(a) != len(b):
        return int(np.bitwise_count(np.bitwise_xor(*folded([a, b]))).sum())
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def prefix_size(n: int, percent: int) -> int:
    """Entries of a set of n that every partner at the threshold meets."""
    return n - -(-percent * n // 100) + 1


def reachable(na: int, pa_: int, nb: int, pb: int, percent: int) -> bool:
    """Can sets of these sizes link, if these are the positions of their first common entry?"""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    most = 1 + min(na - pa_ - 1, nb - pb - 1)
    return 100 * most >= percent * (na + nb - most)


def frequent_shingles(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """The most frequent shingles, from the counts of those that are frequent in a chunk; ordered from rare to frequent."""

    def count(batches):
        held, seen, size = [], set(), 0

        def flush():
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                often = c >= FREQUENT
                yield pa.record_batch([pa.array(h[often].view(np.int64)), pa.array(c[often])], names=["h", "c"])

        for b in batches:
            for text in b.column(0).to_pylist():
                data = normal(text)
                if data and (key := text_id(data)) not in seen:
                    seen.add(key)
                    s = shingles(data, words)
                    held.append(s)
                    size += 8 * len(s)
                    if size > 2 * CHUNK_BYTES:
                        yield from flush()
                        held, size = [], 0
                        seen.clear()
        yield from flush()

    top = docs.select(text_col).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT_MOST)
    found = top.toArrow()
    return found["h"].to_numpy()[::-1].view(np.uint64)


def entries(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(kind, key, cid, n, pos, id, lead, sketch): the documents (d, with the set's sketch), the entries of lists of two sets or more (l), and pairs to check (p)."""
    spark = docs.sparkSession
    often = frequent_shingles(docs, text_col, words)
    by_hash = np.argsort(often)
    shared = spark.sparkContext.broadcast((often[by_hash], by_hash.astype(np.int64)))  # at most FREQUENT_MOST
    names = ["kind", "key", "cid", "n", "pos", "id", "lead", "sketch"]
    kind = "kind string, key long, cid long, n long, pos long, id long, lead long, sketch binary"
    types = [pa.string(), *[pa.int64()] * 6, pa.binary()]

    def rows_of(cols):
        n = len(cols[1])
        return pa.record_batch([pa.array([cols[0]] * n, pa.string())] + [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(cols[1:], types[1:])], names=names)

    def index(batches):
        hashes, ranks = shared.value
        seen: dict = {}  # text -> size and sketch of its set
        size = 0
        for b in batches:
            cids, ns, ids, sketches, entry = [], [], [], [], []
            for key, text in zip(*(c.to_pylist() for c in b.columns)):
                data = normal(text)
                cid = text_id(data)
                known = seen.get(cid)
                if known is None:
                    s = shingles(data, words)
                    n = len(s)
                    size += len(data)
                    if size > CHUNK_BYTES:
                        seen, size = {}, 0
                    known = seen[cid] = (n, sketch(s) if n else None)
                    fresh = n > 0
                else:
                    fresh = False
                ids.append(key)
                cids.append(cid)
                ns.append(known[0])
                sketches.append(known[1])
                if fresh:
                    weight = np.zeros(n, np.int64)
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                        weight = np.where(hashes[at] == s, ranks[at] + 1, 0)
                    p = prefix_size(n, percent)
                    first = s[np.lexsort((s, weight))[:p]]
                    entry.append((first.view(np.int64), np.full(p, cid), np.full(p, n), np.arange(p)))
            spread = [c ^ (k or 0) * 0x9E3779B1 for c, k in zip(cids, ids)]  # the documents themselves may lie anywhere
            yield rows_of(["d", [((x + (1 << 63)) % (1 << 64)) - (1 << 63) for x in spread], cids, ns, None, ids, None, sketches])
            if entry:
                e = [np.concatenate(c) for c in zip(*entry)]
                yield rows_of(["l", *e, None, None, None])

    def lists(batches):
        key, held, leads, last = None, None, [], None
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] == "d":
                    out.append(row)
                else:
                    _, k, cid, n, pos, *_ = row
                    if k != key:
                        key, held, leads, last = k, row, [(cid, n, pos)], cid
                        continue
                    if cid == last:  # the same set from another task
                        continue
                    last = cid
                    if held is not None:
                        out.append(held)
                        held = None
                    out.append(row)
                    for c, m, q in leads:
                        if reachable(n, pos, m, q, percent):
                            out.append(("p", k, cid, None, None, None, c, None))
                            break
                    else:
                        if len(leads) < LEADS:
                            leads.append((cid, n, pos))
                if len(out) > 50_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    found = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(index, kind)
    order = F.xxhash64("cid", F.pmod("key", F.lit(ORDERS)))
    dealt = found.repartition("key").sortWithinPartitions("key", order, "cid")
    return written(dealt.mapInArrow(lists, kind), "lists")


def texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(cid, z): each wanted normal text, compressed."""

    def pack(batches):
        z, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                data = normal(text)
                if data and (cid := text_id(data)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(cid)
                    out.append((cid, z.compress(data)))
            yield pa.record_batch([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["cid", "z"])

    packed = docs.select(text_col).mapInArrow(pack, "cid long, z binary")
    return written(packed.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min("z").alias("z")), "texts")


def checked(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, common, total): sizes of the intersection and the union of each pair's sets."""
    a = texts.select(F.col("cid").alias("a"), F.col("z").alias("za"))
    b = texts.select(F.col("cid").alias("b"), F.col("z").alias("zb"))

    def run(batches):
        z, cache, size = zstandard.ZstdDecompressor(), OrderedDict(), 0

        def get(cid, zipped):
            nonlocal size
            s = cache.get(cid)
            if s is None:
                s = cache[cid] = shingles(_plain(z, zipped), words)
                size += s.nbytes + 200
                while size > CACHE_BYTES and len(cache) > 1:
                    size -= cache.popitem(last=False)[1].nbytes + 200
            return s

        for batch in batches:
            ab, common, total = [batch.column(0), batch.column(1)], [], []
            for x, y, zx, zy in zip(*(c.to_pylist() for c in batch.columns)):
                s, t = get(x, zx), get(y, zy)
                n = len(np.intersect1d(s, t, assume_unique=True))
                common.append(n)
                total.append(len(s) + len(t) - n)
            yield pa.record_batch([*ab, pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])

    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long, common long, total long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the smallest node reachable. Alternating large and small stars."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", narrow=True)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        last, e = e, written(small, "edges", narrow=True)
        removed(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def linked_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each document: links are pairs with 100 * intersection >= percent * union."""
    small_batches(docs.sparkSession)
    found = entries(docs, words, percent, id_col, text_col)
    lists = found.where("kind = 'l'").select("key", "cid", "n", "pos")
    linked = F.expr(f"100 * common >= {percent} * total")

    texts = texts_of(docs, lists.select("cid").distinct(), text_col)
    pairs = found.where("kind = 'p'").select(F.greatest("cid", "lead").alias("a"), F.least("cid", "lead").alias("b")).distinct()
    first = written(checked(pairs, texts, words), "checked", narrow=True)
    comp = written(components(first.where(linked)), "components", narrow=True)

    # components that meet in a list, by sizes and positions; pairs already checked are settled
    named = lists.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_lists = written(named.join(mixed, "key"), "open", narrow=True)
    sketches = found.where("kind = 'd'").select("cid", "sketch").join(open_lists.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])
    meets = _meetings(open_lists, sketches, percent)
    settled = first.where(~linked).select("a", "b")
    leaders = meets.join(settled, ["a", "b"], "left_anti")
    met = written(checked(leaders, texts, words), "leaders", narrow=True)
    direct = met.where(linked).select("a", "b")
    merged = _joined(comp, direct)

    # answers derived from the leaders': what the distances cannot rule out is checked between the members
    apart = met.where(~linked).unionByName(first.where(~linked).join(meets, ["a", "b"], "left_semi"))
    members = comp.where("node <> comp").select(F.greatest("node", "comp").alias("a"), F.least("node", "comp").alias("b"), "node", "comp")
    known = first.select("a", "b", "common", "total")
    far = members.join(known, ["a", "b"], "left")
    rest = checked(far.where("total is null").select("a", "b"), texts, words)
    far = far.where("total is not null").select("node", "comp", "common", "total").unionByName(members.join(rest, ["a", "b"]).select("node", "comp", "common", "total"))
    far = written(far.select("node", "comp", F.expr("1 - common / total").alias("d")), "distances", narrow=True)
    radius = far.groupBy("comp").agg(F.max("d").alias("r"))
    gap = F.lit(1 - percent / 100 + 1e-9)
    close = (
        apart.join(radius.select(F.col("comp").alias("a"), F.col("r").alias("ra")), "a", "left")
        .join(radius.select(F.col("comp").alias("b"), F.col("r").alias("rb")), "b", "left")
        .withColumn("d", F.expr("1 - common / total"))
        .where(F.col("d") - F.coalesce("ra", F.lit(0.0)) - F.coalesce("rb", F.lit(0.0)) <= gap)
        .where("ra is not null or rb is not null")
    )
    close = _apart(close, merged).select("a", "b", "d")
    close = written(close, "close", narrow=True)
    own = open_lists.join(far.select(F.col("node").alias("cid"), "d"), "cid", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    involved = close.select(F.explode(F.array("a", "b")).alias("comp")).distinct()
    bits = F.transform(F.sequence(F.lit(1), F.octet_length("sketch") - 3, F.lit(4)), lambda i: F.conv(F.hex(F.substring("sketch", i, F.lit(4))), 16, 10).cast("long"))
    own = own.join(involved, "comp", "left_semi").join(sketches, "cid").withColumn("bits", bits).drop("sketch")
    own = written(own, "members")
    # first one member for each component and list, another one in each round; then, for what is still apart, all
    left = close.count()
    for turn in range(ROUNDS + 1):
        if not left:
            break
        now = close.select(F.explode(F.array("a", "b")).alias("comp")).distinct()
        members = own.join(now, "comp", "left_semi")
        if turn < ROUNDS:
            members = members.groupBy("key", "comp").agg(F.min_by(F.struct("cid", "n", "pos", "d", "bits"), F.xxhash64("cid", "key", F.lit(turn))).alias("m")).select("key", "comp", "m.*")
        tried = written(checked(_expanded(close, members, percent), texts, words), "checked", narrow=True)
        merged = _joined(merged, tried.where(linked).select("a", "b"))
        close = written(_apart(close, merged).select("a", "b", "d"), "close", narrow=True)
        left = close.count()
    comp = merged
    removed(texts, open_lists, own, first, met, far, meets)

    d = found.where("kind = 'd'").select("id", "n", "cid")
    d = d.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("id", "n", F.coalesce("comp", "cid").alias("comp"))
    least = d.where("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    out = d.join(least, "comp", "left")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that the components so far keep apart."""
    a = comp.select(F.col("node").alias("a"), F.col("comp").alias("_ca"))
    b = comp.select(F.col("node").alias("b"), F.col("comp").alias("_cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).drop("_ca", "_cb")


def _expanded(close: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of members of two components that meet in a list and that sizes, positions, sketches and distances allow."""
    x = members.select("key", *(F.col(c).alias(f"{c}1") for c in ("cid", "n", "pos", "comp", "d", "bits")))
    y = members.select("key", *(F.col(c).alias(f"{c}2") for c in ("cid", "n", "pos", "comp", "d", "bits")))
    differ = "aggregate(zip_with(bits1, bits2, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"  # of sketches of one length
    need = f"({percent} * (n1 + n2) + {99 + percent}) div {100 + percent}"
    common = "(1 + least(n1 - pos1 - 1, n2 - pos2 - 1))"
    return (
        close.join(x, close["a"] == x["comp1"])
        .join(y, (F.col("b") == F.col("comp2")) & (x["key"] == y["key"]))
        .where(F.col("d") - F.col("d1") - F.col("d2") <= 1 - percent / 100 + 1e-9)
        .where(f"100 * least(n1, n2) >= {percent} * greatest(n1, n2) and 100 * {common} >= {percent} * (n1 + n2 - {common})")
        .where(f"size(bits1) <> size(bits2) or {differ} <= n1 + n2 - 2 * ({need})")
        .select(F.greatest("cid1", "cid2").alias("a"), F.least("cid1", "cid2").alias("b"))
        .distinct()
    )


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between their nodes."""
    if links.isEmpty():
        return comp
    return written(components(links.unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))), "components", narrow=True)


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """One row of each component, and every row without shingles; all columns of docs."""
    rid = free_name(docs.columns, "_rid")
    rows = with_rid(docs, rid)
    found = linked_components(rows.select(rid, text_col), words, percent, rid, text_col)
    return rows.join(found.where(F.col("component_id") == F.col(rid)).select(rid), rid, "left_semi").drop(rid)


def _meetings(named: DataFrame, sketches: DataFrame, percent: int, list_most: int = LIST_MOST) -> DataFrame:
    """Distinct pairs (a > b) of components with entries in one list that sizes, positions and sketches do not rule out.

    A list is read by size; entries under the reach of the ones looked at are skipped for good. The entries of a long
    list fall into parts, and a cell of its grid gets two of them, or one.
    """
    fields = ["key", "row", "col", "part", "n", "pos", "comp", "sketch"]

    def pairs(rows, block):
        """(a, b) of the later rows of a list (of the same cell) with those before them and among themselves."""
        both = block + rows
        if len(both) <= 48:
            for i in range(len(block), len(both)):
                n, pos, comp, part, bits, across = both[i]
                for m, q, other, of, other_bits, _ in both[:i]:
                    if other == comp or across and of == part:
                        continue
                    need, most = -(-percent * (n + m) // (100 + percent)), min(n - pos, m - q)
                    if most >= need and 100 * m >= percent * n and apart(bits, other_bits) <= n + m - 2 * need:
                        yield max(comp, other), min(comp, other)
            return
        n, pos, comp, part = (np.array(c, np.int64) for c in list(zip(*both))[:4])
        words, old = folded([r[4] for r in both]), len(block)
        for i in range(old, len(both)):
            total = n[:i] + n[i]
            need = -(-percent * total // (100 + percent))  # least intersection
            most = np.minimum(n[:i] - pos[:i], n[i] - pos[i])  # if this is their first common entry
            fits = (most >= need) & (100 * n[:i] >= percent * n[i]) & (comp[:i] != comp[i])
            if rows[i - old][5]:  # a cell of two parts: pairs across them alone
                fits &= part[:i] != part[i]
            at = np.flatnonzero(fits)
            if len(at):
                differ = np.bitwise_count(words[at] ^ words[i]).sum(1).astype(np.int64)
                at = at[differ <= total[at] - 2 * need[at]]
                yield from zip(np.maximum(comp[at], comp[i]).tolist(), np.minimum(comp[at], comp[i]).tolist())

    def run(batches):
        cell, block, rows, made = None, [], [], set()

        def looked_at():
            nonlocal block, rows
            if rows:
                made.update(pairs(rows, block))
                block += rows
                least = percent * block[-1][0]
                block = [r for r in block if 100 * r[0] >= least]
                rows = []

        for b in batches:
            for k, r, c, part, n, pos, comp, bits in zip(*(x.to_pylist() for x in b.columns)):
                if (k, r, c) != cell:
                    looked_at()
                    cell, block = (k, r, c), []
                if len(rows) >= 1024 or rows and 100 * rows[0][0] < percent * n:  # of like sizes, as their sketches are folded to one
                    looked_at()
                rows.append((n, pos, comp, part, bits, r != c))
                if len(made) > 200_000:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*made)], names=["a", "b"])
                    made.clear()
        looked_at()
        if made:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*made)], names=["a", "b"])

    each = named.select("key", "cid", "n", "pos", "comp")
    parts = each.groupBy("key").count().select("key", F.expr(f"cast((count - 1) div {list_most} + 1 as int)").alias("parts"))
    dealt = each.join(parts, "key").join(sketches, "cid").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"), *fields[3:])
    sorted_ = cells.repartition("key", "row", "col").sortWithinPartitions("key", "row", "col", "n", "pos", "comp")
    return written(sorted_.select(*fields).mapInArrow(run, "a long, b long").distinct(), "meetings", narrow=True)


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), words=4, percent=85)
