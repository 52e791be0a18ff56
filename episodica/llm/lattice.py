"""Language-model scores by the lattice of all subword segmentations.

The pieces and scores of an existing vocabulary file set the weights; one round of expected counts over the training
words fits them to the corpus. A word's lattice probability sums over every way to cut it into pieces (a piece that
starts a word carries the word mark), by forward recursion in log space. Whole training words are pieces of their own:
their discounted counts hold the rest of the probability, and the lattice gets the discounted mass, so
P(word) = max(c - D, 0) / N + D * V / N * lattice(word), P(end) = c / N.

Texts are read in blocks. A block puts out its distinct words with their training counts, and its documents as word
numbers; words are counted and scored once for the whole corpus, and go back to the blocks they came from.

Edge cases: null, empty and blank texts are their end token alone. Letters outside the vocabulary are spelled in byte
pieces, so every word has a probability above zero. Without training rows N is 0 and both parts of the model have
half the mass. Repeated rows are scored row by row and count as often. An empty table gives an empty one. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, small_batches, table, written

#: Text of a block, discount of a training word's count, weight of the file's scores against the expected counts.
BLOCK_BYTES, DISCOUNT, PRIOR = 24 << 20, 0.75, 1000.0
MARK = "▁"
#: Words sorted together, so that they share the recursion of their prefixes; log below which a forward sum is rescaled.
SORTED_WORDS, RESCALED = 200_000, -230.0
#: Distinct words of a task that scores them.
WORDS_OF_TASK = 100_000


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case, in UTF-8: bytes know the six ASCII white-space characters only."""
    return text.encode().lower().split()


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def file_weights(path: str) -> dict[str, float]:
    """Natural-log weights of the file's pieces. Its scores are ranks (0, -1, -2, ...): weights fall with the rank; byte pieces are alike and rare."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_unknown(i) or sp.is_control(i)):
            raw[sp.id_to_piece(i)] = 1e-7 if sp.is_byte(i) else 1.0 / (3.0 - sp.get_score(i))
    total = sum(raw.values())
    return {k: math.log(v / total) for k, v in raw.items()}


class Lattice:
    """Forward and backward recursions over the segmentations of a word."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.longest = max((len(k) for k in weights if not (len(k) == 6 and k.startswith("<0x"))), default=1)
        self.starts = min(weights.values(), default=-20.0)

    def spelled(self, letter: str) -> list[str]:
        return [f"<0x{b:02X}>" for b in letter.encode("utf-8", "surrogatepass")]

    def arcs(self, s: str) -> list[list[tuple[int, float]]]:
        """For each end the (start, weight) of the pieces that end there; letters without a piece are spelled in bytes."""
        get, most, out = self.weights.get, self.longest, []
        for end in range(1, len(s) + 1):
            own = []
            for start in range(max(0, end - most), end):
                w = get(s[start:end])
                if w is not None:
                    own.append((start, w))
            if not own or own[-1][0] != end - 1:
                own.append((end - 1, sum(get(b, self.starts) for b in self.spelled(s[end - 1]))))
            out.append(own)
        return out

    @staticmethod
    def total(terms: list[float]) -> float:
        if len(terms) == 1:
            return terms[0]
        top = max(terms)
        return top + math.log(sum([math.exp(t - top) for t in terms]))

    def forward(self, arcs) -> list[float]:
        alpha = [0.0]
        for own in arcs:
            alpha.append(self.total([alpha[start] + w for start, w in own]))
        return alpha

    def log_probability(self, word: str) -> float:
        """Natural log of the word's probability, over all its segmentations."""
        return self.forward(self.arcs(MARK + word))[-1]

    def new_arcs(self, s: str, end: int) -> list[tuple[int, str]]:
        """(start, piece) of the pieces that end at a place; an empty piece for a letter spelled in bytes."""
        weights = self.weights
        own = [(start, s[start:end]) for start in range(max(0, end - self.longest), end) if s[start:end] in weights]
        if not own or own[-1][0] != end - 1:
            own.append((end - 1, ""))
        return own

    def log_probabilities(self, words: list[str]) -> list[float]:
        """log_probability of sorted words; what a word shares with the one before is not computed again."""
        get, starts, before, alpha, out = self.weights.__getitem__, self.starts, "", [0.0], []
        for word in words:
            s = MARK + word
            shared, most = 0, min(len(before), len(s))
            while shared < most and before[shared] == s[shared]:
                shared += 1
            del alpha[shared + 1 :]
            for end in range(shared + 1, len(s) + 1):
                terms = [alpha[start] + (get(piece) if piece else sum(self.weights.get(b, starts) for b in self.spelled(s[start]))) for start, piece in self.new_arcs(s, end)]
                alpha.append(self.total(terms))
            out.append(alpha[-1])
            before = s
        return out

    def expect(self, word: str, count: float, into: dict[str, float]) -> None:
        """Add the expected number of each piece in count occurrences of the word."""
        s = MARK + word
        arcs = self.arcs(s)
        alpha, n = self.forward(arcs), len(s)
        beta: list = [None] * n + [0.0]
        reach: list[list[float]] = [[] for _ in range(n)]
        for end in range(n, 0, -1):
            if end < n:
                beta[end] = self.total(reach[end])
            b = beta[end]
            for start, w in arcs[end - 1]:
                reach[start].append(b + w)
                share = count * math.exp(alpha[start] + w + b - alpha[n])
                piece = s[start:end]
                for p in [piece] if piece in self.weights else self.spelled(piece):
                    into[p] += share

    def expect_all(self, rows: list[tuple[str, int]], into: dict[str, float]) -> None:
        """Expected pieces of sorted (word, count) rows, in one walk of their trie.

        A node's forward sum is shared by all words through it. On the way back a node hands on, over each arc, the
        summed count / probability of the words below it, so every arc of the trie is looked at once for all words.
        Forward sums are linear, times exp(scale) of their node: where one would fall below exp(RESCALED), and where
        the scales of its arcs' starts differ, it is summed in log space. An arc's weight takes up the difference.
        """
        linear = {k: math.exp(v) for k, v in self.weights.items()}
        low, least = math.exp(self.starts), math.exp(RESCALED)
        before, alpha, arcs, below = "", [1.0], [[]], [0.0]  # of the nodes on the present path
        scale, since = [0.0], [0]  # log of a node's unit, and the first node from which on it is the same

        def back(to: int) -> None:
            while len(alpha) > to + 1:
                b = below.pop()
                for start, piece, w in arcs.pop():
                    below[start] += w * b
                    share = alpha[start] * w * b
                    if piece in linear:
                        into[piece] += share
                    else:
                        for p in self.spelled(piece):
                            into[p] += share
                alpha.pop()
                scale.pop()
                since.pop()

        def rescaled(s: str, own: list[tuple[int, str]]) -> tuple[float, float, list]:
            logs = [self.weights[piece] if piece else sum(self.weights.get(b, self.starts) for b in self.spelled(s[start])) for start, piece in own]
            total = self.total([math.log(alpha[start]) + scale[start] + w for (start, _), w in zip(own, logs)])
            unit = scale[-1] if abs(total - scale[-1]) < -RESCALED else total
            return math.exp(total - unit), unit, [(start, piece or s[start], math.exp(w + scale[start] - unit)) for (start, piece), w in zip(own, logs)]

        for word, count in rows:
            s = MARK + word
            shared, most = 0, min(len(before), len(s))
            while shared < most and before[shared] == s[shared]:
                shared += 1
            back(shared)
            for end in range(shared + 1, len(s) + 1):
                found, unit, first, a = self.new_arcs(s, end), scale[-1], since[-1], 0.0
                if first <= found[0][0]:
                    own = [(start, piece, linear[piece]) if piece else (start, s[start:end], math.prod(linear.get(b, low) for b in self.spelled(s[start]))) for start, piece in found]
                    a = sum([alpha[start] * w for start, _, w in own])
                if a < least:
                    a, unit, own = rescaled(s, found)
                    first = first if unit == scale[-1] else end
                arcs.append(own)
                alpha.append(a)
                scale.append(unit)
                since.append(first)
                below.append(0.0)
            below[-1] += count / alpha[-1]
            before = s
        back(0)


def blocks_of(docs: DataFrame, held: F.Column, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Written blocks: kind w (block, at, word, c) a distinct word and its training count; kind d the block's documents."""

    def cut(batches):
        from pyspark import TaskContext

        z, block = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 24
        index, ids, out, sizes, numbers, size = {}, [], [], [], [], 0

        def flush():
            n = len(index)
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
            train = np.repeat(~np.array(out, bool), np.array(sizes, np.int64))
            c = np.bincount(flat[train], minlength=n)
            words = list(index)
            for k in range(0, n, 50_000):
                m = min(50_000, n - k)
                yield pa.record_batch([pa.array(["w"] * m), pa.array(np.full(m, block)), pa.array(np.arange(k, k + m)), pa.array(words[k : k + m], pa.binary()), pa.array(c[k : k + m].astype(np.int64)), *[pa.nulls(m, t) for t in types[5:]]], names=names)
            yield pa.record_batch([pa.array(["d"]), pa.array([block], pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([n], pa.int64()), pa.array([ids], types[5]), pa.array([out], types[6]), pa.array([sizes], types[7]), pa.array([z.compress(flat.astype(np.int32).tobytes())], pa.binary())], names=names)

        for b in batches:
            for key, is_held, text in zip(*(c.to_pylist() for c in b.columns)):
                ws = words_of(text) if text else []
                ids.append(key)
                out.append(is_held)
                sizes.append(len(ws))
                numbers.append(np.array([index.setdefault(w, len(index)) for w in ws], np.int32))
                size += len(text or "")
                if size > block_bytes:
                    yield from flush()
                    block += 1
                    index, ids, out, sizes, numbers, size = {}, [], [], [], [], 0
        if ids:
            yield from flush()

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["kind", "block", "at", "word", "c", "ids", "held", "sizes", "numbers"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(_arrow(docs.schema[id_col].dataType)), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
    found = docs.select(id_col, held.alias("held"), text_col).mapInArrow(cut, f"kind string, block long, at long, word binary, c long, ids array<{kind}>, held array<boolean>, sizes array<long>, numbers binary")
    return written(found, "blocks", "kind")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _sorted_runs(batches):
    """Words (decoded) and counts of several batches at a time, in order of the words."""
    held, size = [], 0
    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        size += b.num_rows
        if size >= SORTED_WORDS:
            held.sort()
            yield [w.decode() for w, _ in held], [c for _, c in held]
            held, size = [], 0
    if held:
        held.sort()
        yield [w.decode() for w, _ in held], [c for _, c in held]


def _packed(batches):
    """Rows of (block, at, n, lat) as one row of packed arrays for each block, some millions at a time."""
    held, size = [], 0

    def flush():
        cols = [np.concatenate(c) for c in zip(*held)]
        by = np.argsort(cols[0], kind="stable")
        block = cols[0][by]
        cut = np.flatnonzero(np.diff(block)) + 1
        packed = [[x.tobytes() for x in np.split(c[by], cut)] for c in cols[1:]]
        for i, k in enumerate(block[np.append(0, cut)]):
            yield pa.record_batch([pa.array([k], pa.int64()), *(pa.array([x[i]], pa.binary()) for x in packed)], names=["block", "at", "n", "lat"])

    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
        if size > 3_000_000:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def fitted(counts: DataFrame, start: dict[str, float], prior: float = PRIOR) -> dict[str, float]:
    """Piece weights after one round of expected counts over all training words."""
    shared = counts.sparkSession.sparkContext.broadcast(start)  # the vocabulary file's pieces

    def expect(batches):
        lattice, into = Lattice(shared.value), defaultdict(float)
        for words, counts_ in _sorted_runs(batches):
            lattice.expect_all(list(zip(words, counts_)), into)
        yield pa.record_batch([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.float64())], names=["piece", "n"])

    found = counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece at most
    seen = {r["piece"]: r["n"] for r in found}
    total = sum(seen.values()) + prior
    return {k: math.log((seen.get(k, 0.0) + prior * math.exp(v)) / total) for k, v in start.items()}


def score(docs: DataFrame, held: F.Column, path: str, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document; rows that held marks are not learned from."""
    spark = docs.sparkSession
    small_batches(spark, 4096)
    blocks = blocks_of(docs, held, id_col, text_col, block_bytes)
    words = blocks.where("kind = 'w'").select("block", "at", "word", "c")
    counts = written(words.groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n_words, v_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count("*")).first()
    # even tasks in number to the distinct words, each of a range of words, which share prefixes
    counts = counts.repartitionByRange(max(1, -(-distinct // WORDS_OF_TASK)), "word")
    ends = docs.select(F.count(F.when(~held, 1))).first()[0]
    n, v = n_words + ends, v_words + (ends > 0)
    weights = spark.sparkContext.broadcast(fitted(counts, file_weights(path)))

    def weigh(batches):
        lattice = Lattice(weights.value)
        for words_, counts_ in _sorted_runs(batches):
            lat = lattice.log_probabilities(words_)
            for k in range(0, len(words_), 20_000):
                part = slice(k, k + 20_000)
                yield pa.record_batch([pa.array([w.encode() for w in words_[part]], pa.binary()), pa.array(counts_[part], pa.int64()), pa.array(lat[part], pa.float64())], names=["word", "n", "lat"])

    scored = counts.select("word", "c").mapInArrow(weigh, "word binary, n long, lat double")
    known = words.select("block", "at", "word").join(scored, "word").select("block", "at", "n", "lat").mapInArrow(_packed, "block long, at binary, n binary, lat binary")
    whole = blocks.where("kind = 'd'").select("block", "c", "ids", "held", "sizes", "numbers")
    parts = known.groupBy("block").agg(F.collect_list(F.struct("at", "n", "lat")).alias("parts"))  # one for each task and block at most
    rest = discount * v_words / n if n else 0.5
    log_rest = math.log(rest) if rest else -math.inf
    end_base = math.log10((ends + 1) / (n + v + 1))
    end_own = math.log10(ends / n) if ends else math.log10(0.5)

    def finish(batches):
        z, doc, c, lat = zstandard.ZstdDecompressor(), None, None, None

        def done():
            sizes = np.array(doc[2], np.int64)
            flat = np.frombuffer(z.decompress(doc[3], max_output_size=max(1, 4 * int(sizes.sum()))), np.int32)
            base = np.log10((c + 1) / (n + v + 1))
            with np.errstate(divide="ignore"):
                own = np.logaddexp(np.log(np.maximum(c - discount, 0) / max(n, 1)), log_rest + lat) / math.log(10)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            seen = np.concatenate([[0], np.cumsum((c > 0)[flat])])
            known_ = seen[cuts[1:]] - seen[cuts[:-1]] + (ends > 0)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            b_score = np.bincount(owner, base[flat], len(sizes)) + end_base
            o_score = np.bincount(owner, own[flat], len(sizes)) + end_own
            m = len(sizes)
            yield pa.record_batch([pa.array(doc[0], out_type), pa.array(doc[1], pa.bool_()), pa.array(sizes + 1), pa.array(known_.astype(np.int64)), pa.array(np.full(m, n, np.int64)), pa.array(b_score), pa.array(o_score)], names=names)

        for b in batches:
            for row in b.to_pylist():
                doc = (row["ids"], row["held"], row["sizes"], row["numbers"])
                c, lat = np.zeros(row["c"], np.int64), np.zeros(row["c"])
                for part in row["parts"] or ():
                    at = np.frombuffer(part["at"], np.int64)
                    c[at], lat[at] = np.frombuffer(part["n"], np.int64), np.frombuffer(part["lat"], np.float64)
                yield from done()

    kind = docs.schema[id_col].dataType.simpleString()
    out_type = _arrow(docs.schema[id_col].dataType)
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))  # a row is a block
    return whole.join(parts, "block", "left").mapInArrow(finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def op9_lattice(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_of("doc_id") % 7 == 2, vocabulary())
