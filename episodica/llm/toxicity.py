"""Toxicity of texts after noisy-channel deobfuscation.

A token that may be disguised is read as a lattice: each character may stand for itself, for the letters that it is
used for in leetspeak, for nothing (separators inside a word), or repeat the letter before. Viterbi decoding under a
character trigram model, counted over all training texts, finds the likeliest word. Tokens whose lattice has one path
are their own decoding. Spelled-out words (single letters with separators) are also read joined. The restored text is
scored by a logistic model over words and word beginnings.

White space is in the lattice too: it is dropped, or is a word boundary that the model scores. It is open where both
sides are single letters (or signs used for letters), and where the model, given the two letters on either side, takes
the joined letters to be likelier than the boundary. Tokens with open space between them are decoded in one, and each
restored word is read. Elsewhere the boundary wins for certain: with two letters or more in each word, what a space is
depends on no other space.

The classifier is fitted to at most `sample_rows` labelled rows, those of least hash of their id (of rows that share an
id, to one text), over the `FEATURES_MOST` features that tell toxic rows of that sample apart most surely; the character
model counts every training text. Labels, language, source and id are no features.

Edge cases: null, empty and unlabelled texts get a score; without any feature it is the share of toxic rows (0.5 if no
row is labelled). A document with several labels counts as toxic if one says so. Tokens of any length are decoded
whole. Repeated rows get equal scores. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, small_batches, table

#: Labelled rows that the classifier is fitted to at most, and features kept.
SAMPLE_ROWS, FEATURES_MOST, LEAST_DOCS = 30_000, 4096, 4
# Letters that a character is used for, and separators.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'"
EDGE = ".,;:!?\"'()[]{}<>*#%&$|…«»“”‘’-_~"
SPELLED = re.compile(r"(?<!\w)[^\W_](?:[ .\-_*~]{1,3}[^\W_](?!\w)){2,}")
SUSPECT = re.compile(r"[0-9@$!|+(€£.\-_*~']|(.)\1\1")
#: Costs (natural log) of a substitution, a dropped separator (or space between lone letters), a dropped repeat and any other dropped space.
COST_LEET, COST_DROP, COST_REPEAT, COST_SPACE = -1.5, -1.0, -0.7, -3.0
ALPHABET = "\0abcdefghijklmnopqrstuvwxyzàâäáãçéèêëíìîïñóòôöõúùûüßœæ"
KNOWN = frozenset(ALPHABET[1:])
#: Letters with one reading each: known ones, none of which comes twice in a row.
RUN = re.compile(rf"(?:([{ALPHABET[1:]}])(?!\1)){{3,}}")
DOUBLED, TRIPLED = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
CODE = {c: i for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 1  # the last is any other letter
_MAP = np.zeros(0x250, np.int64)
for _c, _i in CODE.items():
    _MAP[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _MAP[ord(_c.upper())] = _i

#: Letters that characters are used for, the first and the last of each, by code.
_OTHER = 0x20AD  # stands for all characters from it on
_SIGNS = [np.zeros(_OTHER + 1, np.int64), np.zeros(_OTHER + 1, np.int64)]
for _signs, _at in zip(_SIGNS, (0, -1)):
    _signs[: len(_MAP)] = _MAP
    for _c, _x in LEET.items():
        _signs[ord(_c)] = CODE[_x[_at]]
#: What a character adds to its word: 1 unless it is a separator or space, and 2^32 if it is or stands for a letter.
_ADDS = ((_SIGNS[0] > 0) | (np.arange(_OTHER + 1) >= len(_MAP))).astype(np.int64) << 32
_ADDS += 1
_ADDS[[ord(_c) for _c in SEPARATORS + " "]] -= 1
_LONE = (1 << 32) + 1


def trigrams(text: str) -> np.ndarray:
    """Counts of letter trigrams; whatever is no letter is one boundary."""
    u = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    x = np.where(u < len(_MAP), _MAP[np.minimum(u, len(_MAP) - 1)], 0)
    x = np.concatenate([[0, 0], x, [0]])
    keep = np.ones(len(x), bool)
    keep[2:] = (x[2:] != 0) | (x[1:-1] != 0)  # one boundary between words
    x = x[keep]
    x = np.concatenate([[0], x])
    return np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)


class CharModel:
    """Interpolated character trigram model."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SIZE)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.table = np.log(p3)
        self.log = self.table.tolist()
        self.options: dict = {}  # of the characters met

    def readings_of(self, ch: str) -> tuple[list, float | None, float | None]:
        """What a character may stand for, as (letter, cost, code), and the cost of dropping it inside a token and at its edges."""
        options = [(ch, 0.0 if ch.isalpha() or ch in " \n" else -6.0), *((x, COST_LEET) for x in LEET.get(ch, ""))]
        edge = COST_SPACE if ch == "\n" else None if ch.isalnum() else -8.0
        inside = COST_DROP if ch in SEPARATORS or ch == " " else edge
        return [(x, cost, 0 if x in " \n" else CODE.get(x, SIZE - 1)) for x, cost in options], inside, edge

    def restore(self, token: str) -> str:
        """Likeliest word behind a token, by Viterbi over its character lattice."""
        log, options_of, last = self.log, self.options, len(token) - 1
        # state: (last letter but one, last letter); value: (log probability, (text before, letters))
        states: dict = {(0, 0): (0.0, None)}
        i = -1
        while i < last:
            i += 1
            ch = token[i]
            found = options_of.get(ch)
            if found is None:
                found = options_of[ch] = self.readings_of(ch)
            options, inside, edge = found
            drop = inside if 0 < i < last else edge
            if len(states) == 1 and len(options) == 1 and drop is None:  # a letter in one context
                [((a, b), (score, text))] = states.items()
                if not text or text[1][-1] != ch:
                    if run := RUN.match(token, i):  # what one context has cost so far decides nothing
                        part, i = run[0], run.end() - 1
                        states = {(CODE[part[-2]], CODE[part[-1]]): (0.0, (text, part))}
                        continue
                    [(x, cost, k)] = options
                    states = {(b, k): (score + cost + log[a][b][k], (text, x))}
                    continue
            after: dict = {}
            for (a, b), (score, text) in states.items():
                row = log[a][b]
                for x, cost, k in options:
                    s = score + cost + row[k]
                    held = after.get((b, k))
                    if held is None or held[0] < s:
                        after[b, k] = (s, (text, x))
                # nothing: a separator, or the letter before once more
                none = drop
                if text and i and text[1][-1] == ch:
                    none = COST_REPEAT
                elif text and ch in LEET and text[1][-1] in LEET[ch]:
                    none = COST_LEET + COST_REPEAT
                if none is not None:
                    s = score + none
                    held = after.get((a, b))
                    if held is None or held[0] < s:
                        after[a, b] = (s, text)
            states = after
        text, out = max(states.items(), key=lambda kv: kv[1][0] + self.log[kv[0][0]][kv[0][1]][0])[1][1], []
        while text:
            text, x = text
            out.append(x)
        return "".join(reversed(out))


def spelled(low: str) -> list[str]:
    """Words spelled with separators, in one piece each."""
    if any(m in low for m in (" ", ".", "-", "_", "*", "~")):
        return [re.sub(r"[ .\-_*~]+", "", m[0]) for m in SPELLED.finditer(low)]
    return []


def tokens(text: str) -> list[str]:
    """Lower-case white-space tokens; words spelled with separators are added in one piece."""
    low = text.lower()
    return low.split() + spelled(low)


def tokens_and_spans(text: str, model: CharModel) -> set[str]:
    """The tokens, and those with open white space between them."""
    low = text.lower()
    words = low.split()
    return {*words, *spelled(low), *spans_of(words, model)}


def open_spans(text: str, model: CharModel) -> set[str]:
    """Tokens with open white space between them: a space between lone letters, a line feed elsewhere. None without letters."""
    return spans_of(text.lower().split(), model)


def spans_of(words: list[str], model: CharModel) -> set[str]:
    if len(words) < 2:
        return set()
    low = f" {' '.join(words)} "  # a boundary on either side
    small = np.frombuffer(low.encode(), np.uint8) if low.isascii() else np.minimum(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), _OTHER)
    space = np.flatnonzero(small == 32)
    gap = space[1:-1]
    is_open = np.zeros(len(gap), bool)
    t, near = model.table.ravel(), [small[gap + k] for k in (-2, -1, 1, 2)]
    for signs in _SIGNS if "1" in low or "|" in low else _SIGNS[:1]:
        a, b, c, d = (signs[x] for x in near)
        ab, cd = (a * SIZE + b) * SIZE, c * SIZE + d  # numbers of (a, b, boundary) and (boundary, c, d)
        is_open |= (b > 0) & (c > 0) & (COST_SPACE + t[ab + c] + t[b * SIZE**2 + cd] > t[ab] + t[b * SIZE**2 + c] + t[cd])
    alone = np.add.reduceat(_ADDS[small], space[:-1]) == _LONE
    lone = alone[1:] & alone[:-1]
    is_open |= lone
    at = np.flatnonzero(is_open)
    if not len(at):
        return set()
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    first, last = at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)] + 1
    marks = np.where(lone, " ", "\n").tolist()
    found = {words[i] + "".join([marks[k] + words[k + 1] for k in range(i, j)]) for i, j in zip(first.tolist(), last.tolist())}
    return {s for s in found if any(map(str.isalpha, s))}


def joined(span: str) -> str | None:
    """What a span restores to if its one open space is all that is open in it: two words of two letters or more, none of them doubled.

    The letters on either side decide such a space, and they made it open; so the letters come out joined. None for any
    other span.
    """
    a, mark, b = span.strip(EDGE).partition("\n")
    both = a + b
    if not mark or len(a) < 2 or len(b) < 2 or "\n" in b or not both.isalpha() or not KNOWN.issuperset(both) or DOUBLED.search(both):
        return None
    return both


def words_of_span(span: str, model: CharModel) -> set[str]:
    """Restored words of tokens with open white space, with and without the marks around them."""
    if (whole := joined(span)) is not None:
        return {whole}
    found: set[str] = set()
    for s in inner_forms(span):
        found.update(w.strip(EDGE) for w in model.restore(s).split())
    return found


def inner_forms(token: str) -> tuple[str, ...]:
    """The token without the marks around it, and with those of them that may stand for a letter."""
    inner = token.rstrip(".,;:?\"')]}>").lstrip("\"'([{<")
    core = inner.strip(EDGE)
    if core == inner:
        return (core,)
    before, _, after = inner.partition(core) if core else (inner, "", "")
    return (core, inner) if any(map(LEET.__contains__, before + after)) else (core,)


def plain_word(token: str) -> str | None:
    """The word that is a token's only reading, if it is letters alone (but for a mark at its end), none of them three times in a row."""
    word = token if token.isalpha() else token[:-1] if token[-1] in ".,;:?" and token[:-1].isalpha() else None
    return None if word is None or TRIPLED.search(word) else word


def readings(token: str, model: CharModel) -> set[str]:
    """The token's plain reading, and its restored one if its lattice has more than one path."""
    if (word := plain_word(token)) is not None:
        return {word}
    core = token.strip(EDGE)
    found = {core} if core else set()
    for t in inner_forms(token):
        if len(t) > 1 and SUSPECT.search(t) and any(map(str.isalpha, t)):
            found.add(model.restore(t))
    return found


def features(token: str, model: CharModel) -> set[str]:
    """Words (with = before them) and word beginnings of three to eight letters, of a token or a span of them."""
    return features_of(words_of_span(token, model) if " " in token or "\n" in token else readings(token, model))


def features_of(words) -> set[str]:
    out = set()
    for w in words:
        if len(w) > 1:
            out.add("=" + w)
            out.update([w[:k] for k in range(3, min(8, len(w)) + 1)])
    return out


def count_trigrams(docs: DataFrame, text_col: str) -> np.ndarray:
    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            if texts:
                total += trigrams("\n".join(texts))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(SIZE**3, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # SIZE**3 rows at most
        out[r["at"]] = r["n"]
    return out


def logistic(rows: list[list[int]], y: np.ndarray, n: int, steps: int = 400, l2: float = 1e-4) -> tuple[float, np.ndarray]:
    """Bias and weights by full-batch Adam over rows of present features."""
    w, b = np.zeros(n), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    if not len(y):
        return b, w
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.array([i for r in rows for i in r], np.int64)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(owner, w[flat], len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(flat, e[owner], n) + l2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:n], b - step[n]
    return b, w


class Scorer:
    """Fitted model of a worker, with a bounded cache of token features."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float], bias: float):
        self.model, self.weights, self.bias = CharModel(counts), weights, bias
        self.index = {f: i for i, f in enumerate(weights)}
        self.values = list(weights.values())
        # what a word must begin with to have any feature, or any but its first three letters
        self.stems, self.longer = ({f.removeprefix("=")[:k] for f in weights} for k in (3, 4))
        self.cache: dict[str, tuple[int, ...]] = {}
        self.none: set[str] = set()  # tokens without any feature

    def present(self, text: str | None) -> set[int]:
        found: set[int] = set()
        if not text:
            return found
        cache, none, stems = self.cache, self.none, self.stems
        if len(cache) + len(none) > 400_000:
            cache.clear()
            none.clear()
        for t in tokens_and_spans(text, self.model) - none:
            hit = cache.get(t)
            if hit is None:
                if t.isalpha() and t[:3] not in stems and not TRIPLED.search(t):
                    none.add(t)  # a plain word, its own reading
                    continue
                hit = self.features(t)
                if not hit:
                    none.add(t)
                    continue
                cache[t] = hit
            found.update(hit)
        return found

    def features(self, t: str) -> tuple[int, ...]:
        """Numbers of the features of a token or span."""
        stems, longer, at = self.stems, self.longer, self.index.get
        if " " in t or "\n" in t:
            words = words_of_span(t, self.model)
        elif (word := plain_word(t)) is not None:
            words = (word,)
        else:
            words = readings(t, self.model)
        hit = []
        for w in words:
            if len(w) > 1 and w[:3] in stems:
                if w[:4] in longer:
                    hit.append(at("=" + w))
                    hit += [at(w[:k]) for k in range(3, min(8, len(w)) + 1)]
                else:
                    hit.append(at(w[:3]))
        return tuple([i for i in hit if i is not None])

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.values[i] for i in self.present(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, dict[str, float], float]:
    """(character counts, feature weights, bias), learned from the rows that the train condition (over the id) takes."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = count_trigrams(docs.where(train), text_col)
    chosen = labels.where(train & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    # sample_rows rows of an id and a label: small enough to send to every task
    sample = F.broadcast(chosen.select(F.col(id_col).alias("_id"), F.col("y").cast("int").alias("y")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(sample, "_id")
    rows = rows.groupBy("_id").agg(F.max("y").alias("y"), F.min("t").alias("t")).select("y", "t")  # one row of an id, however often it occurs
    shared = spark.sparkContext.broadcast(counts)

    def tally(batches):
        model, seen = CharModel(shared.value), {}
        hits: tuple[Counter, Counter] = (Counter(), Counter())
        size = [0, 0]
        for b in batches:
            for y, text in zip(*(c.to_pylist() for c in b.columns)):
                size[y] += 1
                own: set[str] = set()
                for t in tokens_and_spans(text or "", model):
                    if t not in seen:
                        seen[t] = features(t, model)
                    own |= seen[t]
                hits[y].update(own)
        keys = list(hits[0].keys() | hits[1].keys())
        yield pa.record_batch([pa.array(["", *keys]), pa.array([size[1], *(hits[1][k] for k in keys)], pa.int64()), pa.array([size[0], *(hits[0][k] for k in keys)], pa.int64())], names=["f", "a", "b"])

    seen = rows.mapInArrow(tally, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    seen = seen.where(F.col("a") + F.col("b") >= F.when(F.col("f") == "", 0).otherwise(LEAST_DOCS))
    size = defaultdict(int)
    seen = seen.persist()
    try:
        for r in seen.where("f = ''").collect():
            size["a"], size["b"] = r["a"], r["b"]
        pos, neg = size["a"], size["b"]
        if not pos + neg:
            return counts, {}, 0.0
        # how far the feature's share in toxic rows is from the rest's, in standard errors; toxic side only
        share = (F.col("a") + F.col("b")) / (pos + neg)
        gap = (F.col("a") - pos * share) / F.sqrt(pos * share * (1 - share) * max(neg, 1) / (pos + neg) + 1e-9)
        best = [r["f"] for r in seen.where("f <> ''").select("f", gap.alias("g")).where("g >= 4").orderBy(F.desc("g"), "f").limit(FEATURES_MOST).collect()]
    finally:
        seen.unpersist()
    plain = spark.sparkContext.broadcast((counts, dict.fromkeys(best, 0.0)))

    def mark(batches):
        scorer = Scorer(*plain.value, 0.0)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([sorted(scorer.present(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["y", "x"])

    got = rows.mapInArrow(mark, "y int, x array<long>").collect()  # sample_rows rows at most
    got = sorted((r["y"], tuple(r["x"])) for r in got)
    bias, w = logistic([list(x) for _, x in got], np.array([y for y, _ in got], float), len(best))
    return counts, dict(zip(best, w.tolist())), float(bias)


_SCORERS: dict[int, Scorer] = {}


def score(docs: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fitted)  # SIZE**3 counts and FEATURES_MOST weights
    key = hash((fitted[2], tuple(fitted[1].items())))

    def run(batches):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*shared.value)
        scorer = _SCORERS[key]
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([scorer.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_of("doc_id") % 5 == 0
    fitted = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held)
    out = score(docs, fitted)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
