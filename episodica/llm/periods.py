"""Periodic run detection: Main-Lorentz divide and conquer over interned word ids.

A run is a stretch of words with smallest period q, of at least max(MIN_WORDS, 2 q) words, that no neighbouring word
extends. `runs` splits a segment at its midpoint; Z-functions of the two halves tell for each period how far words that
period apart agree to the left and right of the midpoint, which gives every repetition that crosses it; then both halves
are split in turn. A run is whole at the split that first cuts it. A later split may see a part of it, ending at the
segment's border: looking one word beyond tells that it can be extended, so that it is known already and is left out. Intervals found
with several periods keep the smallest.

Every run has two equal windows of SEED words a period apart (MIN_WORDS >= 2 SEED). So a segment is first narrowed to
the words from its first to its last window that recurs in it, and dropped if none does; windows are compared by a hash,
which may only keep more. A half that lies within a run of period q, 2 q <= MIN_WORDS, is left: any other run in there would
be shorter than 2 q (two periods over p + q words merge). Z values are worked out where the first word of the pattern stands and are zero elsewhere.
Time is n log n at worst, memory linear in the text.

Edge cases: null or empty text has no words and no runs; a null id counts as the empty text where ids choose rows.
Very long texts are read whole. Repeated rows and ties need nothing: each row is judged alone. An empty table gives an
empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, small_batches, table
from .quality import words_of

#: Shortest run in words, and words of the window that recurs in every run.
MIN_WORDS, SEED = 12, 6
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SEED)], np.uint64)


def interned(words: list[str]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    ids: dict[str, int] = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)


def agree(a: np.ndarray, s: list[int], i: int, k: int) -> int:
    """How far a[i:] and a agree, which are known to agree for k words. s: a as a list."""
    n = len(s)
    for _ in range(16):
        if i + k >= n or s[i + k] != s[k]:
            return k
        k += 1
    step = 64
    while i + k < n:
        size = min(step, n - i - k)
        apart = a[i + k : i + k + size] != a[k : k + size]
        if apart.any():
            return k + int(apart.argmax())
        k += size
        step *= 2
    return k


def z_values(a: np.ndarray, first: int = 1, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places i in first..last-1 where a[i:] and a agree for a word or more, and for how many."""
    s, z = a.tolist(), {}
    left = right = 0
    for i in (np.flatnonzero(a[1:last] == a[0]) + 1).tolist() if len(s) else ():
        k = min(right - i, z.get(i - left, 0)) if i < right else 0
        if i + k >= right:
            k = agree(a, s, i, k)
            left, right = i, i + k
        z[i] = k
    at = np.fromiter(z.keys(), np.int64, len(z))
    far = np.fromiter(z.values(), np.int64, len(z))
    return at[at >= first] - first, far[at >= first]


def spread(n: int, at: np.ndarray, far: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[at] = far
    return out


def crossing(u: np.ndarray, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words before the midpoint, words after it, period) of the repetitions over u and v that cross their border."""
    nu, nv, stop = len(u), len(v), np.array([-1])
    back, whole = u[::-1], np.concatenate((u, v))
    found = []
    # words of u that a period p before the border repeat: to the left by u reversed, to the right by v within the whole
    p = np.arange(1, nu + 1)
    before = spread(nu + 1, *z_values(back, 0))[1:]
    at, far = z_values(np.concatenate((v, stop, whole)), nv + 1, nv + 1 + nu)
    after = spread(nu, at, far)[::-1]
    good = before + after >= np.maximum(p, MIN_WORDS - p)
    found.append((p[good] + before[good], after[good], p[good]))
    # the same a period after the border
    p = np.arange(1, nv + 1)
    after = spread(nv + 1, *z_values(v, 0))[1:]
    at, far = z_values(np.concatenate((back, stop, whole[::-1])), nu + 1, nu + 1 + nv)
    before = spread(nv, at, far)[::-1]
    good = before + after >= np.maximum(p, MIN_WORDS - p)
    found.append((before[good], p[good] + after[good], p[good]))
    return found


def recurring(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows of SEED words that recur, rising, and of their next occurrence."""
    n = len(ids) - SEED + 1
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = ids.astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(SEED):
        keys += (wide[k : k + n] + np.uint64(1)) * _MIX[k]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    here, there = order[:-1][same], order[1:][same]
    rising = np.argsort(here)
    return here[rising], there[rising]


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start and period."""
    here, there = recurring(ids)
    n, best, todo = len(ids), {}, [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        if high - low < MIN_WORDS:
            continue
        a, b = np.searchsorted(here, (low, high))
        inside = np.flatnonzero(there[a:b] <= high - SEED)
        if not len(inside):
            continue
        low, high = int(here[a + inside[0]]), int(there[a:b][inside].max()) + SEED
        middle = (low + high) // 2
        halves = [(low, middle), (middle, high)]
        for before, after, period in crossing(ids[low:middle], ids[middle:high]):
            for start, end, p in zip((middle - before).tolist(), (middle + after).tolist(), period.tolist()):
                if 2 * p <= MIN_WORDS:
                    halves = [(x, y) for x, y in halves if x < start or end < y]
                if start == low > 0 and ids[low - 1] == ids[low - 1 + p] or end == high < n and ids[high] == ids[high - p]:
                    continue
                best[start, end] = min(p, best.get((start, end), p))
        todo += halves
    return sorted((start, end - start, p) for (start, end), p in best.items())


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: those beyond the first period of a run go."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return edge.cumsum()[:n] == 0


def loop_tail(words: list[str], doc_id) -> list[str]:
    """The words, for every tenth id by its hash with a tail that repeats some of them."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + p]
    return words[:a] + (once * -(-(n - a) // p))[: n - a]


def described(words: list[str]) -> tuple:
    """(runs, start, length, period, 1000 x exponent, digest of runs, digest of the words left) of a text."""
    found = runs(interned(words))
    text = "".join(f"{start},{length},{period}\n" for start, length, period in found)
    left = words
    if found:
        left = [w for w, k in zip(words, kept_words(len(words), found).tolist()) if k]
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = 1000 * length // period if found else None
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (text, " ".join(left)))
    return len(found), start, length, period, exponent, *digests


_FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=lambda words, doc_id: words) -> DataFrame:
    """Runs of each document, after change has been made to its words."""
    small_batches(docs.sparkSession)
    names = ["id", *(f.split()[0] for f in _FIELDS.split(", "))]
    types = [*[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = [described(change(words_of(t or ""), i)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {_FIELDS}").withColumnRenamed("id", id_col)


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every run cut to its first period; white space between words that stay becomes one space where words go."""
    from .common import replaced, with_length

    small_batches(docs.sparkSession)

    def cut(text: str | None) -> str | None:
        spans = [m.span() for m in WORD.finditer(text or "")]
        words = [text[a:b] for a, b in spans]
        found = runs(interned(words))
        if not found:
            return text
        out, last = [text[: spans[0][0]]], -1
        for k, stays in enumerate(kept_words(len(words), found).tolist()):
            if stays:
                out.append((text[spans[last][1] : spans[k][0]] if last == k - 1 else " ") if last >= 0 else "")
                out.append(words[k])
                last = k
        return "".join(out) + text[spans[-1][1] :]

    def run(batches):
        for b in batches:
            yield replaced(b, text_col, [cut(t) for t in b.column(text_col).to_pylist()])

    return with_length(docs.mapInArrow(run, docs.schema), text_col)


def op11_periods(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), change=loop_tail)
