"""BPE encoding and decoding by prefix-sharing traversal of a trie of distinct words.

Distinct words of a batch are walked in trie order (sorted, sharing the stack of their common prefix). Each trie
node holds the last token of its prefix's encoding: the one vocabulary suffix that survives its own merges and
next to the last token of the prefix before it. A word's encoding is read back along these last tokens, so the
encoding of a shared prefix is computed once. Words already met are kept in a bounded two-generation cache per
Python worker.

Edge cases: null text is the empty text (no ids, empty decoding). Special-token strings inside a text become
their special ids, as the vocabulary file's added tokens ask. Words of any length take time in proportion to it.
Repeated rows are encoded row by row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

# The split pattern and word-end mark that the vocabulary file states.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
END = "</w>"
#: Letters up to U+024F, then ASCII marks: one word, and one more of all the marks.
PLAIN = re.compile(r"([a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-/:-@\[-`{-~]*)")
#: Stands before a word's first token; no vocabulary has so many.
START = (1 << 20) - 1
#: Control characters that str.split takes for white space and the vocabulary's normalizer does not.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
UNICODE_SPACE = regex.compile(r"[\x09-\x0d\x20\x85\xa0  -     　]+")
#: Entries of each of the two generations of a worker's caches: encoded chunks (with their decoding, fewer) and words.
CACHE_CHUNKS, CACHE_DECODED, CACHE_WORDS = 400_000, 200_000, 250_000


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table_, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table_:
            table_[b], spare = chr(spare), spare + 1
    return table_


class WordBpe:
    """Encoder for a word-end BPE vocabulary file."""

    def __init__(self, path: str, decoding: bool = True):
        self.decoding = decoding
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left part, right part)
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, t = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank[a, b] = r
            self.made.setdefault(t, (r, a, b))
        self.longest = max(len(s.removesuffix(END)) for s in self.vocab)
        self.letters = byte_letters()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._own: dict[int, bool] = {}
        self._spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.young: dict = {}  # chunk -> ids, or (ids, decoding)
        self.old: dict = {}

    def spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Tokens that stand at one edge of a token while it is merged, each with the rank of the merge that consumes it."""
        found = self._spines.get((token, right))
        if found is None:
            found, until, t = [], float("inf"), token
            while True:
                found.append((t, until))
                if t not in self.made:
                    break
                until, a, b = self.made[t]
                t = b if right else a
            self._spines[token, right] = found
        return found

    def clash(self, a: int, b: int, before: float) -> bool:
        """Does a merge across the border of a and b come before their own merges, and before a rank?"""
        for x, until_x in self.spine(a, True):
            for y, until_y in self.spine(b, False):
                r = self.rank.get((x, y))
                # of equal merges the left one is done first
                if r is not None and r < before and r < until_x and r <= until_y:
                    return True
        return False

    def adjacent(self, a: int, b: int) -> bool:
        """Do a and b stay apart when they stand side by side? After START, does b stay whole?"""
        found = self._pairs.get(a << 20 | b)
        if found is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            found = self._pairs[a << 20 | b] = self.survives(b) and (a == START or not self.clash(a, b, float("inf")))
        return found

    def survives(self, token: int) -> bool:
        """Does the token's own string encode to the token alone?"""
        found = self._own.get(token)
        if found is None:
            if token not in self.made:
                found = True
            else:
                r, a, b = self.made[token]
                found = self.survives(a) and self.survives(b) and not self.clash(a, b, r)
            self._own[token] = found
        return found

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Encodings of distinct words (in the byte-level alphabet), by depth-first walk of their trie.

        Each node finds the last token of its prefix from those of the prefixes before it: of the suffixes that are
        tokens exactly one stays beside what comes before. The last token grown by the new letter is tried first.
        """
        get, known, adjacent, longest = self.vocab.get, self._pairs.get, self.adjacent, self.longest
        before, state, size = "", [START], [0]  # of each prefix length of the last word: last token, its letters
        for word in sorted(words):
            shared, whole = 0, len(word)
            most = min(len(before), whole - 1, len(state) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del state[shared + 1 :], size[shared + 1 :]
            grown, last = size[shared] + 1, whole - 1
            for at in range(shared, whole):
                end, n, step = at + 1, grown, 0
                while True:
                    t = get(word[end - n : end]) if at < last else get(word[end - n :] + END)
                    if t is not None:
                        fits = known(state[end - n] << 20 | t)
                        if fits or fits is None and adjacent(state[end - n], t):
                            break
                    step += 1
                    n = step if step < grown else step + 1
                    if n > end or n > longest:
                        raise ValueError(f"a letter of {word!r} is not in the vocabulary")
                state.append(t)
                size.append(n)
                grown = n + 1
            ids, at = [], whole
            while at:
                ids.append(state[at])
                at -= size[at]
            ids.reverse()
            yield word, ids
            # the final node is of the word with its end mark: no longer word may go on from it
            state.pop()
            size.pop()
            before = word

    def normal(self, text: str) -> list[str]:
        """White-space separated chunks of a text without special tokens, composed and in lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letter by letter
        text = text.lower()
        if ODD_SPACE.search(text):
            return [c for c in UNICODE_SPACE.split(text) if c]
        return text.split()

    def chunks(self, text: str) -> list[str]:
        """The text's chunks; special tokens stay whole, marked by a leading NUL pair."""
        if self.specials is None or "<|" not in text:
            return self.normal(text)
        out: list[str] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append("\0\0" + part)
            else:
                out += self.normal(part)
        return out

    def parts(self, chunk: str) -> list[str]:
        """The words of a chunk, in the byte-level alphabet."""
        if plain := PLAIN.fullmatch(chunk):
            word, marks = plain.groups()
            if not word.isascii():
                word = "".join(map(self.letters.__getitem__, word.encode()))
            return [word, marks] if marks else [word]
        return ["".join(map(self.letters.__getitem__, p.encode())) for p in SPLIT.findall(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that no generation of the cache has."""
        young, decoding, names = self.young, self.decoding, self.names
        alone = {c for c in chunks if c.isascii() and c.isalpha()}  # their own and only word
        parts: dict[str, list[str]] = {}
        for c in chunks - alone:
            if c[0] == "\0" and c.startswith("\0\0") and c[2:] in self.special:
                ids = array("I", [self.special[c[2:]]]).tobytes()
                young[c] = (ids, c[2:].encode()) if decoding else ids
            else:
                parts[c] = self.parts(c)
        if len(self.words) > CACHE_WORDS:
            self.old_words, self.words = self.words, {}
        words, old = self.words, self.old_words
        fresh = alone.union(*parts.values()).difference(words)
        for w in [w for w in fresh if w in old]:
            words[w] = old[w]
            fresh.discard(w)
        for word, found in self.encode_words(fresh):
            words[word] = array("I", found).tobytes()
        whole = {c: words[c] for c in alone}
        for c, ps in parts.items():
            whole[c] = words[ps[0]] if len(ps) == 1 else b"".join([words[p] for p in ps])
        if decoding:
            for c, ids in whole.items():
                young[c] = ids, " ".join([names[i] for i in array("I", ids)]).encode()
        else:
            young.update(whole)

    def prepared(self, texts: list[str | None]) -> list[list[str]]:
        """The texts' chunks, all of them in the young generation of the cache."""
        split = [self.chunks(t) if t else [] for t in texts]
        if len(self.young) > (CACHE_DECODED if self.decoding else CACHE_CHUNKS):
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = set().union(*split).difference(young)
        for c in [c for c in missing if c in old]:
            young[c] = old[c]
            missing.discard(c)
        self.learn(missing)
        return split

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids (little-endian unsigned 32-bit) and its decoding (UTF-8)."""
        split = self.prepared(texts)
        for cs in split:
            got = [self.young[c] for c in cs]
            yield b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[1]])

    def ids_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids alone; for an encoder without decoding."""
        split = self.prepared(texts)
        get = self.young.__getitem__
        for cs in split:
            yield b"".join(map(get, cs))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.names[i] for i in ids)


_LOADED: dict[tuple[str, bool], WordBpe] = {}


def encoder(path: str, decoding: bool = True) -> WordBpe:
    """The worker's encoder for a vocabulary file; without decoding, decodings stay empty."""
    if (path, decoding) not in _LOADED:
        gc.set_threshold(200_000, 50, 1000)  # the caches are large and hold no cycles
        _LOADED[path, decoding] = WordBpe(path, decoding)
    return _LOADED[path, decoding]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids BINARY of little-endian unsigned 32-bit, decoded STRING) for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches):
        code = encoder(path)
        for b in batches:
            both = list(code.encode_batch(b.column(1).to_pylist()))
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in both], pa.binary()), pa.array([y.decode() for _, y in both], pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), vocabulary())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
