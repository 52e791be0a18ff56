"""Line-first cleaning: rules per line, failing lines removed, documents that lose too much text rejected.

Base counts follow the word and line definitions of `measure`. A line without a word is kept and counts for nothing.
A line fails
- punctuation: marks (symbols, exclamation) beyond a share of its word characters, nine of ten words or more in
  capitals (lines of five words or more), or a line of many words without any sentence end;
- navigation: separators between most of its words, or a line without a sentence end of which half the words or more
  (two at least) are menu words;
- boilerplate: a stock phrase of sites and scripts for every STOCK_WORDS words or fewer of the line, or a line already
  seen in the document.
Menu words and stock phrases are in English, German, French and Spanish.
The document is rejected if the lines left hold less than `keep_share` of its word characters, or if it fails the base
rule (too few words, or repeated windows over half of them).

Edge cases: null or empty text has no words, fails the base rule and is rejected; its clean text is empty. Very long
lines are handled whole. Repeated rows and ties need nothing: each row is judged alone. An empty table gives an empty
one. Other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, replaced, small_batches, table, with_length

# The symbol characters and base rule of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: White space that str.split takes and the word definition does not.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
_TRIM = ".,;:!?()[]|>/«»‹›•·"
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)")
SEPARATORS = re.compile(r"(?:^|\s)(?:[|»›•·>/]|::|->)(?=\s|$)")
# Stock phrases and menu words.
STOCK_PHRASES = (
    "javascript", "lorem ipsum", "cookie", "copyright", "licensed under", r"\{\s*\}", r"function\s*\(",
    "all rights reserved", "privacy policy", "terms of (?:use|service)", "click here", r"sign (?:in|up)\b", r"log ?in\b", "subscribe",
    "alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "klicken sie hier", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "conditions d['’]utilisation", "mentions légales", "cliquez ici", "abonnez-vous",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "aviso legal", "haga clic", "haz clic", "suscríbete",
)
MENU_WORDS = frozenset(
    "home about contact search menu sitemap faq help next previous startseite kontakt suche hilfe weiter zurück accueil recherche plan aide suivant précédent inicio contacto buscar ayuda siguiente anterior".split()
)
#: A line fails with a stock phrase for so many words or fewer.
STOCK_WORDS = 40
BOILERPLATE = re.compile("|".join(STOCK_PHRASES), re.I)
#: A substring of each stock phrase, for a quick look at a whole text in lower case.
_STOCK = ("javascript", "lorem", "cookie", "copyright", "licensed", "{", "function", "rights", "privacy", "terms of", "click", "sign ", "log", "subscribe", "rechte", "datenschutz", "impressum", "nutzungs", "klicken", "newsletter", "droits", "confidentialit", "conditions d", "mentions", "cliquez", "abonnez", "derechos", "privacidad", "condiciones", "aviso", "clic", "suscr")


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def repeated(words: list[str]) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def line_fails(line: str, words: list[str], chars: int, seen: set[str], stock: bool) -> str | None:
    """The rule that a line of some words with chars characters fails, if any; stock: stock phrases are worth a look."""
    n = len(words)
    marks = sum(map(line.count, SYMBOLS))
    if marks > 0.1 * chars or line.count("!") > max(3, 0.3 * n):
        return "punctuation"
    if n >= 5 and 10 * sum(map(str.isupper, words)) >= 9 * n:
        return "punctuation"
    if n >= 60 and not SENTENCE_END.search(line):
        return "punctuation"
    if marks or "/" in line or "»" in line or "›" in line or "•" in line or "·" in line:
        apart = len(SEPARATORS.findall(line))
        if apart >= 2 and 3 * apart >= n - apart:
            return "navigation"
    if 2 <= n <= 2 * len(MENU_WORDS) and not SENTENCE_END.search(line):
        menu = len({w.strip(_TRIM).lower() for w in words} & MENU_WORDS)  # no line has more of them than there are
        if menu >= 2 and 2 * menu >= n:
            return "navigation"
    if line in seen or stock and n <= STOCK_WORDS * len(BOILERPLATE.findall(line)):
        return "boilerplate"
    return None


def measure(text: str | None, keep_share: float = 0.5) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean text) of a text."""
    text = text or ""
    split = WORD.findall if _OTHER_SPACE.search(text) else str.split
    lines, words, sizes = text.split("\n"), [], []
    for line in lines:
        own = split(line)
        words += own
        sizes.append((own, len("".join(own))))
    n, chars = len(words), sum([c for _, c in sizes])
    full = [x for x, (own, _) in zip(lines, sizes) if own]
    dup = len(full) - len(set(full))
    again = repeated(words)
    failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
    low = text.lower()
    stock = any([k in low for k in _STOCK])
    clean, left, seen = [], 0, set()
    for line, (own, c) in zip(lines, sizes):
        if not own:
            clean.append(line)
            continue
        if line_fails(line, own, c, seen, stock) is None:
            clean.append(line)
            left += c
        seen.add(line)
    kept = not failed and left >= keep_share * chars
    return n, chars, sum(map(text.count, SYMBOLS)), dup, again, failed, kept, "\n".join(clean)


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_share: float = 0.5, with_text: bool = True) -> DataFrame:
    """Counts, verdict and (with_text) cleaned text of each document."""
    small_batches(docs.sparkSession)
    fields = _FIELDS if with_text else _FIELDS.rsplit(", ", 1)[0]
    names = [f.split()[0] for f in fields.split(", ")]
    types = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.string()]

    def run(batches):
        for b in batches:
            rows = [measure(t, keep_share)[: len(names)] for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, text_col: str = "text", keep_share: float = 0.5) -> DataFrame:
    """The kept rows of docs, all columns, with the failing lines removed from the text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            judged = [measure(t, keep_share)[-2:] for t in b.column(text_col).to_pylist()]
            yield replaced(b, text_col, [t for _, t in judged]).filter(pa.array([k for k, _ in judged], pa.bool_()))

    return with_length(docs.mapInArrow(run, docs.schema), text_col)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), with_text=False)
