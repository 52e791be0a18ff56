"""Personal data by weak supervision, in DataFrame functions alone.

Base spans follow fixed patterns and always count. Looser patterns give further candidates (addresses with words for
"at" and "dot", phone numbers without a plus sign, full-length IPv6 addresses). Labelers vote on every candidate: its pattern (regex),
prefixes and endings known from public numbering (gazetteer), and words before it (context). Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is; its posteriors are the soft labels of a
logistic span classifier over the votes and the span's form. Candidates that it takes, and that touch no base span,
are added. Votes and forms have few values, so both fits run over a small table of counts; every candidate of every
document is counted.

Edge cases: null text is empty and has no span. Spans are code-point offsets, end exclusive, and leftmost
non-overlapping for each pattern. Very long texts are matched by patterns that neither recurse nor retry. Repeated
rows are judged one by one and count as often in the fits. An empty table gives an empty one. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, with_length

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
# Patterns, possessive so that matching is linear; each finds what the plain pattern of its kind finds.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
AT_DOT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}+"
BARE_PHONE = r"(?<![0-9A-Za-z+.-])(?<![0-9+][ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-]|[ .][0-9])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
# Endings, issuer digits, calling codes and words that the gazetteer and context labelers know.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|jp|example|test|invalid"
ISSUERS = "[3-6]"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CONTEXT = {
    "email": "mail|contact|write|reach|correo|kontakt|courriel",
    "ip": r"\bip\b|address|host|server|login|adresse|servidor",
    "card": "card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|tel|fax|mobile|cell|anruf|appel|llam",
}
WINDOW = 24


def positions(text: Column, pattern: str, may: Column | None = None) -> Column:
    """Array of (s, e, m): leftmost non-overlapping matches; may: a cheap test that a text must pass to have any."""
    p = F.lit(pattern)
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def walk(m: Column) -> Column:
        pairs = F.zip_with(m, F.slice(gaps, F.lit(1), F.greatest(F.size(m), F.lit(0))), lambda a, g: F.struct(a.alias("m"), g.alias("g")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    has = text.rlike(pattern) if may is None else may & text.rlike(pattern)
    return F.when(has, walk(found)).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Does a digit string pass the Luhn check?"""
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        y = F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)
        return acc + y

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _octet(p: Column) -> Column:
    """Is a digit string 255 at most? Compared as text, for it may be of any length."""
    z = F.ltrim(p, F.lit("0"))
    return (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255"))


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans of each kind, as arrays of (s, e, m)."""
    email = positions(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(positions(text, IP, F.contains(text, F.lit("."))), lambda x: F.forall(F.split(x["m"], r"\."), _octet))
    card = F.filter(positions(text, CARD_RUN), lambda x: F.length(digits(x["m"])).between(14, 19) & luhn(digits(x["m"])))
    phone = F.filter(positions(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(digits(x["m"])).between(10, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


# A chain of 14 to 19 digits; longer and shorter chains are matches that fail, so they need not be found.
CARD_RUN = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
LOOSE = {"email": (AT_DOT, r"[\[( ]dot[\]) ]"), "phone": (BARE_PHONE, None), "ip": (IPV6, None)}


def _spans(kind: str, found: Column, base: bool) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), x["m"].alias("m"), F.lit(base).alias("base")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): base and loose candidates of each document, in order of start, then kind."""
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select("id", text.alias("t"))
    base = base_spans(F.col("t"))
    parts = [_spans(k, base[k], True) for k in KINDS]
    for kind, (pattern, gate) in LOOSE.items():
        may = F.col("t").rlike(gate) if gate else None
        parts.append(_spans(kind, positions(F.col("t"), pattern, may), False))
    return rows.select("id", "t", F.array_sort(F.concat(*parts)).alias("spans"))


FEATURES = ("regex", "gazetteer", "context", "separated", "long")


def votes(text: Column, x: Column) -> Column:
    """Votes (1 for, 0 against or none) of the labelers on a span, and its form."""
    before = F.lower(F.substring(text, F.greatest(x["s"] - WINDOW, F.lit(0)) + 1, F.least(x["s"], F.lit(WINDOW))))
    d = digits(x["m"])
    per = lambda tests: F.coalesce(*[F.when(x["k"] == KINDS.index(k), t) for k, t in tests.items()])
    gazetteer = per({
        "email": F.lower(x["m"]).rlike(rf"(?:\.|dot[\]) ] ?)(?:{ENDINGS})$"),
        "ip": ~x["m"].rlike(r"^(?:0|255)\."),
        "card": d.rlike(f"^{ISSUERS}"),
        "phone": F.when(x["base"], d.rlike(f"^(?:{CALLING})")).otherwise(d.rlike("^[2-9][0-9]{2}[2-9]")),
    })
    context = per({k: before.rlike(CONTEXT[k]) for k in KINDS})
    flags = [x["base"], gazetteer, context, x["m"].rlike("[ ()\\[\\]-]"), F.length(x["m"]) >= 16]
    return F.struct(*[f.cast("int").alias(n) for f, n in zip(flags, FEATURES)])


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], list[tuple[float, float]]]:
    """Weights (bias first) of the span classifier of one kind, and each labeler's estimated (hit, false alarm) rates.

    patterns: (features, count); the first three features are the labelers' votes.
    """
    total = sum(c for _, c in patterns)
    rates, share = [(0.9, 0.1), (0.8, 0.3), (0.5, 0.1)], 0.8
    post = [0.5] * len(patterns)
    for _ in range(rounds if total else 0):
        for i, (v, _) in enumerate(patterns):
            a, b = share, 1 - share
            for (hit, false), x in zip(rates, v):
                a *= hit if x else 1 - hit
                b *= false if x else 1 - false
            post[i] = a / (a + b)
        real = sum(c * p for (_, c), p in zip(patterns, post))
        # counts of one on each side keep the rates off 0 and 1 and each labeler better than chance at the start
        rates = [
            ((sum(c * p for (v, c), p in zip(patterns, post) if v[j]) + 2 * h) / (real + 2), (sum(c * (1 - p) for (v, c), p in zip(patterns, post) if v[j]) + 2 * f) / (total - real + 2))
            for j, (h, f) in enumerate(rates)
        ]
        share = (real + 1) / (total + 2)
    w = [0.0] * (1 + len(FEATURES))
    for _ in range(300 if total else 0):
        grad = [0.02 * x for x in w]
        for (v, c), p in zip(patterns, post):
            e = _sigmoid(w[0] + sum(a for a, x in zip(w[1:], v) if x)) - p
            for j, x in enumerate((1, *v)):
                grad[j] += c / total * e * x
        w = [x - 0.5 * g for x, g in zip(w, grad)]
        w[1:4] = [max(0.0, x) for x in w[1:4]]  # a labeler's vote never counts against a span
    return w, rates


def train(found: DataFrame) -> dict[str, list[float]]:
    """The span classifier of each kind, from the vote patterns of all candidates."""
    seen = found.select("t", F.explode("spans").alias("x")).select(F.col("x.k").alias("k"), votes(F.col("t"), F.col("x")).alias("v")).groupBy("k", "v").count()
    rows = seen.collect()  # kinds times 2 to the number of features at most
    return {kind: fit(sorted((tuple(r["v"]), r["count"]) for r in rows if r["k"] == i))[0] for i, kind in enumerate(KINDS)}


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): base spans and the added ones, as (s, k, e, m, base) in order of start, then kind."""
    found = candidates(docs, id_col, text_col)
    weights = train(found)

    def taken(x: Column, all_: Column) -> Column:
        v = votes(F.col("t"), x)
        score = F.coalesce(*[F.when(x["k"] == i, F.lit(weights[k][0]) + sum(v[n] * F.lit(w) for n, w in zip(FEATURES, weights[k][1:]))) for i, k in enumerate(KINDS)])
        clear = ~F.exists(all_, lambda y: y["base"] & (y["s"] < x["e"]) & (x["s"] < y["e"]))
        return x["base"] | ((score >= 0) & clear)

    spans = F.filter("spans", lambda x: taken(x, F.col("spans")))
    return found.select("id", "t", F.when(F.size("spans") > 0, spans).otherwise(F.col("spans")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    names = F.array(*map(F.lit, KINDS))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("<"), F.upper(names[x["k"]]), F.lit(">"))
        ok = x["s"] >= acc["at"]
        return F.struct(F.when(ok, x["e"]).otherwise(F.greatest(acc["at"], x["e"])).alias("at"), F.when(ok, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with every span of the text masked."""
    found = label(docs.select(F.struct("*").alias("row"), F.col(text_col)), "row", text_col)
    text = F.when(F.size("spans") > 0, masked(F.col("t"), F.col("spans"))).otherwise(F.col("id")[text_col])
    return with_length(found.select(*[(text if c == text_col else F.col("id")[c]).alias(c) for c in docs.columns]), text_col)


def _of_kind(i: int):
    return lambda x: x["k"] == i


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = label(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), "spans", base.alias("base")).select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
