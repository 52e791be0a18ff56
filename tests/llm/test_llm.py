"""Training-data operators against brute force on small tables with nulls, repeats, ties and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

from episodica.llm import bpe, digest, jaccard, lattice, packing, pii, quality, suffix, toxicity, warc
from episodica.llm.common import crc_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, id string, t int, rid int, key int, kept string"


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = line(90), line(60)
    texts = [None, "", "  \n\t", "one", "a b", "Hello's it's <|endoftext|> ΣΑΣ x\x1cy\xa0z", "mail a@b.co.uk_d@e.f, tel +1 (487) 555-7209, card 4111 1111 1111 1111, ip 10.0.0.1.5"]
    texts += [base, base, base.replace(" ", "  ", 3), line(20) + " " + passage + " " + line(20), passage + line(15), line(3) + passage]
    for k in range(12):
        w = base.split(" ")
        for _ in range(k // 4):
            w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [line(rng.randint(1, 80)) + ".\n" + line(9) for _ in range(12)] + ["ab " * 400, "z" * 70_000, "😀" * 90, line(9000)]
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x", "y", "z"], 1, 2, 3, "k") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# ---- encoding and packing


def test_encoding_is_the_librarys(spark, docs, rows):
    lib = Tokenizer.from_file(bpe.vocabulary())
    got = {r["doc_id"]: r for r in bpe.encode(docs, bpe.vocabulary()).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_encoding_of_random_text():
    lib, own, rng = Tokenizer.from_file(bpe.vocabulary()), bpe.WordBpe(bpe.vocabulary()), random.Random(2)
    texts = ["".join(rng.choice("aabbtheinrs'.,!1é ß́ñ\n\t<|>日😀") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t, (ids, _) in zip(texts, own.encode_batch(texts)):
        assert ids == b"".join(x.to_bytes(4, "little") for x in lib.encode(t, add_special_tokens=False).ids), t


def test_packing_places_every_token_once(spark, docs, rows):
    lib = Tokenizer.from_file(bpe.vocabulary())
    got = packing.assign(packing.pieces(docs, bpe.vocabulary())).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in parts) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert [r["start"] for r in parts] == list(range(0, len(ids), packing.CAPACITY))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // packing.CAPACITY) + 2


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert [p.place(n) for n in (6, 5, 4, 5)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    p = packing.BestFit(10, 1)
    assert [p.place(n) for n in (6, 5, 4)] == [(0, 0), (1, 0), (1, 5)]


# ---- quality


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in rows:
        t, r = t or "", got[i]
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        marked = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(marked), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_clean_text_and_rejects_junk():
    good = "\n".join(f"This{k} is{k} line {k} of{k} a{k} quiet{k} text{k} that says{k} little{k}." for k in range(9))
    assert quality.measure(good)[6]
    assert not quality.measure(" ".join(f"w{k}%%%" for k in range(90)))[6]
    assert not quality.measure(" | ".join(f"menu{k}" for k in range(90)))[6]


def test_line_rules():
    fails = lambda x: quality.line_fails(x, x.split(), len("".join(x.split())), set(), True)
    plain = "a quiet line of words that says little about anything at all and ends here."
    for line, rule in (
        (plain, None),
        ("word#% other$$", "punctuation"),
        ("no! no! no! no! no!", "punctuation"),
        ("NEARLY ALL OF THIS LINE STANDS IN CAPITALS, BUT one.", "punctuation"),
        ("Only THREE OF THESE words stand in capitals here.", None),
        ("w " * 59 + "w.", None),
        ("w " * 60, "punctuation"),
        ("one » two » three » four", "navigation"),
        ("Home About Contact", "navigation"),
        ("Startseite | Kontakt", "navigation"),
        ("Accueil Recherche Plan du site", "navigation"),
        ("Home is where the heart is.", None),
        ("she went home to search for help with the next thing and then came back again", None),
        ("Todos los derechos reservados.", "boilerplate"),
        ("w " * 37 + "all rights reserved.", "boilerplate"),
        ("w " * 38 + "all rights reserved.", None),
        (" ".join([plain] * 3) + " all rights reserved. Cliquez ici.", "boilerplate"),
    ):
        assert fails(line) == rule, line
    assert quality.line_fails(plain, plain.split(), 60, {plain}, False) == "boilerplate"


def test_stock_phrases_have_a_quick_look():
    for phrase in quality.STOCK_PHRASES:
        plain = phrase.replace(r"\s*", "").replace(r"\b", "").replace("(?:use|service)", "use").replace("(?:in|up)", "in").replace("['’]", "'").replace("\\", "").replace("log ?in", "log in").lower()
        assert quality.BOILERPLATE.search(plain) and any(k in plain for k in quality._STOCK), plain


def test_verdict_is_that_of_the_lines(docs, rows):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in rows:
        left, clean, seen, total = 0, [], set(), 0
        for line in (t or "").split("\n"):
            own = WORD.findall(line)
            chars = len("".join(own))
            total += chars
            if not own:
                clean.append(line)
            elif not quality.line_fails(line, own, chars, seen, True):
                clean.append(line)
                left += chars
            seen.add(line)
        assert got[i]["clean_text"] == "\n".join(clean)
        assert got[i]["kept"] == (not got[i]["base_failed"] and left >= 0.5 * total)


# ---- personal data

E, I, C, P = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    d = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, "email", m.end()) for m in E.finditer(t)]
    out += [(m.start(), 1, "ip", m.end()) for m in I.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in C.finditer(t) if 14 <= len(d(m)) <= 19 and luhn(d(m))]
    out += [(m.start(), 3, "phone", m.end()) for m in P.finditer(t) if 10 <= len(d(m)) <= 15]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_personal_data(spark):
    texts = [None, "", "a@b.c_d@e.f x@y.z..q@r.s", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.003.0004", "😀 a.b@c-d.com 4111 1111 1111 1111", "4111111111111111-1 4111-1111-1111-1111", "+12345678901234567 +1 2-3.4(5)6 78 90 1 +123", "1 " * 4000, "a@" + "b." * 9000 + "c", "9" * 30000]
    found = pii.label(frame(spark, list(enumerate(texts))))
    from pyspark.sql import functions as F

    got = {r["id"]: r["b"] for r in found.select("id", pii.listed(F.filter("spans", lambda x: x["base"])).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base_spans(t or ""), t[:40]


def test_masking_keeps_rows_and_columns(spark, docs, rows):
    out = pii.mask(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(got) == len(rows) and got[0] is None
    assert got[18] == "mail <EMAIL><EMAIL>, tel <PHONE>, card <CARD>, ip <IP>.5"


# ---- archives


def test_archives(spark):
    pages = [(k, f"http://h/{k} é\n" if k % 3 else None, t) for k, t in enumerate([None, "", "x", "y" * 200_000, "x", "ÄÖ" * 9, "x", "y" * 200_000])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    man = warc.write_archives(warc.mark(df.repartition(2)))
    for size in (37, 1 << 20):
        got = {int(r["headers"]["x-page"]): r for r in warc.read_archives(man, size).collect()}
        assert len(got) == len(pages)
        for k, _, t in pages:
            first = min(i for i, _, u in pages if (u or "") == (t or ""))
            h = got[k]["headers"]
            assert h["warc-type"] == ("response" if first == k else "revisit")
            assert h["warc-payload-digest"] == "sha1:" + warc.digest((t or "").encode())
            assert bytes(got[k]["payload"]) == ((t or "").encode() if first == k else b"")
            assert first == k or int(h["x-refers-to-page"]) == first
    assert warc.read_archives(warc.write_archives(warc.mark(df.where("false")))).count() == 0


def test_headers_and_records_of_any_length(spark):
    rng = random.Random(4)
    noise = "".join(map(chr, rng.choices(range(33, 0x2FFF), k=2_500_000)))  # over a reader's range when packed
    pages = [(1, "http://h/" + "é" * 200_000, "a"), (2, "x" * 1_000_000, noise), (3, "http://h/3", "b"), (4, "y" * 90_000, noise), (5, "z", "c")]
    man = warc.write_archives(warc.mark(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)))
    assert man.collect()[0]["size"] > warc.RANGE_BYTES
    for size in (warc.RANGE_BYTES, 700_001):
        got = {int(r["headers"]["x-page"]): r for r in warc.read_archives(man, size).collect()}
        assert sorted(got) == [1, 2, 3, 4, 5]
        assert bytes(got[2]["payload"]).decode() == noise and got[4]["headers"]["x-refers-to-page"] == "2"
        assert got[2]["headers"]["warc-target-uri"] == pages[1][1] and got[1]["headers"]["warc-target-uri"].count("%C3%A9") == 200_000


def test_row_numbers_clash_with_no_column(spark, rows):
    odd = spark.createDataFrame([(i, t, 7, "s", 8) for i, t in rows[:30]], "doc_id long, text string, _rid int, _spans string, _RID_ int").repartition(2)
    plain = odd.drop("_rid", "_spans", "_RID_")
    keep = lambda df: sorted((r["doc_id"], r["text"] or "") for r in df.collect())
    for f in (lambda df: suffix.without_repeats(df, 20), lambda df: suffix.without_repeats(df, 20, keep="none")):
        got = f(odd)
        assert got.columns == odd.columns and keep(got) == keep(f(plain))
        assert {(r["_rid"], r["_spans"]) for r in got.collect()} == {(7, "s")}
    got = jaccard.representatives(odd)
    assert got.columns == odd.columns and got.count() == jaccard.representatives(plain).count()


def test_damaged_records_are_reported(spark):
    pages = [(k, f"http://h/{k}", f"text {k} " * (3 + 997 * (k == 2))) for k in range(5)]
    man = warc.write_archives(warc.mark(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)))
    [row] = man.collect()
    store, root = warc.filesystem(row["path"])
    with store.open_input_file(root) as f:
        raw = f.read()
    records = list(warc.read_range(store, root, 0, row["size"], row["size"]))
    assert [r[:2] for r in records] == [(a, b) for a, b in zip([0, *(r[1] for r in records)], [r[1] for r in records])]
    page = [int(warc.parse(r[2])[0]["x-page"]) for r in records]
    for at, gone in ((records[2][1] - 6, 2), (records[0][0] + 20, 0), (records[4][1] - 3, 4)):  # a checksum, a header, the end
        bad = bytearray(raw)
        bad[at] ^= 0xFF
        with store.open_output_stream(root, compression=None) as f:
            f.write(bytes(bad))
        for size in (41, 1 << 20):
            got = warc.read_archives(man, size, damaged="rows").collect()
            assert sorted(int(r["headers"]["x-page"]) for r in got if "x-page" in r["headers"]) == sorted(set(range(5)) - {page[gone]})
            lost = [(int(r["headers"]["x-damaged"]), len(r["payload"])) for r in got if "x-damaged" in r["headers"]]
            assert lost == [(records[gone][0], records[gone][1] - records[gone][0])]
        with pytest.raises(Exception, match="are no record"):
            warc.read_archives(man).count()


def test_archive_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(warc.SQL)
    got = warc.op4_warc(spark, SF).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


# ---- similar sets


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components(docs, rows, words, percent):
    s = sets_of(rows, words)
    parent = {i: i for i in s}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_components(docs, words, percent).collect()}
    assert got == {i: (len(s[i]), find(i)) for i in s}


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (3, 80, 700, 5000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        t = np.unique(np.concatenate([s[n // 9 :], rng.integers(0, 1 << 63, n // 7 + 1, dtype=np.uint64)]))
        a, b = jaccard.folded([jaccard.sketch(s), jaccard.sketch(t)])
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(s, t))


@pytest.mark.parametrize("most", [2, 4096])
def test_long_lists_are_dealt_over_a_grid(spark, most):
    import numpy as np

    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 60, k % 8)), rng.integers(0, 1 << 63, k % 8, dtype=np.uint64)])) for k in range(30)]
    entries = [(key, k, len(s), int(pos), k) for k, s in enumerate(sets) for pos, key in [(0, 1), (k % 3, 2)]]
    named = spark.createDataFrame(entries, "key long, cid long, n long, pos long, comp long")
    sketches = spark.createDataFrame([(k, jaccard.sketch(s)) for k, s in enumerate(sets)], "cid long, sketch binary")
    got = {(r["a"], r["b"]) for r in jaccard._meetings(named, sketches, 80, most).collect()}
    linked = {(a, b) for a in range(30) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked and linked <= got
    assert len(got) < 30 * 29 // 2


def test_components_of_many_near_copies(spark):
    """A group of 400 near copies about the threshold, and a shingle that every document has."""
    rng = random.Random(21)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join([*w, "one", "common", "passage", "ends", "it"])))
    rows += [(1000 + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(30)) + " one common passage ends it") for k in range(200)]
    s = sets_of(rows, 4)
    parent = {i: i for i in s}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in s:
        for b in s:
            if a < b and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.linked_components(df, 4, 85).collect()} == {i: find(i) for i in s}


def test_one_representative_of_each_component(docs, rows):
    kept = jaccard.representatives(docs, 5, 80)
    assert kept.columns == docs.columns
    comp = {r["doc_id"]: r["component_id"] for r in jaccard.linked_components(docs, 5, 80).collect()}
    assert Counter(comp[r["doc_id"]] for r in kept.collect()) == Counter(set(comp.values()))


# ---- digests


def test_digests_follow_the_next_document(docs, rows):
    got = {r["doc_id"]: r for r in digest.compared_with_next(docs).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        changed = digest.edit(t or "", u or "")
        r = got[i]
        assert r["n_chars"] == len(t or "") and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == digest.fingerprint(t) and r["edited_fingerprint"] == digest.fingerprint(changed)
        assert r["near_next"] == digest.likeness(digest.fingerprint(t), digest.fingerprint(u)) and 0 <= r["near_edited"] <= 1


def test_triplet_counts():
    data = b"hello, triplets"
    want = sum(1 for i, j in digest._SHAPES for _ in range(len(data) - j))
    assert digest.counts(data).sum() == want and digest.fingerprint("") == digest.fingerprint(None)


# ---- repeats


def brute_repeats(rows, length, keep):
    starts = defaultdict(list)
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for k in range(len(data[i]) - length + 1):
            starts[data[i][k : k + length]].append((i, k))
    gone = defaultdict(set)
    for where in starts.values():
        for i, k in where[1:] if keep == "first" else where if len(where) > 1 else []:
            gone[i].update(range(k, k + length))
    return {i: bytes(c for k, c in enumerate(b) if k not in gone[i]) for i, b in data.items()}


@pytest.mark.parametrize(("keep", "hot", "crowd"), [("none", 512, 4096), ("first", 512, 4096), ("none", 1, 4096), ("none", 1, 3), ("first", 1, 3)])
def test_repeats(spark, docs, rows, keep, hot, crowd, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix.removed_spans, "__defaults__", (*suffix.removed_spans.__defaults__[:-1], crowd))
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.remove_repeats(docs, keep=keep).collect()}
    assert got == brute_repeats(rows, 200, keep)


def test_previous_factors_are_the_longest():
    import numpy as np

    rng = random.Random(4)
    data = np.array([rng.randint(0, 1) for _ in range(300)], np.uint8)
    starts = np.arange(285)
    order, match = suffix.suffix_order(data, starts, 16)
    found = suffix.previous_factors(order, match, starts)
    seen = {}
    for i in starts:
        key = bytes(data[i : i + 16])
        assert found[i] == (16 if key in seen else 0)
        seen.setdefault(key, i)


def test_text_form_keeps_whole_characters(docs):
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix.kept_text("éé" * 3, [{"first": 1, "last": 1}], 4) == "é" * 5


# ---- language model


def test_lattice_sums_all_segmentations():
    w = {k: math.log(p) for k, p in {"▁": 0.1, "▁a": 0.2, "a": 0.2, "b": 0.1, "ab": 0.15, "▁ab": 0.05}.items()}
    m = lattice.Lattice(w)

    def total(s):
        return 1.0 if not s else sum(math.exp(w[s[:k]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in w)

    for word in ("a", "ab", "abab", "aab"):
        assert m.log_probability(word) == pytest.approx(math.log(total("▁" + word)))
    words = sorted(["a", "ab", "abab", "aab"])
    assert m.log_probabilities(words) == pytest.approx([m.log_probability(x) for x in words])
    one, all_ = defaultdict(float), defaultdict(float)
    for x in words:
        m.expect(x, 2.0, one)
    m.expect_all([(x, 2) for x in words], all_)
    assert dict(all_) == pytest.approx(dict(one))


#: Words whose probability leaves the range of floats, or nearly so.
FAINT = ["人工智能" * 17 + "人", "สวัสดีครับ" * 9, "😀" * 60, "😀" * 14, "0123456789abcdef" * 4, "9f86d081884c7d65" * 7, "😀" * 30 + "the" + "😀" * 30 + "nation", "z" * 3000]


def test_expected_counts_of_faint_words():
    m = lattice.Lattice(lattice.file_weights(lattice.vocabulary()))
    rows = [(w, k + 1) for k, w in enumerate(sorted({*FAINT, "😀" * 59 + "a", "the", "nation"}))]
    one, all_ = defaultdict(float), defaultdict(float)
    for w, c in rows:
        m.expect(w, c, one)
    m.expect_all(rows, all_)
    assert dict(all_) == pytest.approx(dict(one), rel=1e-6, abs=1e-9)


def test_scores_with_faint_training_words(spark):
    df = spark.createDataFrame([(k, f"plain words {w}") for k, w in enumerate(FAINT)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lattice.score(df, crc_of("doc_id") < 0, lattice.vocabulary()).collect()}
    assert sorted(got) == list(range(len(FAINT)))
    assert all(not r["held_out"] and math.isfinite(r["score"]) for r in got.values())


def test_base_scores(docs, rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = {i: [*WORD.findall(low(t)), "\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i in toks if not held[i] for w in toks[i])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lattice.score(docs, crc_of("doc_id") % 7 == 2, lattice.vocabulary(), block_bytes=5000).collect()}
    for i, ws in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert math.isfinite(r["score"]) and r["score"] < 0


# ---- toxicity


def test_deobfuscation():
    text = " ".join(["idiot moron stupid trash hello worthless loser"] * 50)
    m = toxicity.CharModel(toxicity.trigrams(text))
    for token, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuupid", "stupid"), ("tr@sh", "trash"), ("st.u.p.i.d", "stupid"), ("hello", "hello")):
        assert word in toxicity.readings(token, m), token
    assert any("idiot" in toxicity.readings(t, m) for t in toxicity.tokens("you i d i o t"))


def test_long_tokens_are_decoded_whole():
    m = toxicity.CharModel(toxicity.trigrams("idiot moron stupid trash hello worthless loser " * 50))
    assert m.restore("st" + "u" * 70 + "pid") == "stupid"
    assert "=stupid" in toxicity.features("st" + "u" * 5000 + "p1d", m)


def test_spaces_are_in_the_lattice():
    m = toxicity.CharModel(toxicity.trigrams("you are an idiot and a shit ass . he is stupid trash . what a fuck . hello there my worthless friend . my ass , your ass . " * 50))
    found = lambda t: {f for x in {*toxicity.tokens(t), *toxicity.open_spans(t, m)} for f in toxicity.features(x, m)}
    for text, word in (("s h ! t", "shit"), ("a $ $", "ass"), ("an id iot", "idiot"), ("f uck", "fuck"), ("y o u i d i o t", "idiot"), ("he is s t u p 1 d", "stupid"), ("y o u  a r e  t r @ s h", "trash"), ("s. h. !. t", "shit"), ("sh ! t", "shit"), ("y o u i d i o t " * 40, "idiot")):
        assert "=" + word in found(text), text
    for plain in ("hello there my friend", "one", "", " \n", "1 2 3 4", "| | |", "-- - --"):
        assert not toxicity.open_spans(plain, m), plain


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    bad = ["vile", "nasty"]
    texts = [(k, " ".join(rng.choice(["sun", "rain", "tree", "stone"]) for _ in range(20)) + (f" {rng.choice(bad)} ." if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(240)]
    df = frame(spark, [(k, t) for k, t, _ in texts] + [(9001, None), (9002, "")])
    lab = spark.createDataFrame([(k, y) for k, _, y in texts], "doc_id long, toxic int")
    held = crc_of("doc_id") % 5 == 0
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.fit(df, lab, ~held)).collect()}
    assert all((got[k] >= 0.5) == bool(y) for k, _, y in texts)
    assert got[9001] == got[9002] < 0.5


def test_toxicity_without_labels(spark, docs):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, lab, crc_of("doc_id") >= 0)).collect()} == {0.5}


# ---- empty tables and the pipeline


def test_empty_tables(empty):
    held = crc_of("doc_id") % 7 == 2
    for out in (
        bpe.encode(empty, bpe.vocabulary()), packing.assign(packing.pieces(empty, bpe.vocabulary())), quality.judge(empty), quality.clean(empty), pii.label(empty), pii.mask(empty),
        jaccard.linked_components(empty), digest.compared_with_next(empty), suffix.remove_repeats(empty), suffix.without_repeats(empty), lattice.score(empty, held, lattice.vocabulary()),
    ):
        assert out.count() == 0


def test_pipeline_is_its_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = {i: quality.measure(t) for i, t in texts.items()}
    left = [(i, m[7]) for i, m in judged.items() if m[6]]
    s = sets_of(left, 5)
    near = {(a, b) for a in s for b in s if a != b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert kept <= {i for i, _ in left} and not any(a in kept and b in kept for a, b in near)
    assert all(i in kept or any(a == i for a, _ in near) for i, _ in left)
    lib, want = Tokenizer.from_file(bpe.vocabulary()), {}
    for i, b in brute_repeats([(i, t) for i, t in left if i in kept], 200, "first").items():
        want[i] = b
    for i in kept:
        parts = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = [int.from_bytes(x, "little") for p in parts for x in (p["ids"][k : k + 4] for k in range(0, len(p["ids"]), 4))]
        text = want[i].decode(errors="ignore")
        if not base_spans(text) and want[i].decode(errors="replace") == text:
            assert ids == [*lib.encode(text, add_special_tokens=False).ids, 0]


# ---- the registered queries, with null ids and repeated rows


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """Tables in which some rows have no id and some come twice, and the (id, text) rows of documents."""
    path = tmp_path_factory.mktemp("sf")
    some = [*rows, rows[9], rows[14], (None, rows[9][1]), (None, "no id here " * 60), (None, None)]
    frame(spark, some).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 2)) for i, _ in rows[::2]] + [(rows[0][0], 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(k, f"http://h/{k}", t) for k, t in some if k is not None], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return str(path), some


def sha(data):
    return hashlib.sha256(data).hexdigest()


def answers(spark, folder, name, *columns):
    from episodica.llm.queries import QUERIES

    return Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder[0]).collect())


def test_query_of_scores(spark, folder):
    got = answers(spark, folder, "op1_toxicity", "doc_id", "held_out")
    assert got == Counter((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, _ in folder[1])
    for _, score, predicted in answers(spark, folder, "op1_toxicity", "doc_id", "score", "predicted"):
        assert 0 <= score <= 1 and predicted == int(score >= 0.5)


def test_query_of_pieces(spark, folder):
    lib, want = Tokenizer.from_file(bpe.vocabulary()), Counter()
    for i, t in folder[1]:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert answers(spark, folder, "op2_packing", "doc_id", "piece", "start", "length", "ids_crc32") == want
    bins = defaultdict(list)
    for (s, o, n), times in answers(spark, folder, "op2_packing", "sequence_id", "offset", "length").items():
        bins[s] += [(o, n)] * times
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048


def test_query_of_personal_data(spark, folder):
    want = Counter()
    for i, t in folder[1]:
        b = base_spans(t or "")
        want[(i, *(b.count(f"{k}:") for k in pii.KINDS), sha(b.encode()))] += 1
    assert answers(spark, folder, "op3_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_query_of_components_and_repeats(spark, folder):
    some = folder[1]
    s = sets_of(list(enumerate(t for _, t in some)), 4)
    near = {k: {j for j in s if s[j] and s[k] and 100 * len(s[j] & s[k]) >= 85 * len(s[j] | s[k])} | {k} for k in s}
    want = Counter()
    for k, (i, _) in enumerate(some):
        reach, open_ = {k}, [k]
        while open_:
            more = near[open_.pop()] - reach
            reach |= more
            open_ += more
        ids = [some[j][0] for j in reach if some[j][0] is not None]
        want[i, len(s[k]), (min(ids) if ids else None) if s[k] else i] += 1
    assert answers(spark, folder, "op5_jaccard", "doc_id", "n_shingles", "component_id") == want
    kept = brute_repeats(list(enumerate(t for _, t in some)), 200, "none")
    want = Counter((i, len((t or "").encode()), len((t or "").encode()) - len(kept[k]), sha(kept[k])) for k, (i, t) in enumerate(some))
    assert answers(spark, folder, "op8_suffix", "doc_id", "n_bytes", "n_removed", "kept_sha256") == want


def test_queries_of_digests_and_encodings(spark, folder):
    lib, some = Tokenizer.from_file(bpe.vocabulary()), folder[1]
    got = answers(spark, folder, "op6_digest", "doc_id", "n_chars", "fingerprint")
    assert got == Counter((i, len(t or ""), digest.fingerprint(t)) for i, t in some)
    want = Counter()
    for i, t in some:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(lib.decode(ids, skip_special_tokens=False).encode())] += 1
    assert answers(spark, folder, "op7_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_queries_of_language_model_quality_and_archives(spark, folder):
    some = folder[1]
    got = answers(spark, folder, "op9_lattice", "doc_id", "held_out", "n_tokens")
    assert got == Counter((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len((t or "").encode().split()) + 1) for i, t in some)
    got = answers(spark, folder, "op10_quality", "doc_id", "n_words", "base_failed", "kept")
    assert got == Counter((i, *(quality.measure(t)[k] for k in (0, 5, 6))) for i, t in some)
    pages = [(i, t or "") for i, t in some if i is not None]
    first = {t: min(i for i, u in pages if u == t) for _, t in pages}
    want = Counter((i, len(t.encode()), warc.digest(t.encode()), "response" if first[t] == i else "revisit", None if first[t] == i else first[t]) for i, t in pages)
    assert answers(spark, folder, "op4_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_scores_are_those_of_the_formula(spark):
    """score against segmentations enumerated one by one, with the fitted weights."""
    texts = ["ab abab", "aab", "ab ab b", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = crc_of("doc_id") < 0
    got = {r["doc_id"]: r["score"] for r in lattice.score(df, held, lattice.vocabulary()).collect()}
    c = Counter(w for t in texts for w in t.split())
    counts = spark.createDataFrame([(w.encode(), k) for w, k in c.items()], "word binary, c long")
    w = lattice.fitted(counts, lattice.file_weights(lattice.vocabulary()))

    def total(s):
        return 1.0 if not s else sum(math.exp(w[s[:k]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in w)

    n, v = sum(c.values()) + len(texts), len(c)
    for i, t in enumerate(texts):
        ps = [max(c[x] - lattice.DISCOUNT, 0) / n + lattice.DISCOUNT * v / n * total("▁" + x) for x in t.split()]
        assert got[i] == pytest.approx(sum(map(math.log10, ps)) + math.log10(len(texts) / n))


def test_toxicity_runs_of_letters_are_decoded_as_one():
    """Decoding in runs, and spans from texts in either encoding, give what letter by letter gives."""
    from episodica.llm import toxicity as X

    model = X.CharModel(X.trigrams("you are an idiot stop it now, the table is stable and a fool would follow " * 40))
    whole = ["stable\ntable", "id\niot", "1d10t\nstable", "f00l\nwould\nfollow", "sttable", "|\nstable\n|", "über\nstable", "st-able"]
    fast = [model.restore(w) for w in whole]
    held, X.RUN = X.RUN, X.re.compile(r"(?!)")
    try:
        assert fast == [model.restore(w) for w in whole]
    finally:
        X.RUN = held
    text = "you are an id iot and s t u p i d the ta ble 1 d | o t"
    assert X.open_spans(text, model) == X.open_spans("%中% " + text, model) and X.open_spans(text, model)
    scorer = X.Scorer(X.trigrams(text), {"=idiot": 2.0, "idio": 1.0, "stu": 0.5}, 0.0)
    for t in ("idiot", "idiots.", "stuff", "other", "1d10t"):
        assert set(scorer.features(t)) == {scorer.index[f] for f in X.features(t, scorer.model) if f in scorer.index}
