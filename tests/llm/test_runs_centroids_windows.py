"""Periodic runs, centroid clustering and decontamination against brute force, with nulls, repeats, ties and odd columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from episodica.llm import centroids, decontam, periods

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

# ---- runs


def all_runs(w):
    """Every period, every stretch of words that far apart which agree."""
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(12, 2 * p):
                best.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in best.items())


def test_runs_equal_all_periods():
    rng, seen = random.Random(3), 0
    for _ in range(1500):
        n, letters = rng.randint(0, 90), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            s, q = rng.randrange(n), rng.randint(1, 20)
            w[s:] = [w[s + (i % q)] if s + i % q < n else 0 for i in range(n - s)]
        want = all_runs(w)
        seen += len(want)
        assert periods.runs(periods.interned([str(x) for x in w])) == want
    assert seen > 500


def test_z_values_are_the_longest_common_starts():
    rng = random.Random(1)
    for _ in range(300):
        a = np.array([rng.randrange(2) for _ in range(rng.randint(1, 120))])
        z = dict(zip(*(x.tolist() for x in periods.z_values(a, 0))))
        for i in range(1, len(a)):
            k = 0
            while i + k < len(a) and a[i + k] == a[k]:
                k += 1
            assert z.get(i, 0) == k


def test_long_repetitive_texts_are_read_whole():
    assert periods.runs(periods.interned(["a"] * 50_000)) == [(0, 50_000, 1)]
    w = [f"w{k}" for k in range(9000)]
    assert periods.runs(periods.interned(["x", *w, *w, *w, "y"])) == [(1, 27_000, 9000)]


RUN_TEXTS = [None, "", " \n", "a", "a " * 11, "a " * 12, "b c " * 40 + "d", ("one two three four five six seven " * 3).strip(), "x\x1cy " * 20, "é\xa0 ü " * 9] + [" ".join(random.Random(k).choice("abc") for _ in range(60)) for k in range(20)]


def test_periods_query_equals_its_definition(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(RUN_TEXTS)] + [(3, "a " * 30, "clash", 1), (3, "a " * 30, "clash", 1), (None, "p q " * 20, "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n_runs int").repartition(3)
    got = sorted(map(tuple, periods.detect(df, change=periods.loop_tail).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(b"" if i is None else str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        runs = all_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=str)
    assert periods.detect(df.where("false")).count() == 0


def test_collapse_keeps_the_space_between_words_that_stay(spark):
    df = spark.createDataFrame([(1, "So  it goes:\tho " + "ho " * 20 + "end.\n", "z", 9), (2, "plain  text", "z", 0), (3, None, "z", 0)], "doc_id long, text string, id string, n_chars long")
    got = {r["doc_id"]: r for r in periods.collapse(df).collect()}
    assert got[1]["text"] == "So  it goes:\tho end.\n" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "plain  text" and got[3]["text"] is None


# ---- centroids


def lloyd(vectors, k, rounds):
    """Direct rounds over (id, integers), in Python integers."""
    order = sorted(range(len(vectors)), key=lambda i: (sha(f"2:{'' if vectors[i][0] is None else vectors[i][0]}"), vectors[i][1]))
    c = [list(vectors[i][1]) for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in vectors]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(vectors, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *near(v)[::-1]) for i, v in vectors], c


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "o") for i, v in rows], "vec_id long, embedding array<double>, distance int, owner string").repartition(3)


@pytest.mark.parametrize("scale", [1.0, 3e4])  # beyond the bound of exact products in doubles too
def test_delta_rounds_equal_direct_rounds(spark, scale):
    rng = random.Random(5)
    rows = [(i, [round(rng.gauss(i % 7, 2), 3) * scale for _ in range(4)]) for i in range(240)]
    rows += rows[:3] + [(3, [0.0] * 4), (3, [0.0] * 4), (None, [1.0, 2.0, 3.0, 4.0])] + [(500 + i, [5.0] * 4) for i in range(40)]
    bad = [(900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]), (903, [1.0, float("nan"), 1.0, 1.0]), (904, [float("inf")] * 4), (905, [])]
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for rounds in (0, 1, 5, 60):
        state, c = centroids.cluster(frame(spark, rows + bad), "vec_id", "embedding", 12, rounds, 4)
        want, direct = lloyd(ints, 12, rounds)
        assert c.tolist() == direct
        got = [(r["id"], r["owner"], r["distance"]) for r in state.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    shown = centroids.described(state, c).collect()
    assert {r["inertia"] for r in shown} == {sum(d for _, _, d in want)}
    for r in shown:
        assert r["cluster_inertia"] == sum(d for _, o, d in want if o == r["cluster"])
        assert r["centroid_sha256"] == sha(",".join(map(str, direct[r["cluster"]])))


def test_few_and_no_vectors(spark):
    state, c = centroids.cluster(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])]), "vec_id", "embedding", 40, 5, 2)
    assert len(c) == 2 and sorted(r["distance"] for r in state.collect()) == [0, 0]
    state, c = centroids.cluster(frame(spark, [(1, None)]), "vec_id", "embedding", 40, 5, 2)
    assert len(c) == 0 and centroids.described(state, c).count() == 0


def test_huge_components_are_bounded():
    assert centroids.integers(np.array([1e300, -1e300, 0.999]), 256).tolist() == [centroids.MOST, -centroids.MOST, 255]


# ---- decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, u in items:
            v = words(u)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(8)
    common = ["of", "the", "and", "a", "Ünï", "x9"]
    line = lambda n, v=60: " ".join(rng.choice([*common, *(f"w{rng.randrange(v)}" for _ in range(4))]) for _ in range(n))
    items = [(k, line(rng.randint(9, 40))) for k in range(12)] + [(20, "one"), (21, "Two WORDS"), (22, "three of these"), (23, None), (24, "..."), (None, line(12)), (25, "of the " * 12), (30, "the the the the the the the the the the the")]
    items += [(26, items[0][1].upper()), (26, items[1][1]), (7, items[2][1])]
    parts = [words(t) for _, t in items if t]
    docs = [(0, None), (1, ""), (2, "one"), (3, "TWO, words!"), (4, "the " * 30), (5, "of the " * 9)]
    for k in range(60):
        v = rng.choice(parts)
        s = rng.randrange(len(v)) if v else 0
        docs.append((10 + k, f"{line(rng.randint(0, 30))} {'; '.join(v[s : s + rng.randint(5, 20)])} {line(rng.randint(0, 9))}"))
    docs += [(10, items[0][1]), (10, items[0][1]), (None, items[1][1] + " " + items[1][1]), (99, line(20000))]
    return docs, items


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "p", "w") for i, t in docs], "doc_id long, text string, rid int, place string, words string").repartition(3)
    return d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, `class` int")


@pytest.mark.parametrize("most", [decontam.BROADCAST_ROWS, 5])
def test_decontamination_equals_brute_force(spark, bench, most):
    docs, items = bench
    got = decontam.decontaminate(*tables(spark, docs, items), broadcast_rows=most).collect()
    want = leaks(docs, items)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 10 < sum(w[-1] for w in want) < len(want)


def test_decontamination_of_empty_tables(spark, bench):
    docs, items = bench
    d, b = tables(spark, docs, items)
    got = decontam.decontaminate(d, b.where("false")).collect()
    assert len(got) == len(docs) and not any(r["contaminated"] for r in got)
    assert decontam.decontaminate(d.where("false"), b).count() == 0


def test_decontamination_runs_in_the_jvm(spark, bench):
    plan = decontam.decontaminate(*tables(spark, *bench))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
