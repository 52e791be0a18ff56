"""Operators against direct computations, edge cases and properties."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import scalars as L
from episodica.functions import vectors as V
from episodica.operators import joins as J
from episodica.operators import models as M
from episodica.operators import select as T
from episodica.operators import sequence as G
from episodica.operators import stats as A
from episodica.operators import windows as W
from episodica.sources import io
from episodica.streaming import monitors

S = W.Series()


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(5)
    rows = [(e, q, rng.uniform(0, 120)) for e in range(6) for q in range(rng.randint(1, 25))]
    return spark.createDataFrame(rows, "ep long, q int, x double")


def one(spark, column):
    return spark.range(1).select(column.alias("y")).first()["y"]


def vec(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_uniform_vector_has_full_entropy_and_no_distance(spark):
    u = vec(*[0.25] * 4)
    assert one(spark, V.entropy(u, normal=True)) == pytest.approx(1)
    assert one(spark, V.hellinger(u, u)) == pytest.approx(0, abs=1e-7)
    assert one(spark, V.weighted_jaccard(u, u)) == pytest.approx(1)


def test_shuffled_support_has_no_distance(spark):
    a, b = F.array(*map(F.lit, [3, 1, 7, 5])), F.array(*map(F.lit, [7, 5, 1, 3]))
    assert one(spark, V.support_jaccard_distance(a, b)) == 0


def test_stored_support_wins_a_tie(spark):
    p = vec(0.3, 0.2, 0.2, 0.3)
    assert one(spark, V.support_boundary(p, F.array(F.lit(0), F.lit(3), F.lit(2)))) == 0


def test_normal_quantile(spark):
    for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.9999):
        assert one(spark, L.normal_quantile(F.lit(p))) == pytest.approx(statistics.NormalDist().inv_cdf(p), rel=1e-7, abs=1e-9)


def test_window_with_a_null_is_null_until_complete_again(spark):
    df = spark.createDataFrame([(1, q, None if q == 3 else float(q)) for q in range(9)], "ep int, q int, x double")
    got = {r["q"]: r["m"] for r in df.select("q", W.trailing_mean(S, "x", 3).alias("m")).collect()}
    assert [q for q, m in got.items() if m is None] == [0, 1, 3, 4, 5]


def test_run_resets(spark):
    df = spark.createDataFrame([(1, q, x) for q, x in enumerate([5.0, 5.0, 0.0, 5.0, 5.0, 5.0])], "ep int, q int, x double")
    got = W.run_length(df, S, F.col("x") > 1, "n").orderBy("q").collect()
    assert [r["n"] for r in got] == [1, 2, 0, 1, 2, 3]


def test_cusum_is_the_recursion(walk):
    got = {(r["ep"], r["q"]): r["cusum"] for r in W.cusum(walk, S, "x", 55.0).collect()}
    s, last = 0.0, None
    for r in walk.orderBy("ep", "q").collect():
        s = max(0.0, (s if r["ep"] == last else 0.0) + r["x"] - 55)
        last = r["ep"]
        assert got[r["ep"], r["q"]] == pytest.approx(s, abs=1e-9)


def test_prefix_does_not_see_the_future(walk):
    m = monitors.Monitor()
    whole = {(r["ep"], r["q"]): tuple(r) for r in monitors.batch(walk, m).collect()}
    part = monitors.batch(walk.where("q <= 7"), m).collect()
    assert part and all(whole[r["ep"], r["q"]] == tuple(r) for r in part)


def test_stream_equals_batch(spark, walk, tmp_path):
    m = monitors.Monitor(3, 2, 50.0)
    for k in range(0, 30, 5):
        walk.where(f"q >= {k} and q < {k + 5}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(walk.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitors.stream(src, m).writeStream.format("memory").queryName("monitored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["ep"], r["q"]): r for r in spark.table("monitored").collect()}
    want = monitors.batch(walk, m).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r["ep"], r["q"]]
        assert (g["run"], g["alarm"], g["first_alarm"]) == (r["run"], r["alarm"], r["first_alarm"])
        assert (g["smooth"] is None or math.isnan(g["smooth"])) if r["smooth"] is None else g["smooth"] == pytest.approx(r["smooth"])


def test_auc_counts_ties_half(spark):
    rows = [(1.0, 1), (1.0, 0), (2.0, 1), (0.0, 0)]
    assert A.auc(spark.createDataFrame(rows, "x double, y int"), "x", "y").first()["auc"] == pytest.approx(3.5 / 4)


def test_higher_quantile_never_interpolates(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert A.quantile_higher(df, "x", 0.5).first()["threshold"] == 5.0


def test_exact_tests():
    assert A.fisher_exact(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6)
    assert A.clopper_pearson(0, 10)[1] == pytest.approx(0.308497, abs=1e-5)
    assert A.clopper_pearson(5, 10) == pytest.approx((0.187086, 0.812914), abs=1e-5)


def test_validated_join_fails_on_repeated_keys(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="key is not unique"):
        J.validated_join(a, a.withColumnRenamed("v", "w"), ["k"]).collect()


def test_pareto_keeps_equal_rows(spark):
    df = spark.createDataFrame([(1, 5, 5), (2, 5, 5), (3, 4, 6), (4, 4, 5), (5, 6, 1)], "i int, x int, y int")
    assert sorted(r["i"] for r in T.pareto(df, "x", "y").collect()) == [1, 2, 3, 5]


def test_forward_filter_normalises(spark):
    t, e = [[0.9, 0.1], [0.2, 0.8]], [{"a": 0.7, "b": 0.3}, {"a": 0.1, "b": 0.9}]
    r = one(spark, G.forward_filter(F.array(F.lit("a"), F.lit("b")), [0.5, 0.5], t, e))
    b = np.array([0.5 * 0.7, 0.5 * 0.1])
    z = b.sum()
    b = (b / z) @ np.array(t) * [0.3, 0.9]
    assert r["belief"] == pytest.approx((b / b.sum()).tolist())
    assert r["evidence"] == pytest.approx(math.log(z) + math.log(b.sum()))


def test_moments_and_mahalanobis(spark):
    x = np.random.default_rng(3).normal(size=(50, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")
    n, s, o = M.moments(df, "v")
    assert n == 50 and s == pytest.approx(x.sum(0)) and o == pytest.approx(x.T @ x)
    assert sum(r["distance"] for r in M.mahalanobis(df, "i", "v", 0.0).collect()) == pytest.approx(50)


def test_dtw_of_a_slowed_template_is_zero():
    assert M.dtw_distance(np.array([1.0, 1, 2, 2, 3]), np.array([1.0, 2, 3])) == 0


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 2.5, None)], "i int, x double, s string")
    io.write_csv(df, str(tmp_path / "c"))
    io.write_json(df, str(tmp_path / "j"))
    want = [(1, None, "a"), (2, 2.5, None)]
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == want
    assert sorted(map(tuple, io.read_json(spark, str(tmp_path / "j"), df.schema, lines=True).collect())) == want
    found = io.discover(spark, str(tmp_path), r"/(?<kind>[cj])/part-").groupBy("kind").count().collect()
    assert {r["kind"] for r in found} == {"c", "j"}


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        io.append_once(df, str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_learn_then_test_selects_within_the_risk(spark):
    from episodica.operators import inference as I

    rows = [("a", float(i), False) for i in range(200)] + [("a", 190.0 + i, True) for i in range(20)]
    rows += [("b", float(i % 7), False) for i in range(200)] + [("b", 3.0, True)] * 20
    df = spark.createDataFrame(rows, "channel string, peak double, event boolean")
    got = {(r["channel"], r["quantile"]): r for r in I.learn_then_test(df, "channel", "peak", "event", (0.5, 0.95, 1.0), 0.1, 0.1).collect()}
    assert len(got) == 6 and [k for k, r in got.items() if r["selected"]] == [("a", 0.95)]
    r = got["a", 0.95]
    assert (r["threshold"], r["false_alarms"], r["healthy"], r["recall"]) == (189.0, 10, 200, 1.0)
    for r in got.values():  # accepted exactly if so few alarms would be rarer than the level at a rate of 0.1
        k, n = r["false_alarms"], r["healthy"]
        tail = sum(math.comb(n, i) * 0.1**i * 0.9 ** (n - i) for i in range(k + 1))
        assert r["accepted"] == (tail <= 0.1 / 6)


def test_rank_sum_counts_pairs(spark):
    from episodica.operators import inference as I

    rows = [(x, y) for x, y in zip([3, 1, 3, 2, 5, 3, None, 2], [1, 0, 0, 1, 1, 0, 1, 0])]
    df = spark.createDataFrame(rows, "x int, y int")
    [r] = I.rank_sum(df, "x", F.col("y") == 1).collect()
    full = [(x, y) for x, y in rows if x is not None]
    want = sum((a > b) + 0.5 * (a == b) for a, p in full if p for b, q in full if not q)
    assert r["u"] == want
    assert I.rank_sum(df.where("x > 9"), "x", F.col("y") == 1).count() == 0


def test_decay_skips_nulls_and_gaps(spark):
    """A missing value leaves the average as it was; steps need not be contiguous; blocks carry over."""
    rng = random.Random(3)
    for keep, n in ((0.5, 40), (0.001, 400)):  # the second has blocks of 108 values
        rows = [(ep, q * 3 + ep, None if rng.random() < 0.3 else rng.random(), f"t{q}") for ep in (1, 2) for q in range(n)]
        rows += [(3, 5, None, "x"), (3, 9, None, "y"), (3, 11, 2.0, "z")]
        df = spark.createDataFrame(rows, "ep int, q int, x double, tag string").repartition(3)
        want = {}
        for ep in (1, 2, 3):
            y, first = 0.0, None
            for _, q, x, _ in sorted(r for r in rows if r[0] == ep):
                if x is not None:
                    y = y * keep + x * (1 - keep)
                    first = x if first is None else first * keep + x * (1 - keep)
                want[ep, q] = (y, first)
        a = {(r["ep"], r["q"]): r for r in W.decayed(df, S, "x", keep, 1 - keep, "y").collect()}
        b = {(r["ep"], r["q"]): r for r in W.ewma(df, S, "x", 1 - keep, "y").collect()}
        assert len(a) == len(b) == len(rows) and a[3, 11]["tag"] == "z"
        for k, (y, first) in want.items():
            assert a[k]["y"] == pytest.approx(y, abs=1e-12)
            assert b[k]["y"] is first is None or b[k]["y"] == pytest.approx(first, abs=1e-12)


def test_cumulated_equals_sorted_counts(spark):
    from episodica.operators.ranked import cumulated

    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, *range(200)]), 1) for _ in range(900)] + [(1, 7, 1)] * 300
    df = spark.createDataFrame(rows, "g int, x int, w int").repartition(4)
    for group in ((), ("g",)):
        for r in cumulated(df, "x", *group, weight=F.col("w") * 2).collect():
            own = [x for g, x, _ in rows if not group or g == r["g"]]
            assert r["_all"] == 2 * len(own) and r["_n"] == 2 * own.count(r["x"])
            assert r["_upto"] == 2 * sum(x is None or (r["x"] is not None and x <= r["x"]) for x in own)


def test_matched_controls_are_counted_without_pairs(spark):
    from episodica.operators import joins as J

    cases = spark.createDataFrame([("a", 1, 5.0, 10), ("a", 1, None, 11), ("b", 1, 2.0, 12), ("a", 2, 1.0, 13)], "g string, q int, s double, e int")
    pool = spark.createDataFrame([("a", 1, v) for v in (1.0, 5.0, 5.0, 9.0, None)] + [("b", 1, 2.0)], "g string, q int, s double")
    got = {r["e"]: (r["controls"], r["best"], r["beaten"]) for r in J.matched_controls(cases, pool, ["g"], "q", "e", "s").collect()}
    assert got == {10: (5, 9.0, 0.4), 11: (5, 9.0, 0.0), 12: (1, 2.0, 0.5)}


def test_stationary_of_a_known_chain(spark):
    rows = [("a", "b", 0.5), ("a", "a", 0.5), ("b", "a", 0.25), ("b", "b", 0.75), ("c", "d", 1.0)]
    got = {r["state"]: r["share"] for r in A.stationary(spark.createDataFrame(rows, "s string, s2 string, p double"), 7).collect()}
    assert got["a"] == pytest.approx(0.5 / 3) and got["b"] == pytest.approx(1 / 3)  # half of all starts, as one to two
    assert got["d"] == pytest.approx(0.5) and "c" not in got  # d keeps what reaches it


def test_risk_set_with_and_without_the_onset(spark):
    steps = spark.createDataFrame([(1, q) for q in range(6)] + [(2, q) for q in range(3)], "ep int, q int")
    onsets = spark.createDataFrame([(1, 4)], "ep int, onset int")
    for through, last, near in ((False, 3, {2, 3}), (True, 4, {2, 3, 4})):
        got = J.risk_set(steps, onsets, "ep", "q", "onset", 2, through).collect()
        assert {r["q"] for r in got if r["ep"] == 1} == set(range(last + 1)) and {r["q"] for r in got if r["label"]} == near
        assert sum(r["ep"] == 2 for r in got) == 3


def test_nearest_neighbours_agree(spark):
    df = spark.createDataFrame([(1, "a", 0.0, True), (2, "a", 1.0, True), (3, "a", 5.0, False), (4, "b", 0.0, True)], "i int, c string, x double, f boolean")
    assert [tuple(r) for r in J.nn_concordance(df, ["c"], "i", "x", "f").collect()] == [("a", 3, 2)]


def test_kernel_ridge_of_a_large_group(spark):
    """A group of 40,000 rows, whose kernel would be 13 GB: few values, so a small weighted kernel gives the same."""
    i = F.col("id")
    x = F.when(i % 11 < 9, (i % 11) * 0.7 - 1).when(i % 11 == 9, 400.25).otherwise(-5000.5)
    df = spark.range(40_000).select(F.lit(1).alias("g"), F.when(i % 10 < 9, i % 3).alias("f"), x.alias("x"), (F.pmod(i * 7919, F.lit(13)) * 1.0).alias("y"))
    got = M.kernel_ridge_loco(df, "g", "f", "x", "y", lam=0.5, width=1.5).groupBy("f", "x").agg(F.min("predicted").alias("a"), F.max("predicted").alias("b"), F.count("*").alias("n")).collect()
    cells = {(r["f"], r["x"]): (r["n"], r["y"]) for r in df.groupBy("f", "x").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    values = np.array(sorted({x for _, x in cells}))
    k = np.exp(-((values[:, None] - values) ** 2) / (2 * 1.5**2))
    assert sum(r["n"] for r in got) == 40_000
    for r in got:
        if r["f"] is None:
            assert r["a"] is None
            continue
        n, y = (np.array([sum(c[t] for (f, at), c in cells.items() if f != r["f"] and at == v) for v in values], float) for t in (0, 1))
        mean = y.sum() / n.sum()
        a = np.linalg.solve(k + 0.5 * np.diag(1 / n), y / n - mean)
        want = k[list(values).index(r["x"])] @ a + mean
        assert abs(r["a"] - want) < 1e-8 and abs(r["b"] - want) < 1e-8


def test_kernel_ridge_without_values(spark):
    rows = [(1, 0, 1.0, 2.0), (1, 0, None, 3.0), (1, 1, 1.5, 4.0), (2, 0, 1.0, 2.0), (None, 0, 1.0, 2.0), (None, 1, 1.0, 4.0), (None, 1, None, 4.0), (None, 1, 99.0, None)]
    df = spark.createDataFrame(rows, "g int, f int, x double, y double")
    got = {(r["g"], r["f"], r["x"], r["y"]): r["predicted"] for r in M.kernel_ridge_loco(df, "g", "f", "x", "y").collect()}
    assert len(got) == len(rows)
    assert got[1, 0, 1.0, 2.0] == pytest.approx(4.0) and got[1, 0, None, 3.0] is None and got[2, 0, 1.0, 2.0] is None
    assert got[1, 1, 1.5, 4.0] is None  # its others have a missing value
    assert got[None, 1, 1.0, 4.0] == pytest.approx(2.0) and got[None, 1, 99.0, None] == pytest.approx(2.0) and got[None, 0, 1.0, 2.0] is None


def test_quantised_probability_of_a_long_vector(spark):
    """Totals are computed once, not for each entry: 20,000 entries would be 400 million."""
    n = 20_000
    df = spark.createDataFrame([(1, [float(i % 4) for i in range(n)]), (2, [0.0, 0.0]), (3, None)], "k int, a array<double>")
    got = {r["k"]: r["q"] for r in df.select("k", V.quantised(V.normalised("a"), 9).alias("q")).collect()}
    p = np.arange(n) % 4 / (np.arange(n) % 4).sum()
    want = (np.round(np.sqrt(p) * 511) / 511) ** 2
    assert np.allclose(got[1], want / want.sum(), rtol=1e-12) and got[2] == [0.5, 0.5] and got[3] is None
