"""Fitted models against direct computations, and transfer features on paths whose answers are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import transfer as T
from episodica.operators import logistic as L
from episodica.operators import mixture as X
from episodica.operators.windows import Series


def newton(x, y, cost, strength=1.0, steps=200):
    """Gradient descent to the end on one training set, by plain Newton steps in numpy."""
    z, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    pen = np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(strength * (z * (cost * p * (1 - p))[:, None]).T @ z + pen, strength * z.T @ (cost * (p - y)) + pen @ w)
    return w


@pytest.mark.parametrize("balanced", [False, True])
def test_folds_equal_a_direct_solver(spark, balanced):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 3, -2]
    y = (x @ [1.0, -0.3, 4.0] + rng.normal(size=300) > -9).astype(int)
    g = rng.integers(0, 6, 300)
    df = spark.createDataFrame([(int(a), int(b), *map(float, c)) for a, b, c in zip(g, y, x)], "g int, y int, f1 double, f2 double, f3 double").repartition(4)
    folds = L.fitted(df, "g", "y", ["f1", "f2", "f3"], balanced=balanced)
    for k, key in enumerate(folds.keys):
        t = g != key
        mean, sd = x[t].mean(0), x[t].std(0)
        n, pos = t.sum(), y[t].sum()
        cost = np.where(y[t] == 1, n / (2 * pos), n / (2 * (n - pos))) if balanced else np.ones(n)
        assert folds.w[k] == pytest.approx(newton((x[t] - mean) / sd, y[t], cost), abs=1e-6)


def test_separable_and_single_class_folds(spark):
    rows = [(0, 1, float(k)) for k in range(5)] + [(1, 0, float(-k)) for k in range(5)] + [(2, 1, 7.0), (2, None, 1.0), (1, 0, None), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "g int, y int, f double")
    got = L.out_of_fold(df, "g", "y", ["f"], single=0.5).collect()
    assert len(got) == len(rows)
    for r in got:  # without group 1 all labels are 1; without group 0 both classes are left and apart
        if r["g"] is None or r["f"] is None and r["g"] != 1:
            assert r["probability"] is None
        elif r["g"] == 1:
            assert r["probability"] == 0.5
        else:
            assert 0 < r["probability"] < 1
    assert {r["probability"] for r in L.out_of_fold(df, "g", "y", ["f"]).collect() if r["g"] == 1} == {1.0}


def test_mixture_finds_separate_heaps_and_never_loses_likelihood(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, s, (150, 2)) for c, s in ((-8, 0.5), (0, 1.0), (9, 2.0))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    m = X.fit(df, "id", "v", 2, 3, seed=1, tolerance=1e-6)
    assert m.converged and all(b >= a - 1e-9 for a, b in zip(m.bounds, m.bounds[1:]))
    got = {r["id"]: r for r in X.tokenise(df, "id", "v", m).collect()}
    assert len(got) == 450
    heaps = [{got[i]["word"] for i in range(k * 150, k * 150 + 150)} for k in range(3)]
    assert [len(h) for h in heaps] == [1, 1, 1] and len(set.union(*heaps)) == 3
    for i in (0, 200, 449):
        w = [math.log(m.weights[k]) - 0.5 * sum(math.log(2 * math.pi * s) + (a - u) ** 2 / s for a, u, s in zip(x[i], m.means[k], m.variances[k])) for k in range(3)]
        assert got[i]["lexical"] == pytest.approx(math.log(sum(map(math.exp, w))))
    use = X.vocabulary_use(X.tokenise(df, "id", "v", m), 3).collect()
    assert sorted(r["n"] for r in use) == [150, 150, 150] and use[0]["effective_words"] == pytest.approx(3.0)


def test_mixture_needs_enough_different_rows_and_keeps_empty_words(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "id long, v array<double>")
    with pytest.raises(ValueError, match="different vectors"):
        X.fit(same, "id", "v", 2, 3)
    model = X.Mixture(np.array([0.5, 0.5]), np.array([[1.0, 2.0], [1e6, 1e6]]), np.ones((2, 2)), [])
    got = X.summed(same, "v", 2, model)
    assert got[0, 1] == pytest.approx(20) and got[1, 1] < X.LEAST


# ---- transfer


def paths(spark, **named):
    names = list(named)
    return spark.createDataFrame([tuple(x.tolist() for x in named.values())], ", ".join(f"{n} array<array<double>>" for n in names))


def test_identical_paths_have_no_gap(spark):
    f = np.random.default_rng(1).random((10, 4))
    r = T.flow(paths(spark, front=f, back=f)).head()
    for name in ("gap_initial", "gap_terminal", "gap_path", "gap_endpoint", "gap_curvature", "handoff_delay", "mixed_velocity", "back_front_path_log_ratio", "settling_difference"):
        assert r[name] == pytest.approx(0, abs=1e-9)
    assert r["velocity_alignment_mean"] == pytest.approx(1) and r["terminal_alignment"] == pytest.approx(1)


@pytest.mark.parametrize("lag,name", [(1, "p1"), (2, "p2"), (-1, "m1"), (-2, "m2")])
def test_a_back_path_that_follows_is_found_at_its_lag(spark, lag, name):
    moves = np.random.default_rng(2).normal(size=(15, 6))
    path = lambda start: np.cumsum(moves[start : start + 10], 0)
    df = paths(spark, front=path(3), back=path(3 - lag))
    flow, channel = T.flow(df).head(), T.channel(df).head()
    lags = {n: flow[f"lag_alignment_{n}"] for n in ("m2", "m1", "p1", "p2")}
    assert max(lags, key=lags.get) == name and lags[name] == pytest.approx(1)
    assert channel[f"speed_lag_correlation_{name}"] == pytest.approx(1)


def test_late_movement_behind_early_movement_is_a_positive_delay(spark):
    early, late = np.zeros((10, 2)), np.zeros((10, 2))
    early[2:], late[8:] = 1.0, 1.0
    assert T.flow(paths(spark, front=early, back=late)).head()["handoff_delay"] == pytest.approx(6 / 9)
    assert T.channel(paths(spark, front=early, back=late)).head()["handoff_delay"] == pytest.approx(6 / 9)


def test_features_against_numpy(spark):
    rng = np.random.default_rng(5)
    f, b = rng.normal(size=(10, 3)), rng.normal(size=(10, 3))
    r = T.flow(paths(spark, front=f, back=b)).head()
    norm = lambda x: np.linalg.norm(x, axis=-1)
    gap, fs, bs, gs = b - f, norm(np.diff(f, axis=0)), norm(np.diff(b, axis=0)), norm(np.diff(b - f, axis=0))
    va = (np.diff(f, axis=0) * np.diff(b, axis=0)).sum(1) / fs / bs
    assert r["gap_curvature"] == pytest.approx(norm(np.diff(gap, 2, axis=0)).mean())
    assert r["gap_settling_log_ratio"] == pytest.approx(math.log(gs[-3:].mean() / gs[:3].mean()), abs=1e-6)
    assert r["velocity_alignment_late"] == pytest.approx(va[-3:].mean()) and r["velocity_opposition_fraction"] == pytest.approx((va < 0).mean())
    assert r["front_time_center"] == pytest.approx((fs * (np.arange(9) + 0.5) / 9).sum() / fs.sum())
    assert r["gap_efficiency"] == pytest.approx(norm(gap[-1] - gap[0]) / gs.sum())


def test_steps_look_back_only_and_wait_for_enough_of_them(spark):
    rng = np.random.default_rng(6)
    rows = [(1, q, rng.normal(size=2).tolist(), rng.normal(size=2).tolist(), float(rng.normal())) for q in range(12)]
    df = spark.createDataFrame(rows, "ep int, q int, a array<double>, b array<double>, x double")
    s = Series()
    for f in (lambda d: T.pair(d, s, "a", "b"), lambda d: T.channel_steps(d, s, "a", "b"), lambda d: T.scalar_steps(d, s, "x")):
        whole = {r["q"]: r for r in f(df).collect()}
        for r in f(df.where("q < 7")).collect():
            assert str(r) == str(whole[r["q"]])
        missing = {n: min(q for q in whole if whole[q][n] is not None) for n in f(df).columns if n not in df.columns}
        assert set(missing.values()) <= {1, 2, 3, 4} and whole[11].asDict().values()


# ---- permutation tests with vectors of draws


def test_hash_is_the_integer_formula():
    from episodica.operators import maxt

    got = maxt.hashed(7, np.arange(1, 4), np.array([0, 5, 2_147_483_640]))
    for i, u in enumerate([0, 5, 2_147_483_640]):
        for j, d in enumerate([1, 2, 3]):
            h = 12345
            for t in (7, d, u):
                h = (h * 48271 + t % 2147483647 * 69621 + 11) % 2147483647
            assert got[i, j] == pow(h, 5, 2147483647)


def test_label_maxt_equals_a_direct_count(spark):
    from episodica.operators import maxt

    rng = np.random.default_rng(1)
    units = [(u, int(rng.integers(0, 2)), "g" + str(u % 3)) for u in range(60)] + [(100 + u, 1, "all") for u in range(5)]
    rows = [(u, y, g, c, s, float(rng.integers(0, 6)) + 2 * y * (c == "good")) for u, y, g in units for c in ("good", "noise") for s in ("a", "b") for _ in range(2)]
    rows.append((3, units[3][1], units[3][2], "good", "a", None))
    df = spark.createDataFrame(rows, "u long, y int, g string, c string, s string, v double").repartition(4)
    n, stats = 40, {}
    for d in range(n + 1):
        label = {u: y for u, y, _ in units}
        if d:
            for g in {g for _, _, g in units}:
                own = [u for u, _, h in units if h == g]
                order = sorted(own, key=lambda u: maxt.hashed(7, np.array([d]), np.array([u]))[0, 0])
                m = sum(label[u] for u in own)
                for k, u in enumerate(order):
                    label[u] = int(k < m)
        for c in ("good", "noise"):
            wins = pairs = 0.0
            for s in ("a", "b"):
                pos = [r[5] for r in rows if r[3] == c and r[4] == s and r[5] is not None and label[r[0]]]
                neg = [r[5] for r in rows if r[3] == c and r[4] == s and r[5] is not None and not label[r[0]]]
                wins += sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
                pairs += len(pos) * len(neg)
            stats[d, c] = wins / pairs
    top = [max(abs(stats[d, c] - 0.5) for c in ("good", "noise")) for d in range(1, n + 1)]
    got = {r["c"]: r for r in maxt.label_maxt(df, "u", "y", "g", "c", "s", "v", n).collect()}
    for c in ("good", "noise"):
        assert got[c]["observed"] == pytest.approx(stats[0, c])
        assert got[c]["p"] == pytest.approx((1 + sum(t >= abs(stats[0, c] - 0.5) - 1e-12 for t in top)) / (n + 1))
    assert got["good"]["p"] < 0.05 < got["noise"]["p"]


def test_draws_do_not_copy_rows(spark):
    """The plan has no Generate or Expand over input rows, and as many shuffles for ten draws as for a thousand."""
    from episodica.operators import maxt

    df = spark.createDataFrame([(g, f"c{g % 3}", g / 7) for g in range(90)], "g long, c string, e double")
    sizes = []
    for n in (10, 1000):
        plan = maxt.sign_flip_maxt(df, "e", "g", "c", n)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("Repartition"))
    assert sizes[0] == sizes[1] <= 4
    p = {r["c"]: r["p"] for r in maxt.sign_flip_maxt(df.withColumn("e", F.lit(1.0) + F.col("e") / 100), "e", "g", "c", 99).collect()}
    assert set(p.values()) == {1 / 100}
    flat = df.withColumn("e", F.when(F.col("c") == "c0", F.lit(0.0)).otherwise(F.col("e")))
    assert {r["c"] for r in maxt.sign_flip_maxt(flat, "e", "g", "c", 9).collect()} == {"c1", "c2"}
