"""Models by task and phase against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import phases as H
from episodica.operators.windows import Series


def ledoit_wolf(x, centred=False):
    """The shrunk covariance from its definition, with all rows at hand."""
    n, p = x.shape
    x = x if centred else x - x.mean(0)
    cov = x.T @ x / n
    mu = np.trace(cov) / p
    far = ((cov - mu * np.eye(p)) ** 2).sum() / p
    noise = sum(((np.outer(r, r) - cov) ** 2).sum() for r in x) / n**2 / p
    share = min(noise, far) / far
    return (1 - share) * cov + share * mu * np.eye(p)


@pytest.mark.parametrize("dims", [2, 5])
def test_shrinkage_from_moments_equals_its_definition(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(70, dims)) @ rng.normal(size=(dims, dims)) + 3
    g = rng.integers(0, 3, 70)
    rows = [(int(k), v.tolist(), "m") for k, v in zip(g, x)] + [(0, None, "m"), (1, [1.0], "m"), (2, [float("nan")] * dims, "m")]
    df = spark.createDataFrame(rows, "g int, v array<double>, m string").repartition(4)
    for r in H.keyed_moments(df, ["g"], "v", dims).collect():
        own = x[g == r["g"]]
        mean, precision, share = H.shrunk(np.array(r["m"]), dims)
        assert r["m"][0] == len(own) and mean == pytest.approx(own.mean(0))
        assert np.linalg.inv(precision) == pytest.approx(ledoit_wolf(own), rel=1e-6) and 0 <= share <= 1
    every = np.array(H.keyed_moments(df, [], "v", dims).head()["m"])
    assert np.linalg.inv(H.shrunk(every, dims, centred=True)[1]) == pytest.approx(ledoit_wolf(x, centred=True), rel=1e-6)


def test_back_off_takes_the_narrowest_level_with_enough_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(1, 0.1, rng.normal(size=2)) for _ in range(30)] + [(1, 0.9, rng.normal(size=2) + 5) for _ in range(5)] + [(2, 0.5, rng.normal(size=2)) for _ in range(4)]
    df = spark.createDataFrame([(t, p, v.tolist()) for t, p, v in rows] + [(9, 0.5, [0.0, 0.0])], "task int, phase double, v array<double>")
    fit = F.col("task") < 9
    got = H.dynamics_density(df, fit, "task", "v", "phase", 2, least=20).collect()
    level = {(r["task"], r["phase"]): r["level"] for r in got}
    assert level == {(1, 0.1): "cell", (1, 0.9): "task", (2, 0.5): "all", (9, 0.5): "all"}
    cell = np.array([v for t, p, v in rows if (t, p) == (1, 0.1)])
    d = np.array([r["score"] for r in got if (r["task"], r["phase"]) == (1, 0.1)])
    want = np.einsum("ij,jk,ik->i", cell - cell.mean(0), np.linalg.inv(ledoit_wolf(cell)), cell - cell.mean(0)) / 2
    assert sorted(d) == pytest.approx(sorted(want))


def test_ridge_of_a_small_task_is_that_of_all(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    y = np.clip(0.5 + x @ [0.1, -0.05] + 0.01 * rng.normal(size=120), 0, 1)
    task = np.where(np.arange(120) < 100, 1, 2)
    df = spark.createDataFrame([(int(t), v.tolist(), float(p)) for t, v, p in zip(task, x, y)], "task int, v array<double>, y double")
    got = {tuple(r["v"]): r["phase"] for r in H.phase_ridge(df, F.lit(True), "task", "v", "y", 2, least=64).collect()}
    for t, rows in ((1, task == 1), (2, task > 0)):
        c = x[rows] - x[rows].mean(0)
        w = np.linalg.solve(c.T @ c + 10 * np.eye(2), c.T @ (y[rows] - y[rows].mean()))
        for v in x[task == t]:
            assert got[tuple(v)] == pytest.approx(np.clip((v - x[rows].mean(0)) @ w + y[rows].mean(), 0, 1))


def test_percentiles_back_off_and_count_references_only(spark):
    rows = [(1, 0.1, float(k), k % 2 == 0) for k in range(20)] + [(1, 0.9, 3.5, True), (2, 0.5, 7.0, False), (1, 0.1, None, False)]
    df = spark.createDataFrame(rows, "task int, phase double, x double, ok boolean")
    got = {(r["task"], r["phase"], r["x"]): r["percentile"] for r in H.phase_percentile(df, F.col("ok"), "task", "x", "phase", least=5).collect()}
    cell = [x for t, p, x, ok in rows if ok and p == 0.1]
    own = [x for t, p, x, ok in rows if ok]
    assert got[1, 0.1, 7.0] == (sum(x <= 7 for x in cell) + 0.5) / (len(cell) + 1)
    assert got[1, 0.9, 3.5] == (sum(x <= 3.5 for x in own) + 0.5) / (len(own) + 1)
    assert got[2, 0.5, 7.0] == (sum(x <= 7 for x in own) + 0.5) / (len(own) + 1) and got[1, 0.1, None] is None


def test_returns_are_counted_by_state(spark):
    p = [0.95, 0.95, 0.95, 0.5, 0.95, 0.95, 0.95, 0.95, 0.95, 0.95]
    df = spark.createDataFrame([(1, q, v, 0.1 * q) for q, v in enumerate(p)], "ep int, q int, p double, phase double")
    got = {r["q"]: r for r in H.healthy_return(df, Series(), F.lit(True), "p", "phase", least=2).collect()}
    assert [got[q]["dwell"] for q in range(10)] == [1, 2, 3, 0, 1, 2, 3, 4, 5, 6]
    # steps 0 to 6 count; of level 3 with dwell 1 (steps 0 and 4) the first came back
    assert got[4]["level"] == 3 and got[4]["velocity_bin"] == 2 and got[4]["chance"] == pytest.approx((1 + 2) / (2 + 4))
    assert got[3]["chance"] == pytest.approx((3 + 2) / (7 + 4))  # one step of its level: all steps decide


def test_anchor_scores_are_highest_at_what_the_onsets_look_like(spark):
    rng = np.random.default_rng(3)
    rows = [(ep, q, (rng.normal(size=2) * 0.1 + ([3.0, -3.0] if q == 5 else [0.0, 0.0])).tolist(), 5 if ep < 6 else None) for ep in range(8) for q in range(10)]
    df = spark.createDataFrame(rows, "ep int, q int, v array<double>, onset int")
    got = H.anchor_template(df, Series(), "onset", F.lit(True), "v", 2, offsets=(0,)).collect()
    best = {ep: max((r for r in got if r["ep"] == ep), key=lambda r: r["score"])["q"] for ep in range(8)}
    assert set(best.values()) == {5} and all(r["score"] <= 0 for r in got)
    with pytest.raises(ValueError, match="enough vectors"):
        H.anchor_template(df.where("ep > 5"), Series(), "onset", F.lit(True), "v", 2)


# ---- site graphs


def test_uniform_and_one_hot_sites(spark):
    from episodica.operators import graphs as R

    uniform, single = np.ones((5, 8)), np.eye(8)[[2] * 5]
    rows = [(1, uniform.ravel().tolist()), (2, single.ravel().tolist()), (3, None), (4, [1.0]), (5, [float("nan")] * 40), (6, [0.0] * 40)]
    got = {r["i"]: r for r in R.graph_block(spark.createDataFrame(rows, "i int, v array<double>"), "i", "v", 5, 8).collect()}
    assert set(got) == {1, 2, 6} and not any(np.isnan(got[6][a]) for a in R.AXES)
    assert [round(got[1][a], 9) for a in R.AXES[:10]] == [0, 1, 1 / 8, 1 / 2, 0, 1, 0, 1, 1, 0]
    assert [round(got[2][a], 9) for a in R.AXES[:10]] == [1, 0, 1, 1, 1, 1, 0, 1, 1, 0]
    spread = R.axes(np.eye(8)[None, :4])[0]  # four tokens, each on an expert of its own
    assert spread[R.AXES.index("effective_rank")] == pytest.approx(4) and spread[R.AXES.index("consensus")] == 0
    assert spread[R.AXES.index("mutual_information")] == pytest.approx(np.log(4) / np.log(8))
