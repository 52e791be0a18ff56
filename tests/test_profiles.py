"""Profile-driven guards: the fold against a step-by-step monitor, streams against batch, representations against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.plans import profiles as P
from episodica.streaming import folds
from episodica.streaming import guards as G

SF = "/root/testdata/sf0.001"


def by_steps(values, watched, one):
    """A monitor that sees one step at a time, in single precision."""
    f32 = np.float32
    sums, finite, run, first, out, before = [[f32(0)], [f32(0)]], [[0], [0]], [0, 0], [-1, -1], [], float("nan")
    for q, (base, w) in enumerate(zip(values, watched)):
        value = abs(f32(base) - f32(before)) if one["changes"] else f32(base)
        before = base
        crossed, means = [], []
        for k, (head, x) in enumerate((("lock", value), ("instability", f32(w)))):
            good = bool(np.isfinite(x))
            sums[k].append(f32(sums[k][-1] + (x if good else f32(0))))
            finite[k].append(finite[k][-1] + good)
            width = one[f"{head}_width"]
            mean = float("nan")
            if len(sums[k]) > width and finite[k][-1] - finite[k][-1 - width] == width:
                mean = f32(f32(sums[k][-1] - sums[k][-1 - width]) / width)
            means.append(float(mean))
            score = -float(mean) if head == "lock" and not one["high"] else float(mean)
            crossed.append(math.isfinite(score) and score > one[f"{head}_threshold"])
            run[k] = run[k] + 1 if crossed[k] else 0
            if run[k] >= one[f"{head}_confirmations"] and first[k] < 0:
                first[k] = q
        fired = [f for f in first if f >= 0]
        at = min(fired, default=-1)
        branch = "none" if at < 0 else "lock+instability" if first[0] == first[1] else "lock" if first[0] == at else "instability"
        out.append((q, "alarm" if fired else "suspect" if any(crossed) else "normal", at, branch, *first, *crossed, *run, *means))
    return out


ONE = {"changes": False, "high": False, "lock_width": 3, "lock_confirmations": 2, "lock_threshold": -0.4, "instability_width": 2, "instability_confirmations": 3, "instability_threshold": 0.45}


@pytest.mark.parametrize("changes,high", [(False, False), (True, False), (False, True), (True, True)])
def test_fold_in_chunks_equals_steps(changes, high):
    rng, branches = np.random.default_rng(4), set()
    for trial in range(60):
        n = int(rng.integers(1, 40))
        base, watched = rng.random(n).astype(np.float32), rng.random(n).astype(np.float32)
        base[0] = watched[0] = np.nan
        base[rng.random(n) < 0.1] = np.nan
        one = ONE | {"changes": changes, "high": high, "lock_threshold": 0.45 if high else -0.3 if changes else -0.5}
        want, got, fold, at = by_steps(base, watched, one), [], G.Fold(), 0
        while at < n:
            k = int(rng.integers(1, 9))
            q = np.arange(at, min(at + k, n))
            out = fold.take(q, {"base": base[q], "watched": watched[q]} | {c: np.full(len(q), v) for c, v in one.items()})
            fold = G.Fold.restored(fold.stored())
            got += zip(q.tolist(), *(out[c].tolist() for c in ("state", "first_alarm", "branch", "first_lock", "first_instability", "lock_crossing", "instability_crossing", "lock_run", "instability_run", "lock_smoothed", "instability_smoothed")))
            at += k
        assert str(got) == str(want)
        branches |= {r[3] for r in want}
    assert {"lock", "instability"} <= branches


def test_representations(spark):
    m = np.random.default_rng(2).random((5, 8)).astype(np.float32)
    ops = {"mean": np.mean, "min": np.min, "max": np.max, "median": np.median, "std": np.std}
    part = {"front": m[:, :4], "back": m[:, 4:], "all": m}
    want = {f"{g}_{o}": f(part[g].astype(float), axis=1) for g in part for o, f in ops.items()} | {n: m[:, k] for k, n in enumerate(G.LAYERS)}
    want["front_back_mean_gap"] = abs(part["front"].astype(float).mean(1) - part["back"].astype(float).mean(1))
    df = spark.createDataFrame([(i, name, [float(x) for x in m[i]]) for name in want for i in range(5)], "i int, name string, m array<float>")
    for r in df.select("i", "name", G.representation("m", F.col("name")).alias("x")).collect():
        assert r["x"] == pytest.approx(want[r["name"]][r["i"]], abs=1e-6)
    with pytest.raises(Exception, match="unknown representation"):
        df.select(G.representation("m", F.lit("middle_mean"))).collect()


@pytest.mark.parametrize("kinds", [P.UNIFORM, P.SPATIAL])
def test_guard_stream_equals_batch(spark, streamed, kinds):
    profiles = spark.createDataFrame([(t, *kinds[t % len(kinds)], -0.2 if kinds[t % len(kinds)][1] == "low" else 0.03, 0.25) for t in range(10)], ", ".join([G.PROFILE, "lock_threshold double", "instability_threshold double"]))
    heads = G.with_heads(P.moving(spark, SF), profiles).cache()
    want = sorted(map(str, G.batch(heads).collect()))
    assert streamed(heads, G.stream) == want
    assert any("alarm=True" in r for r in want) and any("alarm=False" in r for r in want)
    heads.unpersist()


def test_cold_start_stream_equals_batch(spark, streamed):
    rule, steps = P.cold_rule(spark, SF), P.cold_steps(spark, SF).where("task >= 5").cache()
    want = sorted(map(str, folds.batch(steps, rule).collect()))
    assert streamed(steps, lambda df: folds.stream(df, rule)) == want
    assert sum("state='calibrating'" in r for r in want) == 3 * steps.select("ep").distinct().count()
    steps.unpersist()


def test_short_episodes_stay_uncalibrated(spark):
    rule = P.cold_rule(spark, SF)
    rows = folds.batch(P.cold_steps(spark, SF).where("task >= 5 and q < 3"), rule).collect()
    assert rows and all(r["state"] == "calibrating" and r["lock_cutoff"] is None and not r["nearest"] for r in rows)
