"""The intrinsic guard: stream against batch, causality, calibration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import stats as A
from episodica.plans import intrinsic as P
from episodica.streaming import folds
from episodica.streaming import intrinsic as I
from episodica.streaming.selfref import Limits, SelfReference

SF = "/root/testdata/sf0.001"
NAMES = ["freeze", "acceleration_held", "periodicity_held", "first_freeze", "first_acceleration", "first_periodicity", "first_turbulence", "first_alarm", "mechanism"]


@pytest.fixture(scope="module")
def batch(spark):
    profile, rows = P.guarded(spark, SF)
    return profile, {(r["ep"], r["q"]): r for r in rows.collect()}


def agree(got, want):
    for n in NAMES:
        a, b = got[n], want[n]
        assert (a is None) == (b is None), (n, got, want)
        assert a == b if not isinstance(a, float) else a == pytest.approx(b, abs=1e-9), (n, got, want)


def test_steps_equal_windows(spark, batch):
    profile, seen = batch[0], set()
    low = I.Profile(profile.freeze, profile.acceleration - 0.5, profile.periodicity - 0.5, profile.scale)  # so that turbulence is met
    features = I.features(P.routes(spark, SF), P.SHAPE)
    for p in (profile, low):
        want = {(r["ep"], r["q"]): r for r in I.alarms(I.streams(features, P.LAYERS, p.scale), p).collect()}
        got = folds.batch(P.routes(spark, SF), I.IntrinsicRule(p, P.SHAPE)).collect()
        assert len(got) == len(want)
        for r in got:
            agree(r, want[r["ep"], r["q"]])
        seen |= {r["mechanism"] for r in got}
    assert seen >= {"none", "freeze", "confirmed_turbulence", "freeze+turbulence"}


def test_stream_equals_batch(spark, batch, streamed):
    rule, routes = I.IntrinsicRule(batch[0], P.SHAPE), P.routes(spark, SF).cache()
    assert streamed(routes, lambda df: folds.stream(df, rule)) == sorted(map(str, folds.batch(routes, rule).collect()))
    routes.unpersist()


def test_scores_of_a_prefix_do_not_change(spark, batch):
    profile, want = batch
    for end in (8, 12):
        rows = I.features(P.routes(spark, SF).where(F.col("q") < end), P.SHAPE)
        for r in I.alarms(I.streams(rows, P.LAYERS, profile.scale), profile).where("q >= 7").collect():
            agree(r, want[r["ep"], r["q"]])


def test_calibration_needs_references(spark):
    rows = I.features(P.routes(spark, SF), P.SHAPE)
    with pytest.raises(ValueError, match="at least 32 finite references"):
        I.calibrated(rows, P.LAYERS)
    with pytest.raises(ValueError, match="scale positive"):
        I.IntrinsicRule(I.Profile(1.0, 1.0, 1.0, 0.0), P.SHAPE)
    with pytest.raises(ValueError, match="finite"):
        I.IntrinsicRule(I.Profile(math.nan, 1.0, 1.0, 1.0), P.SHAPE)


def test_linear_quantile_from_counts(spark):
    df = spark.createDataFrame([(x,) for x in [3.0, 1.0, 1.0, 8.0, None, 5.0, 1.0, float("nan")]], "x double")
    for q, want in ((0.0, 1.0), (0.5, 2.0), (0.75, 4.5), (1.0, 8.0)):
        assert A.quantile_linear(df, "x", q).head()[0] == pytest.approx(want)


def test_self_reference_stream_equals_batch(spark, streamed):
    rule, routes = SelfReference(P.LIMITS, P.SHAPE), P.routes(spark, SF).cache()
    want = folds.batch(routes, rule).collect()
    assert streamed(routes, lambda df: folds.stream(df, rule)) == sorted(map(str, want))
    assert any(r["alarm"] for r in want) and not all(r["alarm"] for r in want if r["churn_ratio"] is not None)
    routes.unpersist()


@pytest.mark.parametrize("frozen,churning,alarm", [(True, True, True), (False, True, False), (True, False, False)])
def test_collapse_needs_a_frozen_state_and_churn(frozen, churning, alarm):
    rng = np.random.default_rng(1)
    steps = rng.random((14, 4, 4, 2, 2)) + 0.2
    if frozen:
        steps[7:, :2, 3, 0] = steps[6, :2, 3, 0]  # the front state stops to respond
        steps[7:, :2, 3, 1] = steps[7:, :2, 3, 0][..., ::-1] ** 3  # and is apart from the action
    steps[7:, 2:] = rng.random((7, 2, 4, 2, 2)) ** 4 + 1e-3 if churning else 1.0
    out = SelfReference(Limits(4, 3, 0.2, 0.8, 0.0), P.SHAPE).fold().take(np.arange(14), {"route": steps.reshape(14, -1)})
    assert (out["first_alarm"][-1] >= 0) == alarm and not any(out["alarm"][:7])
