"""Monitors over a healthy bank: matches against the whole prefix, streams against batch, the rules on made-up routes."""

import numpy as np
import pytest

from episodica.plans import matched as M
from episodica.streaming import folds
from episodica.streaming import matching as X

SF = "/root/testdata/sf0.001"
SHAPE = X.Shape(2, 4, 3, 5)


def sequence(rng, n, shape=SHAPE):
    return shape.routes(rng.random((n, shape.layers * shape.flows * shape.tokens * shape.experts)))


def whole_prefix(prefix, reference, advance):
    """Costs of a prefix by every monotone path: a plain table over (step, place)."""
    local = np.full((len(prefix), len(reference)), np.inf)
    for t in range(1, len(prefix)):
        for j in range(1, len(reference)):
            d = [np.sqrt(np.clip(1 - (np.sqrt(a[:1, :, 1:]) * np.sqrt(b[:1, :, 1:])).sum(-1), 0, 1)).mean() for a, b in ((prefix[t], reference[j]), (prefix[t - 1], reference[j - 1]))]
            local[t, j] = sum(d) / 2
    cost = np.full(local.shape, np.inf)
    cost[1, 1] = local[1, 1]
    for t in range(2, len(prefix)):
        for j in range(1, len(reference)):
            cost[t, j] = local[t, j] + min(cost[t - 1, j - s] for s in range(advance + 1) if j - s >= 0)
    return cost


@pytest.mark.parametrize("advance", [1, 2])
def test_online_match_equals_whole_prefix(advance):
    rng = np.random.default_rng(1)
    bank = [sequence(rng, n) for n in (2, 5, 9)]
    steps = sequence(rng, 8)
    m = X.Matcher(bank, SHAPE, advance)
    for t in range(1, len(steps)):
        places, _ = m.step(steps[t], steps[t - 1])
        for k, reference in enumerate(bank):
            cost = whole_prefix(steps[: t + 1], reference, advance)[t]
            assert np.allclose(np.where(np.isinf(cost), 1e9, cost), np.where(np.isinf(m.costs[k]), 1e9, m.costs[k]))
            assert places[k] == int(np.argmin(m.costs[k]))


def test_a_healthy_sequence_matches_itself_without_alarm():
    rng = np.random.default_rng(2)
    bank = [sequence(rng, 7) for _ in range(3)]
    rule = X.AccelerationExcess([b.reshape(len(b), -1) for b in bank], SHAPE, 1.0 + 1e-9)
    out = rule.fold().take(np.arange(7), {"route": bank[1].reshape(7, -1)})
    assert [p[1] for p in out["places"][1:]] == list(range(1, 7))
    assert not any(out["rejected"]) and out["first_alarm"][-1] == -1


def test_jagged_back_layers_raise_the_alarm_after_two_steps():
    rng = np.random.default_rng(3)
    calm = np.ones((6, SHAPE.layers, SHAPE.flows, SHAPE.tokens, SHAPE.experts)) + 0.05 * rng.random((6, SHAPE.layers, SHAPE.flows, SHAPE.tokens, SHAPE.experts))
    bank = [calm + 0.01 * rng.random(calm.shape) for _ in range(3)]
    odd = calm.copy()
    odd[3:, 1, 1::2] = [9, 0, 0, 0, 0]  # the back layer jumps at every other flow step, from step 3 on
    rule = X.AccelerationExcess([b.reshape(6, -1) for b in bank], SHAPE, 3.0)
    out = rule.fold().take(np.arange(6), {"route": odd.reshape(6, -1)})
    assert out["rejected"] == [False, False, False, True, True, True] and out["first_alarm"] == [-1, -1, -1, -1, 4, 4]


def test_stale_belief_needs_all_three():
    rng = np.random.default_rng(4)
    calm = np.ones((6, SHAPE.layers, SHAPE.flows, SHAPE.tokens, SHAPE.experts)) + 0.05 * rng.random((6, SHAPE.layers, SHAPE.flows, SHAPE.tokens, SHAPE.experts))
    bank = [(calm + 0.05 * rng.random(calm.shape)).reshape(6, -1) for _ in range(4)]
    verdict = lambda x: X.StaleBelief(bank, SHAPE, 0, persistence=1).fold().take(np.arange(6), {"route": x.reshape(6, -1)})["rejected"]
    state, back, front = calm.copy(), calm.copy(), calm.copy()
    state[3:, 0, :, 0] = [9, 0, 0, 0, 0]
    back[3:, 1, :, 1:] = [9, 0, 0, 0, 0]
    both = state.copy()
    both[3:, 1, :, 1:] = back[3:, 1, :, 1:]
    front = both.copy()
    front[3:, 0, :, 1:] = [0, 0, 9, 0, 0]
    assert not any(verdict(state)) and not any(verdict(back)) and not any(verdict(front))
    assert verdict(both) == [False, False, False, True, False, False]  # the back layers jump once


@pytest.mark.parametrize("make", [lambda b: X.AccelerationExcess(b, M.SHAPE, 0.8), lambda b: X.StaleBelief(b, M.SHAPE, 0, persistence=1)])
def test_stream_equals_batch(spark, streamed, make):
    routes = M.flat_routes(spark, SF).cache()
    rule = make(M.bank_of(routes, M.EPISODES))
    want = sorted(map(str, folds.batch(routes, rule).collect()))
    assert streamed(routes, lambda df: folds.stream(df, rule)) == want
    assert any("alarm=True" in r for r in want)
    routes.unpersist()


def test_bounds_of_the_bank():
    with pytest.raises(ValueError, match="three sequences"):
        X.AccelerationExcess([np.ones((3, 32))] * 2, M.SHAPE, 1.0)
