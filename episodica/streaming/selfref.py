"""Self-reference coupling collapse: an episode's recent steps against its own warm-up, with no other reference.

Three observables of a step: how much the back layers' flow accelerates, how far the front state is from the mean front
action, and how much the front state has moved since the step before. The coupling has collapsed where the state responds
less than in the warm-up while planning churns and state and actions are apart as much as then or more: medians of the last
steps over medians of the warm-up, all three conditions at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from . import folds
from .matching import TINY, Shape, acceleration


def affinity_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(1 - np.sqrt(p * q).sum(-1), 0, 1))


@dataclass(frozen=True)
class Limits:
    warmup: int
    window: int
    response_most: float
    churn_least: float
    gap_least: float


def median(rows: list) -> np.ndarray:
    """Medians of the columns without NaN; NaN for a column that has nothing else."""
    x = np.array(rows)
    return np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else math.nan for c in x.T])


class SelfReferenceFold:
    def __init__(self, rule: SelfReference, stored: tuple | None) -> None:
        self.rule, self.before, self.early, self.recent, self.run, self.first = rule, None, [], [], 0, -1
        if stored is not None:
            shape = (rule.shape.layers // 2, rule.shape.experts)
            self.before = np.array(stored[0]).reshape(shape)
            self.early, self.recent = ([np.array([math.nan if v is None else v for v in r]) for r in x] for x in stored[1:3])
            self.run, self.first = stored[3:]

    def stored(self) -> tuple:
        return self.before.ravel().tolist(), [r.tolist() for r in self.early], [r.tolist() for r in self.recent], int(self.run), int(self.first)

    def observed(self, route: np.ndarray) -> np.ndarray:
        front = route[self.rule.shape.front, -1]
        action = front[:, 1:].mean(1)
        state = front[:, 0]
        gap = affinity_distance(state, action / np.maximum(action.sum(-1, keepdims=True), TINY)).mean()
        response = math.nan if self.before is None else affinity_distance(state, self.before).mean()
        self.before = state
        return np.array([acceleration(route, self.rule.shape.back), gap, response])

    def take(self, q: np.ndarray, x: dict[str, np.ndarray]) -> dict[str, list]:
        a, rows = self.rule.limits, []
        for at, route in zip(q.tolist(), self.rule.shape.routes(x["route"])):
            seen = self.observed(route)
            if 1 <= at <= a.warmup:
                self.early.append(seen)
            self.recent = [*self.recent, seen][-a.window :]
            ratios = np.full(3, math.nan)
            if at >= a.warmup + a.window:
                ratios = median(self.recent) / np.maximum(median(self.early), TINY)
            reject = bool(ratios[2] <= a.response_most and ratios[0] >= a.churn_least and ratios[1] >= a.gap_least)
            self.run = self.run + 1 if reject else 0
            if reject and self.first < 0:
                self.first = at
            rows.append((*ratios.tolist(), at >= a.warmup, reject, self.run, self.first))
        return dict(zip(("churn_ratio", "gap_ratio", "response_ratio", "warm", "alarm", "run", "first_alarm"), map(list, zip(*rows))))


class SelfReference(folds.Rule):
    inputs = ("route",)
    output = "churn_ratio double, gap_ratio double, response_ratio double, warm boolean, alarm boolean, run int, first_alarm int"
    state = "before array<double>, early array<array<double>>, recent array<array<double>>, run int, first int"

    def __init__(self, limits: Limits, shape: Shape) -> None:
        if limits.warmup < 1 or limits.window < 1:
            raise ValueError("warm-up and window have one step at least")
        self.limits, self.shape = limits, shape

    def fold(self, stored: tuple | None = None) -> SelfReferenceFold:
        return SelfReferenceFold(self, stored)
