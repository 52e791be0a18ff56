"""Monitors that follow healthy references: online monotone matching, acceleration excess, stale belief.

A bank holds a few healthy sequences of routes. Each step of an episode is matched to a place in every sequence: the cost
of a place is its local distance plus the least cost of the same place, the one before or two before, one step ago. That
row of costs is all that a matcher carries, so an online match equals that of the whole prefix. Acceleration excess
compares the ratio of back to front acceleration with the largest among the matched healthy routes; stale belief rejects
a step whose state has moved away from its actions, with a jump in the back layers, while the front actions are as the healthy
ones are. An alarm takes so many steps in a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import folds

TINY = 1e-12


@dataclass(frozen=True)
class Shape:
    """Axes of a route: layers (front half first), flow steps, tokens (the state first), experts."""

    layers: int
    flows: int
    tokens: int
    experts: int

    def routes(self, flat: np.ndarray) -> np.ndarray:
        """Flat rows as normalised routes."""
        x = np.maximum(np.asarray(flat, float), 0).reshape(-1, self.layers, self.flows, self.tokens, self.experts)
        return x / np.maximum(x.sum(-1, keepdims=True), TINY)

    @property
    def front(self) -> slice:
        return slice(0, self.layers // 2)

    @property
    def back(self) -> slice:
        return slice(self.layers // 2, self.layers)


def hellinger(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(0.5 * ((np.sqrt(p) - np.sqrt(q)) ** 2).sum(-1))


def action_distance(route: np.ndarray, others: np.ndarray, layers: slice) -> np.ndarray:
    """Mean Hellinger distance of a route's actions to those of each of others."""
    closeness = (np.sqrt(route[layers, :, 1:]) * np.sqrt(others[:, layers, :, 1:])).sum(-1)
    return np.sqrt(np.clip(1 - closeness, 0, 1)).mean((1, 2, 3))


def acceleration(route: np.ndarray, layers: slice) -> float:
    """Mean second difference along the flow of the actions' square roots."""
    root = np.sqrt(route[layers, :, 1:])
    return float((np.linalg.norm(root[:, 2:] - 2 * root[:, 1:-1] + root[:, :-2], axis=-1) / np.sqrt(2)).mean())


def contrast(route: np.ndarray, shape: Shape) -> tuple[float, float, float]:
    front, back = acceleration(route, shape.front), acceleration(route, shape.back)
    return front, back, back / max(front, TINY)


def state_gap(route: np.ndarray, layer: int) -> float:
    """How far a layer's state is from its mean action."""
    action = route[layer, :, 1:].mean(1)
    return float(hellinger(route[layer, :, 0], action / np.maximum(action.sum(-1, keepdims=True), TINY)).mean())


def jump(route: np.ndarray, before: np.ndarray, layers: slice) -> float:
    return float(hellinger(route[layers, :, 1:], before[layers, :, 1:]).mean())


def chord(route: np.ndarray, other: np.ndarray, layers: slice) -> float:
    return float(hellinger(route[layers, :, 1:], other[layers, :, 1:]).mean())


class Matcher:
    """Places in every sequence of the bank that the steps so far match best."""

    def __init__(self, bank: list[np.ndarray], shape: Shape, advance: int) -> None:
        self.bank, self.shape, self.advance = bank, shape, advance
        self.costs: list | None = None

    def step(self, route: np.ndarray, before: np.ndarray) -> tuple[list[int], float]:
        """(matched place in each sequence, mean local distance there) after one more step."""
        places, chosen, costs = [], [], []
        for k, sequence in enumerate(self.bank):
            local = 0.5 * (action_distance(route, sequence[1:], self.shape.front) + action_distance(before, sequence[:-1], self.shape.front))
            new = np.full(len(sequence), np.inf)
            if self.costs is None:
                new[1] = local[0]
            else:
                old = np.asarray(self.costs[k])
                best = np.minimum(old[1:], old[:-1])
                if self.advance == 2:
                    best[1:] = np.minimum(best[1:], old[:-2])
                new[1:] = local + best
            costs.append(new)
            places.append(int(new.argmin()))
            chosen.append(float(local[places[-1] - 1]))
        self.costs = costs
        return places, float(np.mean(chosen))


class BankRule(folds.Rule):
    """A monitor over matched references; judge gives a step's columns and whether it is rejected."""

    inputs = ("route",)
    state = "before array<double>, costs array<array<double>>, run int, first int"
    columns: tuple[str, ...] = ()

    def __init__(self, bank: list[np.ndarray], shape: Shape, persistence: int = 2, advance: int = 2) -> None:
        if len(bank) < 3 or min(map(len, bank)) < 2:
            raise ValueError("a bank has three sequences at least, each of two routes or more")
        self.bank, self.shape, self.persistence, self.advance = [shape.routes(s) for s in bank], shape, persistence, advance

    @property
    def output(self) -> str:
        return ", ".join(["places array<int>, match_distance double", *(f"{c} double" for c in self.columns), "rejected boolean, run int, alarm boolean, first_alarm int"])

    def judge(self, route: np.ndarray, before: np.ndarray, places: list[int]) -> tuple[tuple, bool]:
        raise NotImplementedError

    def fold(self, stored: tuple | None = None) -> BankFold:
        return BankFold(self, stored)


class BankFold:
    def __init__(self, rule: BankRule, stored: tuple | None) -> None:
        self.rule, self.matcher = rule, Matcher(rule.bank, rule.shape, rule.advance)
        self.before, self.run, self.first = None, 0, -1
        if stored is not None:
            self.before = np.asarray(stored[0], float).reshape(rule.bank[0].shape[1:])
            self.matcher.costs = [np.asarray(c, float) for c in stored[1]] or None
            self.run, self.first = stored[2:]

    def stored(self) -> tuple:
        return self.before.ravel().tolist(), [c.tolist() for c in self.matcher.costs or []], int(self.run), int(self.first)

    def take(self, q: np.ndarray, x: dict[str, np.ndarray]) -> dict[str, list]:
        rows = []
        for at, route in zip(q, self.rule.shape.routes(x["route"])):
            places, far, values, reject = [], np.nan, (np.nan,) * len(self.rule.columns), False
            if self.before is not None:
                places, far = self.matcher.step(route, self.before)
                values, reject = self.rule.judge(route, self.before, places)
            self.before = route
            self.run = self.run + 1 if reject else 0
            if self.run >= self.rule.persistence and self.first < 0:
                self.first = int(at)
            rows.append((places, far, *values, reject, self.run, self.run >= self.rule.persistence, self.first))
        names = ("places", "match_distance", *self.rule.columns, "rejected", "run", "alarm", "first_alarm")
        return dict(zip(names, map(list, zip(*rows))))


class AccelerationExcess(BankRule):
    columns = ("front_acceleration", "back_acceleration", "ratio", "healthy_ratio", "excess")

    def __init__(self, bank, shape, threshold: float, persistence: int = 2, advance: int = 2) -> None:
        super().__init__(bank, shape, persistence, advance)
        self.threshold = threshold
        self.known = [[contrast(r, shape)[2] for r in s] for s in self.bank]

    def judge(self, route, before, places):
        front, back, ratio = contrast(route, self.shape)
        healthy = max(s[p] for s, p in zip(self.known, places))
        excess = ratio / max(healthy, TINY)
        return (front, back, ratio, healthy, excess), bool(excess > self.threshold)


class StaleBelief(BankRule):
    columns = ("gap", "jump", "action_distance", "gap_ratio", "jump_ratio", "action_ratio")

    def __init__(self, bank, shape, layer: int, persistence: int = 2, advance: int = 2) -> None:
        super().__init__(bank, shape, persistence, advance)
        self.layer = layer
        self.gaps = [[state_gap(r, layer) for r in s] for s in self.bank]
        self.jumps = [[np.nan, *(jump(b, a, shape.back) for a, b in zip(s, s[1:]))] for s in self.bank]

    def judge(self, route, before, places):
        there = np.stack([s[p] for s, p in zip(self.bank, places)])
        front = self.shape.front
        apart = [chord(r, np.delete(there, k, 0).mean(0), front) for k, r in enumerate(there)]
        bounds = max(s[p] for s, p in zip(self.gaps, places)), max(s[p] for s, p in zip(self.jumps, places)), max(apart)
        own = state_gap(route, self.layer), jump(route, before, self.shape.back), chord(route, there.mean(0), front)
        ratios = tuple(x / max(b, TINY) for x, b in zip(own, bounds))
        return (*own, *ratios), bool(ratios[0] > 1 and ratios[1] > 1 and ratios[2] <= 1)
