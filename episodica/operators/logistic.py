"""Logistic regression left one group out at a time: all folds are fitted by the same passes over the rows.

A fold's training rows are those of all other groups, so its scaling and class counts are totals less a group's own, and
one aggregate by group serves all folds. Each Newton step is one more pass: a task adds up loss, gradient and curvature of
every fold over its rows, sums of fixed size that Spark adds by position. The driver holds one small system for each fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Folds at most: each task holds a system for each of them.
MOST_FOLDS = 2_000


def group_moments(df: DataFrame, group: str, label: str, features: list[str]) -> dict:
    """group: (rows, positives, sums, sums of squares) of the features."""
    sums = [F.sum(F.col(f).cast("double")) for f in features] + [F.sum(F.col(f).cast("double") ** 2) for f in features]
    got = df.groupBy(group).agg(F.count("*"), F.sum(F.col(label).cast("long")), *sums).limit(MOST_FOLDS + 1).collect()
    if len(got) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} groups")
    d = len(features)
    return {r[0]: (r[1], r[2], np.array(r[3 : 3 + d]), np.array(r[3 + d :])) for r in got}


class Folds:
    """Scaling, class weights, and weights so far of the fold that leaves out each group."""

    def __init__(self, moments: dict, features: int, balanced: bool) -> None:
        self.keys = sorted(moments, key=lambda k: (k is not None, k))
        own = [moments[k] for k in self.keys]
        n, pos = np.array([m[0] for m in own], float), np.array([m[1] for m in own], float)
        s, ss = np.array([m[2] for m in own]), np.array([m[3] for m in own])
        self.n, self.pos = n.sum() - n, pos.sum() - pos
        with np.errstate(invalid="ignore", divide="ignore"):
            self.mean = (s.sum(0) - s) / self.n[:, None]
            spread = np.sqrt(np.maximum((ss.sum(0) - ss) / self.n[:, None] - self.mean**2, 0))
            even = np.stack([self.n / (2 * (self.n - self.pos)), self.n / (2 * self.pos)], 1)
        self.spread = np.where(spread > 0, spread, 1.0)
        self.both = (self.pos > 0) & (self.pos < self.n)
        self.cost = np.where(self.both[:, None] & balanced, even, 1.0)
        self.w = np.zeros((len(self.keys), features + 1))

    def scaled(self, k: int, x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.ones((len(x), 1)), (x - self.mean[k]) / self.spread[k]), 1)


def passed(df: DataFrame, group: str, label: str, features: list[str], folds: Folds) -> np.ndarray:
    """Loss, gradient and curvature of each fold at its weights, summed over its training rows."""
    at = {k: i for i, k in enumerate(folds.keys)}
    d = len(features) + 1
    size = 1 + d + d * d

    def run(batches):
        total = np.zeros((len(folds.keys), size))
        for b in batches:
            if not b.num_rows:
                continue
            owner = np.array([at[g] for g in b.column(0).to_pylist()])
            y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = np.stack([b.column(2 + j).to_numpy(zero_copy_only=False) for j in range(d - 1)], 1)
            for k in np.flatnonzero(folds.both):
                own = owner != k
                z, t = folds.scaled(k, x[own]), y[own]
                score = z @ folds.w[k]
                p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
                cost = folds.cost[k][t.astype(int)]
                total[k, 0] += (cost * (np.logaddexp(0, score) - t * score)).sum()
                total[k, 1 : 1 + d] += z.T @ (cost * (p - t))
                total[k, 1 + d :] += ((z * (cost * p * (1 - p))[:, None]).T @ z).ravel()
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    rows = df.select(group, F.col(label).cast("int"), *[F.col(f).cast("double") for f in features]).mapInArrow(run, "i long, v double")
    out = np.zeros(len(folds.keys) * size)
    for r in rows.groupBy("i").agg(F.sum("v").alias("v")).collect():  # folds times the size of a system
        out[r["i"]] = r["v"]
    return out.reshape(-1, size)


def fitted(df: DataFrame, group: str, label: str, features: list[str], strength: float = 1.0, balanced: bool = False, tolerance: float = 1e-9, passes: int = 60) -> Folds:
    """Folds with the weights that make strength times the (class-weighted) loss plus half the squared slopes least.

    Newton steps; a fold whose objective rose goes back half the way. The intercept is not penalised. Rows with a null label or feature
    are left out by the callers' choice of df.
    """
    ship(df.sparkSession)
    d = len(features) + 1
    folds = Folds(group_moments(df, group, label, features), len(features), balanced)
    penalty = np.diag([0.0] + [1.0] * (d - 1))
    best, held = np.full(len(folds.keys), np.inf), folds.w.copy()
    todo = folds.both.copy()
    for _ in range(passes):
        if not todo.any():
            break
        got = passed(df, group, label, features, folds)
        for k in np.flatnonzero(todo):
            loss = strength * got[k, 0] + 0.5 * folds.w[k] @ penalty @ folds.w[k]
            if loss > best[k] + 1e-12 * abs(best[k]):
                step = (folds.w[k] - held[k]) / 2
                folds.w[k] = held[k] + step
            else:
                best[k], held[k] = loss, folds.w[k].copy()
                slope = strength * got[k, 1 : 1 + d] + penalty @ folds.w[k]
                bend = strength * got[k, 1 + d :].reshape(d, d) + penalty
                step = -np.linalg.solve(bend + 1e-12 * np.eye(d), slope)
                folds.w[k] = held[k] + step
            todo[k] = np.abs(step).max() > tolerance
    return folds


def out_of_fold(df: DataFrame, group: str, label: str, features: list[str], name: str = "probability", single: float | None = None, **how) -> DataFrame:
    """df with the probability that the fold without a row's own group gives it.

    A fold whose training rows are all of one class gives single, or their mean label if that is None (NULL without
    training rows). Rows with a null feature get NULL, and rows with a null label or feature train nothing.
    """
    whole = df.dropna(subset=[group, label, *features])
    folds = fitted(whole, group, label, features, **how)
    rows = []
    for k, key in enumerate(folds.keys):
        slope = folds.w[k, 1:] / folds.spread[k]
        flat = None if folds.both[k] else single if single is not None else float(folds.pos[k] / folds.n[k]) if folds.n[k] else None
        rows.append((key, float(folds.w[k, 0] - np.nan_to_num(slope @ folds.mean[k])), slope.tolist(), bool(folds.both[k]), flat))
    kind = df.schema[group].dataType.simpleString()
    model = df.sparkSession.createDataFrame(rows, f"`{group}` {kind}, _w0 double, _w array<double>, _fit boolean, _flat double")
    score = F.col("_w0")
    for j, f in enumerate(features):
        score = score + F.get("_w", F.lit(j)) * F.col(f).cast("double")
    return df.join(F.broadcast(model), group, "left").withColumn(name, F.when(F.col("_fit"), 1 / (1 + F.exp(-score))).otherwise(F.col("_flat"))).drop("_w0", "_w", "_fit", "_flat")
