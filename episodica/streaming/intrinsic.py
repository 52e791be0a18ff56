"""Intrinsic guard: an episode against its own early steps, one profile for all tasks.

Three streams of a step: how little the back layers move (freeze), how much their flow accelerates, how much the step
repeats an older one rather than the last (periodicity). Each is measured against the episode's early steps, smoothed, and
for the last two held to its least over some steps in a row. Freeze alarms alone, acceleration and periodicity together
(turbulence). The profile holds three thresholds and the scale of periodicity, from healthy episodes.

`streams` and `alarms` are window plans over whole episodes; `IntrinsicRule` is the same guard step by step, for streams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import stats as A
from ..operators import windows as W
from . import folds
from .matching import Shape

EPS = 1e-6
#: First step and number of steps of the baseline, width of the mean, steps in a row, of each stream.
FREEZE, ACCELERATION, PERIODICITY = (1, 4, 6, 1), (2, 6, 3, 8), (2, 5, 6, 4)
LAGS = (1, 2, 3, 4)
#: Quantiles of the healthy peaks and of the size of periodicity; healthy episodes at least.
QUANTILES, SCALE_QUANTILE, LEAST = {"freeze": 0.975, "acceleration": 0.70, "periodicity": 0.65}, 0.75, 32


@dataclass(frozen=True)
class Profile:
    freeze: float
    acceleration: float
    periodicity: float
    scale: float


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    return _total(a) / F.size(a)


def features(df: DataFrame, shape: Shape, s: W.Series = W.Series(), route: str = "route") -> DataFrame:
    """(ep, q, mobility of each back layer, acceleration, periodicity) from flat routes whose tokens are distributions."""
    block = shape.flows * shape.tokens * shape.experts

    def token(layer: int, flow: int, t: int) -> Column:
        return F.slice(route, layer * block + (flow * shape.tokens + t) * shape.experts + 1, shape.experts)

    back, actions, last = range(shape.layers // 2, shape.layers), range(1, shape.tokens), shape.flows - 1
    final = F.array(*[F.array(*[token(layer, last, t) for t in actions]) for layer in back])
    root = lambda p: F.transform(p, F.sqrt)
    second = lambda a, b, c: F.zip_with(F.zip_with(a, b, lambda x, y: x - 2 * y), c, lambda x, y: x + y)
    sizes = [F.sqrt(_total(F.transform(second(root(token(layer, f, t)), root(token(layer, f + 1, t)), root(token(layer, f + 2, t))), lambda x: x * x))) for layer in back for t in actions for f in range(shape.flows - 2)]
    rows = df.select(s.ep, s.q, final.alias("_final"), (sum(sizes[1:], sizes[0]) / (len(sizes) * math.sqrt(2))).alias("acceleration"))
    before = lambda k: F.lag("_final", k).over(s.by)
    moved = lambda p, r: F.sqrt(F.least(F.greatest(1 - _total(F.zip_with(p, r, lambda x, y: F.sqrt(x * y))), F.lit(0.0)), F.lit(1.0)))
    alike = lambda p, r: _total(F.zip_with(p, r, lambda x, y: F.least(x, y))) / F.greatest(_total(F.zip_with(p, r, lambda x, y: F.greatest(x, y))), F.lit(1e-12))
    layers = lambda k, f: F.zip_with("_final", before(k), lambda a, b: _mean(F.zip_with(a, b, f)))
    rows = rows.withColumn("mobility", F.when(before(1).isNotNull(), layers(1, moved))).withColumns({f"_s{k}": F.when(before(k).isNotNull(), _mean(layers(k, alike))) for k in LAGS})
    return rows.withColumn("periodicity", F.greatest(*[f"_s{k}" for k in LAGS[1:]]) - F.col("_s1")).select(s.ep, s.q, "mobility", "acceleration", "periodicity")


def streams(rows: DataFrame, layers: int, scale: float | Column, s: W.Series = W.Series()) -> DataFrame:
    """(ep, q, freeze, acceleration, acceleration_held, periodicity, periodicity_held) of features; NULL where a baseline or window is not whole."""
    ep = Window.partitionBy(s.ep)

    def early(x: Column, about: tuple, reduce) -> Column:
        own = F.when((F.col(s.q) >= about[0]) & (F.col(s.q) < about[0] + about[1]), x)
        return F.when(F.count(own).over(ep) == about[1], reduce(own).over(ep))

    half = lambda x: F.percentile(x, F.lit(0.5))
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    moves = [F.get("mobility", F.lit(k)) for k in range(layers)]
    rows = rows.withColumns({f"_b{k}": early(m, FREEZE, F.avg) for k, m in enumerate(moves)} | {"_ba": early(F.col("acceleration"), ACCELERATION, half), "_bp": early(F.col("periodicity"), PERIODICITY, half)})
    ratio = lambda x, b: F.when(x.isNotNull() & b.isNotNull(), F.ln(F.greatest(x, F.lit(EPS)) / F.greatest(b, F.lit(EPS))))
    still = F.sort_array(F.array(*[-ratio(m, F.col(f"_b{k}")) for k, m in enumerate(moves)]))
    middle = (F.get(still, F.lit((layers - 1) // 2)) + F.get(still, F.lit(layers // 2))) / 2
    rows = rows.withColumns({"_f": F.when(F.get(still, F.lit(0)).isNotNull(), middle), "_a": ratio(F.col("acceleration"), F.col("_ba")), "_p": -(F.col("periodicity") - F.col("_bp")) / scale})
    rows = rows.withColumns({n: W.trailing_mean(s, x, about[2]) for n, x, about in (("freeze", "_f", FREEZE), ("acceleration_mean", "_a", ACCELERATION), ("periodicity_mean", "_p", PERIODICITY))})
    held = {"acceleration_held": W.persistence(s, "acceleration_mean", ACCELERATION[3]), "periodicity_held": W.persistence(s, "periodicity_mean", PERIODICITY[3])}
    return rows.withColumns(held).select(s.ep, s.q, "freeze", F.col("acceleration_mean").alias("acceleration"), "acceleration_held", F.col("periodicity_mean").alias("periodicity"), "periodicity_held")


def calibrated(healthy: DataFrame, layers: int, quantiles: dict = QUANTILES, scale_quantile: float = SCALE_QUANTILE, least: int = LEAST) -> Profile:
    """The profile of healthy episodes' features; fewer than least finite peaks of a stream raise."""
    size = healthy.select(F.abs("periodicity").alias("x")).where("x IS NOT NULL")
    scale = A.quantile_linear(size, "x", scale_quantile).head()[0]
    if not scale or scale <= 0:
        raise ValueError("the scale of periodicity must be positive")
    peaks = streams(healthy, layers, scale).groupBy("ep").agg(*[F.max(n).alias(n) for n in quantiles]).unpivot("ep", list(quantiles), "head", "peak")
    found: dict[str, float] = {}
    for head, q in quantiles.items():
        value = A.quantile_higher(peaks.where(F.col("head") == head), "peak", q, name="t", least=least).head()["t"]
        if value is None:
            raise ValueError(f"at least {least} finite references are required for {head}")
        found[head] = float(value)
    return Profile(found["freeze"], found["acceleration"], found["periodicity"], float(scale))


def crossings(rows: DataFrame, profile: Profile) -> DataFrame:
    """Streams with the steps at which each head crosses; no head speaks before its baseline is whole."""
    q = F.col("q")
    spoken = {"freeze": (F.col("freeze"), FREEZE[0] + FREEZE[1], profile.freeze), "acceleration": (F.col("acceleration_held"), ACCELERATION[0] + ACCELERATION[1] - 1, profile.acceleration), "periodicity": (F.col("periodicity_held"), PERIODICITY[0] + PERIODICITY[1] - 1, profile.periodicity)}
    return rows.withColumns({f"_{n}": F.coalesce((q >= at) & (x > t), F.lit(False)) for n, (x, at, t) in spoken.items()})


def mechanism(freeze: Column, turbulence: Column) -> Column:
    return F.when(freeze & turbulence, "freeze+turbulence").when(freeze, "freeze").when(turbulence, "confirmed_turbulence").otherwise("none")


def alarms(rows: DataFrame, profile: Profile) -> DataFrame:
    """(ep, q, first alarms so far of each head, of turbulence, of the guard, and the mechanism) of streams."""
    past = W.Series().past
    first = {n: F.coalesce(F.min(F.when(F.col(f"_{n}"), F.col("q"))).over(past), F.lit(-1)) for n in ("freeze", "acceleration", "periodicity")}
    out = crossings(rows, profile).withColumns({f"first_{n}": c for n, c in first.items()})
    out = out.withColumn("first_turbulence", W.both_alarms("first_acceleration", "first_periodicity")).withColumn("first_alarm", W.either_alarm("first_freeze", "first_turbulence"))
    return out.withColumn("mechanism", mechanism(F.col("first_freeze") >= 0, F.col("first_turbulence") >= 0)).drop("_freeze", "_acceleration", "_periodicity")


class IntrinsicFold:
    """The guard of one episode: the last values of each stream, and baselines once they are known."""

    def __init__(self, rule: IntrinsicRule, stored: tuple | None) -> None:
        self.rule = rule
        self.routes: list = []
        self.tails: list[list] = [[], [], []]
        self.bases: list = [None, None, None]
        self.first = [-1, -1, -1]
        if stored is not None:
            shape = (rule.shape.layers - rule.shape.layers // 2, rule.shape.tokens - 1, rule.shape.experts)
            self.routes = [np.array(r).reshape(shape) for r in stored[0]]
            self.tails = [[np.array(v) for v in stored[1]], *([np.array([v]) for v in x] for x in stored[2:4])]
            self.bases = [np.array(b) if len(b) else None for b in stored[4:7]]
            self.first = list(stored[7])

    def stored(self) -> tuple:
        m, a, c = self.tails
        return ([r.ravel().tolist() for r in self.routes], [v.tolist() for v in m], [float(v[0]) for v in a], [float(v[0]) for v in c], *([] if b is None else b.tolist() for b in self.bases), list(map(int, self.first)))

    def observed(self, route: np.ndarray) -> list[np.ndarray]:
        """Mobility of the back layers, acceleration and periodicity of a step."""
        back = route[self.rule.shape.back]
        root = np.sqrt(back[:, :, 1:])
        second = root[:, 2:] - 2 * root[:, 1:-1] + root[:, :-2]
        final, nan = back[:, -1, 1:], np.nan
        moved = np.full(len(back), nan)
        if self.routes:
            moved = np.sqrt(np.clip(1 - np.sqrt(final * self.routes[-1]).sum(-1), 0, 1)).mean(1)
        alike = [(np.minimum(final, r).sum(-1) / np.maximum(np.maximum(final, r).sum(-1), 1e-12)).mean() for r in reversed(self.routes)]
        self.routes = [*self.routes, final][-max(LAGS) :]
        return [moved, np.array([np.linalg.norm(second, axis=-1).mean() / np.sqrt(2)]), np.array([max(alike[1:]) - alike[0] if len(alike) > 1 else nan])]

    def score(self, k: int, q: int, value: np.ndarray, about: tuple) -> float:
        """A stream's smoothed and held score after one more value; NaN if it has none."""
        start, count, width, held = about
        tail = self.tails[k] = [*self.tails[k], value][-max(width + held - 1, start + count) :]
        if q == start + count - 1:
            window = np.array(tail[-count:])
            self.bases[k] = np.where(np.isfinite(window).all(0), window.mean(0) if k == 0 else np.median(window, 0), np.nan)
        if self.bases[k] is None or len(tail) < width + held - 1:
            return math.nan
        x = np.array(tail[-(width + held - 1) :])
        with np.errstate(invalid="ignore"):
            raw = -(x - self.bases[k]) / self.rule.profile.scale if k == 2 else np.log(np.maximum(x, EPS) / np.maximum(self.bases[k], EPS)) * (-1 if k == 0 else 1)
        one = np.median(raw, axis=1)
        smooth = np.convolve(one, np.full(width, 1 / width), "valid") if np.isfinite(one).all() else np.array([math.nan])
        return float(smooth.min())

    def take(self, q: np.ndarray, x: dict[str, np.ndarray]) -> dict[str, list]:
        p, rows = self.rule.profile, []
        for at, route in zip(q.tolist(), self.rule.shape.routes(x["route"])):
            scores = [self.score(k, at, v, about) for k, (v, about) in enumerate(zip(self.observed(route), (FREEZE, ACCELERATION, PERIODICITY)))]
            for k, (score, limit) in enumerate(zip(scores, (p.freeze, p.acceleration, p.periodicity))):
                if self.first[k] < 0 and score > limit:
                    self.first[k] = at
            freeze, a, c = self.first
            turbulence = max(a, c) if min(a, c) >= 0 else -1
            alarm = freeze if turbulence < 0 else turbulence if freeze < 0 else min(freeze, turbulence)
            why = "freeze+turbulence" if freeze >= 0 and turbulence >= 0 else "freeze" if freeze >= 0 else "confirmed_turbulence" if turbulence >= 0 else "none"
            rows.append((*scores, *self.first, turbulence, alarm, why))
        return dict(zip(("freeze", "acceleration_held", "periodicity_held", "first_freeze", "first_acceleration", "first_periodicity", "first_turbulence", "first_alarm", "mechanism"), map(list, zip(*rows))))


class IntrinsicRule(folds.Rule):
    inputs = ("route",)
    output = "freeze double, acceleration_held double, periodicity_held double, first_freeze int, first_acceleration int, first_periodicity int, first_turbulence int, first_alarm int, mechanism string"
    state = "routes array<array<double>>, mobility array<array<double>>, acceleration array<double>, periodicity array<double>, base1 array<double>, base2 array<double>, base3 array<double>, first array<int>"

    def __init__(self, profile: Profile, shape: Shape) -> None:
        if not all(map(math.isfinite, (profile.freeze, profile.acceleration, profile.periodicity, profile.scale))) or profile.scale <= 0:
            raise ValueError("a profile is finite and its scale positive")
        self.profile, self.shape = profile, shape

    def fold(self, stored: tuple | None = None) -> IntrinsicFold:
        return IntrinsicFold(self, stored)
