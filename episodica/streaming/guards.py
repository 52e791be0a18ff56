"""Profile-driven guards: two heads over layer mobility, a lock head and an instability head, and a latched alarm.

Each task has a profile: which aggregate of the layers the lock head watches and in which direction, which layer the
instability head watches, and for both the width of the trailing mean, the number of steps in a row that confirm, and the
threshold. Uniform profiles give the dual-regime monitor, per-task layers the long and lead guards, per-task aggregates
the spatial guard.

The trailing mean is a difference of running sums in single precision, in order of the steps, as monitors that must
repeat each other to the last bit use it. Such sums depend on their order, so they are folded (see `folds`): batch and
stream give the same rows. Steps of an episode are numbered from 0 without gaps.

A task without a profile starts cold: its first steps are its own measure, and the known tasks that resemble it lend a cutoff.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import stats as A
from ..operators import windows as W
from . import folds

#: Names of the layers, front half first.
LAYERS = ("L2", "L3", "L4", "L5", "L12", "L13", "L14", "L15")
PROFILE = "task int, lock_representation string, lock_direction string, lock_width int, lock_confirmations int, instability_layer string, instability_width int, instability_confirmations int"
THRESHOLDS = ("lock_threshold", "instability_threshold")
HEADS = ("base", "changes", "high", "watched", "lock_width", "lock_confirmations", "lock_threshold", "instability_width", "instability_confirmations", "instability_threshold")
OUT = "state string, alarm boolean, first_alarm int, branch string, first_lock int, first_instability int, lock_crossing boolean, instability_crossing boolean, lock_run int, instability_run int, lock_value float, lock_smoothed float, instability_value float, instability_smoothed float"
STATE = "sums1 array<float>, whole1 array<int>, sums2 array<float>, whole2 array<int>, base float, run1 int, run2 int, first1 int, first2 int"
#: Profiles that are broadcast at most; more are joined by shuffle.
BROADCAST_PROFILES = 100_000


def layer_mobility(s: W.Series, route: str = "route") -> Column:
    """Mean over tokens of the Hellinger distance to the step before, for each layer, in single precision.

    route: layers of tokens of probabilities; NULL at the first step.
    """
    before = F.lag(route).over(s.by)
    moved = lambda p, r: F.aggregate(F.zip_with(p, r, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda a, x: a + x)
    token = lambda p, r: F.sqrt(F.least(F.greatest(1 - moved(p, r), F.lit(0.0)), F.lit(1.0)))
    layer = lambda a, b: (F.aggregate(F.zip_with(a, b, token), F.lit(0.0), lambda t, x: t + x) / F.size(a)).cast("float")
    return F.when(before.isNotNull(), F.zip_with(F.col(route), before, layer))


def _median(part: Column, n: int) -> Column:
    low, high = (n - 1) // 2, n // 2
    ordered = F.sort_array(part)
    return (F.get(ordered, F.lit(low)).cast("double") + F.get(ordered, F.lit(high))) / 2


def _mean(part: Column, n: int) -> Column:
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / n


def _spread(part: Column, mean: Column, n: int) -> Column:
    return F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def representation(mobility: str, name: Column) -> Column:
    """The aggregate of the layers that a name stands for, NULL without mobility; an unknown name raises."""
    half = len(LAYERS) // 2
    groups = {"front": (1, half), "back": (half + 1, half), "all": (1, 2 * half)}
    known = {layer: F.get(mobility, F.lit(k)).cast("double") for k, layer in enumerate(LAYERS)}
    for group, (start, n) in groups.items():
        part = F.slice(mobility, start, n)
        mean = _mean(part, n)
        spread = _spread(part, mean, n)
        known |= {f"{group}_mean": mean, f"{group}_min": F.array_min(part).cast("double"), f"{group}_max": F.array_max(part).cast("double"), f"{group}_median": _median(part, n), f"{group}_std": spread}
    known["front_back_mean_gap"] = F.abs(known["front_mean"] - known["back_mean"])
    case = reduce(lambda c, item: c.when(name == item[0], item[1]), known.items(), F)
    return case.otherwise(F.raise_error(F.concat(F.lit("unknown representation: "), name))).cast("float")


def with_heads(df: DataFrame, profiles: DataFrame, mobility: str = "mobility") -> DataFrame:
    """ep, q and what the fold needs of a step, for steps of tasks that have a profile.

    Without thresholds in the profiles nothing crosses, which is what calibration needs.
    """
    for name in THRESHOLDS:
        if name not in profiles.columns:
            profiles = profiles.withColumn(name, F.lit(float("inf")))
    near = F.broadcast(profiles) if profiles.count() <= BROADCAST_PROFILES else profiles
    j = df.join(near, "task")
    at = F.array_position(F.lit(list(LAYERS)), F.col("instability_layer")).cast("int") - 1
    base = F.regexp_replace("lock_representation", "^delta_", "")
    columns = {"base": representation(mobility, base), "changes": F.col("lock_representation").startswith("delta_"), "high": F.col("lock_direction") == "high", "watched": F.get(mobility, at)}
    return j.withColumns(columns).select("ep", "task", "q", *HEADS)


def trailing(values: np.ndarray, width: int, sums: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trailing means, running sums and counts to carry on with): NaN unless width finite values are there."""
    finite = np.isfinite(values)
    new = np.add.accumulate(np.concatenate((sums[-1:], np.where(finite, values, 0).astype(np.float32))), dtype=np.float32)
    sums = np.concatenate((sums, new[1:]))
    whole = np.concatenate((whole, whole[-1] + np.cumsum(finite)))
    n, k = len(values), len(sums) - len(values)
    out = np.full(n, np.nan, np.float32)
    ends = np.arange(k, k + n)
    ends = ends[ends >= width]
    good = ends[whole[ends] - whole[ends - width] == width]
    out[good - k] = (sums[good] - sums[good - width]) / np.float32(width)
    return out, sums[-width - 1 :], whole[-width - 1 :]


def run_lengths(flags: np.ndarray, run: int) -> np.ndarray:
    """Flags in a row up to each place, after run of them before the first."""
    at = np.arange(len(flags))
    last = np.maximum.accumulate(np.where(flags, -1 - run, at))
    return at - last


@dataclass
class Fold:
    """What an episode carries from one chunk of its steps to the next."""

    sums: list = field(default_factory=lambda: [np.zeros(1, np.float32), np.zeros(1, np.float32)])
    whole: list = field(default_factory=lambda: [np.zeros(1, np.int64), np.zeros(1, np.int64)])
    base: float = float("nan")
    run: list = field(default_factory=lambda: [0, 0])
    first: list = field(default_factory=lambda: [-1, -1])

    @classmethod
    def restored(cls, row) -> Fold:
        f32, i64 = (lambda x: np.array(x, np.float32)), (lambda x: np.array(x, np.int64))
        return cls([f32(row[0]), f32(row[2])], [i64(row[1]), i64(row[3])], row[4], [row[5], row[6]], [row[7], row[8]])

    def stored(self) -> tuple:
        parts = [x.tolist() for pair in zip(self.sums, self.whole) for x in pair]
        return (*parts, float(self.base), *map(int, self.run), *map(int, self.first))

    def take(self, q: np.ndarray, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The outputs of consecutive steps; x: the HEADS columns, of which the profile's are constant."""
        base = x["base"].astype(np.float32)
        one = {k: x[k][0] for k in HEADS if k not in ("base", "watched")}
        value = np.abs(base - np.concatenate(([np.float32(self.base)], base[:-1]))) if one["changes"] else base
        self.base = base[-1]
        values, smooth, cross, runs = [value, x["watched"].astype(np.float32)], [], [], []
        for k, head in enumerate(("lock", "instability")):
            mean, self.sums[k], self.whole[k] = trailing(values[k], int(one[f"{head}_width"]), self.sums[k], self.whole[k])
            score = mean if k or one["high"] else -mean
            with np.errstate(invalid="ignore"):
                flags = score.astype(np.float64) > one[f"{head}_threshold"]
            length = run_lengths(flags, self.run[k])
            self.run[k] = length[-1]
            opens = np.flatnonzero(length >= one[f"{head}_confirmations"])
            before = np.full(len(q), self.first[k])
            if self.first[k] < 0 and len(opens):
                self.first[k] = q[opens[0]]
                before[opens[0] :] = self.first[k]
            smooth.append(mean)
            cross.append(flags)
            runs.append((length, before))
        lock, unstable = runs[0][1], runs[1][1]
        first = np.where(lock < 0, unstable, np.where(unstable < 0, lock, np.minimum(lock, unstable)))
        branch = np.select([first < 0, lock == unstable, first == lock], ["none", "lock+instability", "lock"], "instability")
        state = np.select([first >= 0, cross[0] | cross[1]], ["alarm", "suspect"], "normal")
        return {
            "state": state, "alarm": first >= 0, "first_alarm": first, "branch": branch, "first_lock": lock, "first_instability": unstable,
            "lock_crossing": cross[0], "instability_crossing": cross[1], "lock_run": runs[0][0], "instability_run": runs[1][0],
            "lock_value": values[0], "lock_smoothed": smooth[0], "instability_value": values[1], "instability_smoothed": smooth[1],
        }


class GuardRule(folds.Rule):
    inputs, output, state = HEADS, OUT, STATE

    def fold(self, stored: tuple | None = None) -> Fold:
        return Fold() if stored is None else Fold.restored(stored)


def batch(heads: DataFrame) -> DataFrame:
    """The guard's outputs at every step, over whole episodes."""
    return folds.batch(heads, GuardRule())


def stream(heads: DataFrame) -> DataFrame:
    """The same outputs over a stream of heads; the session needs the RocksDB state store."""
    return folds.stream(heads, GuardRule())


# ---- tasks without a profile


@dataclass(frozen=True)
class ColdStart:
    """Reference of a cold start: the ratio of smoothed to early mobility that is low, and for each known task its fingerprint and cutoff."""

    ratio: float
    tasks: tuple
    fingerprints: tuple
    cutoffs: tuple
    prefix: int = 4
    neighbours: int = 3
    cutoff_quantile: float = 0.5
    width: int = 4
    confirmations: tuple = (4, 8)


class ColdFold:
    """A guard whose cutoffs come from an episode's own first steps: its mean mobility there, and the tasks whose fingerprints are nearest."""

    def __init__(self, about: ColdStart, stored: tuple | None = None) -> None:
        self.about = about
        self.sum, self.early, self.cutoffs, self.near, self.guard = np.zeros(len(about.fingerprints[0])), [], [math.nan, math.nan], [], Fold()
        if stored is not None:
            self.sum, self.early, self.cutoffs, self.near = np.array(stored[0]), list(stored[1]), list(stored[2]), list(stored[3])
            self.guard = Fold.restored(stored[4:])

    def stored(self) -> tuple:
        return (self.sum.tolist(), self.early, self.cutoffs, self.near, *self.guard.stored())

    def take(self, q: np.ndarray, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        a = self.about
        own = q < a.prefix
        self.sum = self.sum + x["fingerprint"][own].sum(0)
        self.early += [float(v) for v in x["base"][own] if np.isfinite(v)]
        if a.prefix - 1 in q:
            far = ((np.array(a.fingerprints) - np.sqrt(np.maximum(self.sum / a.prefix, 0))) ** 2).sum(1)
            nearest = np.argsort(far, kind="stable")[: a.neighbours]
            self.near = [int(a.tasks[k]) for k in nearest]
            self.cutoffs = [a.ratio * float(np.mean(self.early)), float(np.quantile(np.array(a.cutoffs)[nearest], a.cutoff_quantile, method="higher"))]
        one = {"changes": False, "high": False, "lock_width": a.width, "instability_width": a.width, "lock_confirmations": a.confirmations[0], "instability_confirmations": a.confirmations[1]}
        lock, unstable = self.cutoffs
        one |= {"lock_threshold": -lock if math.isfinite(lock) else math.inf, "instability_threshold": unstable if math.isfinite(unstable) else math.inf}
        out = self.guard.take(q, {"base": x["base"], "watched": x["watched"]} | {k: np.full(len(q), v) for k, v in one.items()})
        ready = q >= a.prefix - 1
        out["state"] = np.where(~ready & (out["state"] == "normal"), "calibrating", out["state"])
        out["lock_cutoff"], out["instability_cutoff"] = (np.where(ready, c, np.nan) for c in self.cutoffs)
        out["nearest"] = [self.near if r else [] for r in ready]
        return out


class ColdRule(folds.Rule):
    inputs = ("fingerprint", "base", "watched")
    output = OUT + ", lock_cutoff double, instability_cutoff double, nearest array<int>"
    state = "total array<double>, early array<double>, cutoffs array<double>, near array<int>, " + STATE

    def __init__(self, about: ColdStart) -> None:
        if len(about.tasks) < about.neighbours:
            raise ValueError("fewer reference tasks than neighbours")
        self.about = about

    def fold(self, stored: tuple | None = None) -> ColdFold:
        return ColdFold(self.about, stored)


def fingerprint(route: str = "route") -> Column:
    """Mean over tokens of each layer's distribution, layers behind one another."""
    tokens = lambda layer: F.aggregate(F.slice(layer, 2, F.size(layer)), F.get(layer, F.lit(0)), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    return F.flatten(F.transform(route, lambda layer: F.transform(tokens(layer), lambda x: x / F.size(layer))))


def cold_reference(steps: DataFrame, limits: DataFrame, quantile: float, prefix: int = 4, most_tasks: int = 10_000, **how) -> ColdStart:
    """Reference from healthy steps (task, ep, q, fingerprint, base, watched) and the known tasks' instability thresholds (task, instability_threshold)."""
    early = steps.where(F.col("q") < prefix)
    one = early.select("task", "ep", F.posexplode("fingerprint").alias("at", "x")).groupBy("task", "ep", "at").agg((F.sum("x") / prefix).alias("x"))
    centres = one.groupBy("task", "at").agg(F.avg(F.sqrt(F.greatest("x", F.lit(0.0)))).alias("x"))
    rows = centres.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda t: t["x"]).alias("v")).join(limits, "task")
    rows = rows.select("task", "v", "instability_threshold").orderBy("task").limit(most_tasks + 1).collect()
    if len(rows) > most_tasks:
        raise ValueError(f"more than {most_tasks} reference tasks")
    s = W.Series()
    width = how.get("width", 4)
    smooth = steps.select("ep", "q", W.trailing_mean(s, "base", width).alias("m"), F.when(F.col("q") < prefix, F.col("base")).alias("e"))
    still = F.lit(float("inf"))  # an episode that did not move at first tells no ratio: it stands above all that do
    ratio = smooth.groupBy("ep").agg(F.min("m").alias("m"), F.avg("e").alias("e")).select(F.when(F.col("e") > 0, F.col("m") / F.col("e")).when(F.col("m").isNotNull() & (F.col("e") == 0), still).alias("ratio"))
    value = A.quantile_higher(ratio, "ratio", quantile, name="value").head()["value"]
    return ColdStart(float(value), tuple(r["task"] for r in rows), tuple(tuple(r["v"]) for r in rows), tuple(r["instability_threshold"] for r in rows), prefix, **how)


def calibrated(profiles: DataFrame, heads: DataFrame, healthy: Column, spread: float) -> DataFrame:
    """profiles with thresholds: mean plus so many deviations of each head's smoothed score over healthy episodes, to six places."""
    rows = batch(heads.where(healthy)).join(heads.select("ep", "task", "high").distinct(), "ep")
    lock = F.when(F.col("high"), F.col("lock_smoothed")).otherwise(-F.col("lock_smoothed")).cast("double")
    score = dict(zip(THRESHOLDS, (lock, F.col("instability_smoothed").cast("double"))))
    limits = rows.groupBy("task").agg(*[F.round(F.avg(c) + spread * F.stddev_pop(c), 6).alias(n) for n, c in score.items()])
    return profiles.join(limits, "task")
