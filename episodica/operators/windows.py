"""Causal window operators along the step axis of an episode.

Each takes a Series (episode and step columns) and gives a column or, where two window passes are needed, a frame.
Episodes partition every window, so all of an operator's windows share one shuffle and one sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranked import cumulated, range_of


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Series:
    """Names of the episode and step columns."""

    ep: str = "ep"
    q: str = "q"

    @property
    def by(self):
        return Window.partitionBy(self.ep).orderBy(self.q)

    def last(self, n: int):
        return self.by.rowsBetween(-(n - 1), 0)

    @property
    def past(self):
        return self.by.rowsBetween(Window.unboundedPreceding, 0)


def local_query(df: DataFrame, ep: str, *order: str, name: str = "q") -> DataFrame:
    """Number the rows of an episode from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(ep).orderBy(*order)) - 1).cast("int"))


def trailing_mean(s: Series, x, n: int, complete: bool = True) -> Column:
    """Mean of the last n rows; complete: NULL unless all n are there and not NULL."""
    mean = F.avg(_c(x)).over(s.last(n))
    return F.when(F.count(_c(x)).over(s.last(n)) == n, mean) if complete else mean


def trailing_range(s: Series, x, n: int) -> Column:
    w = s.last(n)
    return F.when(F.count(_c(x)).over(w) == n, F.max(_c(x)).over(w) - F.min(_c(x)).over(w))


def lag_delta(s: Series, x, k: int) -> Column:
    return _c(x) - F.lag(_c(x), k).over(s.by)


def difference(s: Series, x, order: int) -> Column:
    """Finite difference of the order: velocity, acceleration, jerk; NULL before enough history."""
    from math import comb

    terms = [F.lag(_c(x), k).over(s.by) * ((-1) ** k * comb(order, k)) if k else _c(x) * 1 for k in range(order + 1)]
    return reduce(lambda a, b: a + b, terms)


def return_advantage(s: Series, x) -> Column:
    """Distance to the last row minus the least of those two to four rows back."""
    d = [F.abs(lag_delta(s, x, k)) for k in (1, 2, 3, 4)]
    return F.when(d[3].isNotNull(), d[0] - F.least(*d[1:]))


def recurrence(s: Series, x, scale: float = 1.0) -> Column:
    """Best similarity to two to four rows back minus that to the last row; similarity exp(-|d|/scale). Missing lags are skipped."""
    sim = [F.exp(-F.abs(lag_delta(s, x, k)) / scale) for k in (1, 2, 3, 4)]
    return F.greatest(*sim[1:]) - sim[0]


def trailing_correlation(s: Series, x, y, n: int) -> Column:
    """Pearson correlation of the last n rows, 0 where a side does not vary or rows are missing."""
    w = s.last(n)
    sx, sy = F.sum(_c(x)).over(w), F.sum(_c(y)).over(w)
    sxx, syy, sxy = F.sum(_c(x) * _c(x)).over(w), F.sum(_c(y) * _c(y)).over(w), F.sum(_c(x) * _c(y)).over(w)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    r = (n * sxy - sx * sy) / F.sqrt(vx * vy)
    return F.when((F.count(_c(x)).over(w) == n) & (vx > 1e-9) & (vy > 1e-9), r).otherwise(F.lit(0.0))


def running_max(s: Series, x) -> Column:
    return F.max(_c(x)).over(s.past)


def cumulative_mean(s: Series, x) -> Column:
    return F.avg(_c(x)).over(s.past)


def persistence(s: Series, x, k: int) -> Column:
    """Least of the last k values, NULL unless all are there."""
    return F.when(F.count(_c(x)).over(s.last(k)) == k, F.min(_c(x)).over(s.last(k)))


def k_of_n(s: Series, x, k: int, n: int) -> Column:
    """k-th largest of n rows of contiguous steps."""
    values = F.sort_array(F.collect_list(_c(x)).over(s.last(n)), asc=False)
    whole = (_c(s.q) - F.lag(s.q, n - 1).over(s.by)) == n - 1
    return F.when(whole, F.try_element_at(values, F.lit(k)))


def past_any(s: Series, flag, n: int) -> Column:
    """Did the flag hold in the n rows before this one?"""
    return F.coalesce(F.max(_c(flag).cast("int")).over(s.by.rowsBetween(-n, -1)), F.lit(0)) == 1


def all_of_last(s: Series, flag, k: int) -> Column:
    w = s.last(k)
    return (F.count(_c(flag)).over(w) == k) & (F.min(_c(flag).cast("int")).over(w) == 1)


def islands(df: DataFrame, s: Series, flag, name: str = "island") -> DataFrame:
    """Number the stretches between rows where the flag does not hold."""
    return df.withColumn(name, F.sum(F.when(_c(flag), 0).otherwise(1)).over(s.past))


def run_length(df: DataFrame, s: Series, flag, name: str, cap: int | None = None) -> DataFrame:
    """Consecutive rows up to this one for which the flag holds, 0 where it does not."""
    n = F.sum(F.when(_c(flag), 1).otherwise(0)).over(Window.partitionBy(s.ep, "_island").orderBy(s.q).rowsBetween(Window.unboundedPreceding, 0))
    return islands(df, s, flag, "_island").withColumn(name, F.least(n, F.lit(cap)) if cap else n).drop("_island")


def segments(df: DataFrame, s: Series, flag) -> DataFrame:
    """(ep, start, stop, length) of the maximal runs for which the flag holds."""
    return islands(df, s, flag, "_island").where(_c(flag)).groupBy(s.ep, "_island").agg(F.min(s.q).alias("start"), F.max(s.q).alias("stop"), F.count("*").alias("length")).drop("_island")


def trains(df: DataFrame, s: Series, flag, gap: int) -> DataFrame:
    """Runs that are at most gap steps apart, joined: (ep, first, last, pulses)."""
    runs = segments(df, s, flag)
    by = Window.partitionBy(s.ep).orderBy("start")
    new = F.when(F.col("start") - F.lag("stop").over(by) - 1 <= gap, 0).otherwise(1)
    t = runs.withColumn("_new", new).withColumn("_train", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(s.ep, "_train").agg(F.min("start").alias("first"), F.max("stop").alias("last"), F.count("*").alias("pulses")).drop("_train")


def cusum(df: DataFrame, s: Series, x, drift: float, name: str = "cusum") -> DataFrame:
    """Page's sum S = max(0, S + x - drift), as the running sum above its lowest value so far (or 0)."""
    c = df.withColumn("_c", F.sum(_c(x) - drift).over(s.past))
    return c.withColumn(name, F.col("_c") - F.least(F.min("_c").over(s.past), F.lit(0.0))).drop("_c")


def multiscale_scan(s: Series, x, widths=(1, 2, 4, 8)) -> Column:
    """Largest trailing sum over the root of its rows; windows at the start are partial."""
    return F.greatest(*[F.sum(_c(x)).over(s.last(w)) / F.sqrt(F.count(_c(x)).over(s.last(w))) for w in widths])


def decayed(df: DataFrame, s: Series, x, keep: float, gain: float, name: str, from_first: bool = False) -> DataFrame:
    """y = keep y' + gain x along an episode, from y' = 0 (or y = the first value). A NULL leaves y as it was.

    An episode is folded in blocks of so many values that keep to that power is no double any more: then a block needs of
    all that came before only the fold of the block before it. Steps need not be contiguous, and each row stays whole.
    """
    size = max(2, math.ceil(745 / -math.log(keep)))

    def moved(y: Column, v: Column) -> Column:
        """y after one more value."""
        first = v if from_first else v * gain
        return F.when(v.isNull(), y).when(y.isNull(), first).otherwise(y * keep + v * gain)

    rows = df.select(F.struct("*").alias("_row"), F.col(s.ep).alias("_ep"), F.col(s.q).alias("_q"), _c(x).cast("double").alias("_x"))
    count = F.count("_x").over(Window.partitionBy("_ep").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_block", F.floor(F.greatest(count - 1, F.lit(0)) / size))
    each = rows.groupBy("_ep", "_block").agg(F.array_sort(F.collect_list(F.struct("_q", "_x", "_row")), lambda a, b: F.when(a["_q"] < b["_q"], -1).when(a["_q"] > b["_q"], 1).otherwise(0)).alias("_v"))
    nothing = F.lit(None).cast("double")
    own = F.aggregate("_v", nothing if from_first else F.lit(0.0), lambda y, t: moved(y, t["_x"]))
    each = each.withColumn("_own", own).withColumn("_before", F.lag("_own").over(Window.partitionBy("_ep").orderBy("_block")))
    start = F.coalesce("_before", nothing if from_first else F.lit(0.0))
    path = F.aggregate("_v", F.array(start).cast("array<double>"), lambda acc, t: F.concat(acc, F.array(moved(F.element_at(acc, -1), t["_x"]))))
    done = each.select(F.inline(F.zip_with("_v", F.slice(path, F.lit(2), F.size("_v")), lambda t, y: F.struct(t["_row"].alias("_row"), y.alias("_y")))))
    return done.select("_row.*", F.col("_y").alias(name))


def ewma(df: DataFrame, s: Series, x, weight: float, name: str) -> DataFrame:
    """weight x + (1 - weight) previous, started at the first value."""
    return decayed(df, s, x, 1 - weight, weight, name, from_first=True)


def trailing_slope(s: Series, x, n: int) -> Column:
    return F.regr_slope(_c(x).cast("double"), _c(s.q).cast("double")).over(s.last(n))


def design(s: Series, x, order: int) -> list[Column]:
    """Lagged values and whether they are there."""
    return [c for k in range(1, order + 1) for c in (F.lag(_c(x), k).over(s.by).alias(f"lag{k}"), F.lag(_c(x), k).over(s.by).isNotNull().alias(f"has{k}"))]


def ema_momentum(df: DataFrame, s: Series, x, beta: float, name: str) -> DataFrame:
    """Velocity averaged with weights (1 - beta) beta**k over all steps back."""
    moved = df.withColumn("_step", F.coalesce(lag_delta(s, x, 1), F.lit(0.0)))
    return decayed(moved, s, "_step", beta, 1 - beta, name).drop("_step")


def adjacent_min(s: Series, x) -> Column:
    return F.when(F.lag(_c(x)).over(s.by).isNotNull(), F.least(_c(x), F.lag(_c(x)).over(s.by)))


def geometric_mean(a, b) -> Column:
    """Square root of the product, clipped to 0 and 1 first."""
    return F.sqrt(F.least(F.greatest(_c(a) * _c(b), F.when((_c(a) * _c(b)).isNotNull(), 0.0)), F.when((_c(a) * _c(b)).isNotNull(), 1.0)))


def complete_mean(*xs) -> Column:
    """Mean of columns, NULL unless all are there."""
    return reduce(lambda a, b: a + b, map(_c, xs)) / len(xs)


def max_with_fallback(base, more) -> Column:
    """The larger of two; the base where the addition is missing; NULL without a base."""
    return F.when(_c(base).isNotNull(), F.greatest(_c(base), F.coalesce(_c(more), _c(base))))


def rank_within(x, *group: str) -> Column:
    """Average-tie rank scaled to 0..1 within the group; 0.5 for a single row."""
    g = Window.partitionBy(*group)
    r = F.rank().over(g.orderBy(_c(x))) + (F.count("*").over(Window.partitionBy(*group, _c(x))) - 1) / 2.0
    n = F.count("*").over(g)
    return F.when(n > 1, (r - 1) / (n - 1)).otherwise(F.lit(0.5))


def midrank(df: DataFrame, x: str, reference: str, name: str, *group: str) -> DataFrame:
    """Percentile (rows of reference at or below x, plus a half, over their number plus one). Counts are by value: no group is sorted as rows."""
    return midranks(df, x, reference, {name: group})


def midranks(df: DataFrame, x: str, reference: str, groups: dict[str, tuple]) -> DataFrame:
    """df with a percentile of x for each name and its grouping."""
    ranges, out = range_of(df, x), df
    for k, (name, group) in enumerate(groups.items()):
        c = cumulated(df, x, *group, weight=_c(reference).cast("int"), ranges=ranges)
        c = c.select(*[F.col(g).alias(f"_g{k}_{i}") for i, g in enumerate(group)], F.col(x).alias(f"_value{k}"), ((F.col("_upto") + 0.5) / (F.col("_all") + 1)).alias(name))
        match = F.col(x).eqNullSafe(F.col(f"_value{k}"))
        for i, g in enumerate(group):
            match = match & F.col(g).eqNullSafe(F.col(f"_g{k}_{i}"))
        out = out.join(c, match).select(*out.columns, name)
    return out


def first_crossing(df: DataFrame, s: Series, score, threshold, name: str = "first") -> DataFrame:
    """First step with a score above the threshold, -1 if there is none."""
    return df.groupBy(s.ep).agg(F.coalesce(F.min(F.when(_c(score) > threshold, _c(s.q))), F.lit(-1)).alias(name))


def both_alarms(a, b) -> Column:
    """Later of two first alarms, -1 unless both fired."""
    return F.when((_c(a) >= 0) & (_c(b) >= 0), F.greatest(_c(a), _c(b))).otherwise(F.lit(-1))


def either_alarm(a, b) -> Column:
    """Earlier of two first alarms, -1 if neither fired."""
    return F.when(_c(a) < 0, _c(b)).when(_c(b) < 0, _c(a)).otherwise(F.least(_c(a), _c(b)))


def peaks(df: DataFrame, s: Series, score, name: str = "peak") -> DataFrame:
    """Largest score of an episode; -infinity if it never had one, so short episodes stay in the population."""
    return df.groupBy(s.ep).agg(F.coalesce(F.max(_c(score)), F.lit(float("-inf"))).alias(name))
