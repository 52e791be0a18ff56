"""Family-wise tests, paired comparisons, rank tests, risk-bounded selection and Markov chances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lcg
from .resample import bootstrap, draws
from .stats import beta_quantile


def sign_flip_maxt(effects: DataFrame, value: str, group: str, cell: str, n: int, seed: int = 7) -> DataFrame:
    """(cell, observed mean, add-one p against the largest cell of each draw); a group's signs flip in all its cells at once."""
    d = draws(effects.where(F.col(value).isNotNull()), n + 1)
    sign = F.when(F.col("draw") == 0, 1).otherwise(1 - 2 * F.pmod(F.floor(lcg(F.lit(seed), F.col("draw"), F.col(group)) / 1024), F.lit(2)))
    stats = d.groupBy("draw", cell).agg(F.avg(F.col(value) * sign).alias("stat"))
    top = stats.where("draw > 0").groupBy("draw").agg(F.max(F.abs("stat")).alias("top")).agg(F.collect_list("top").alias("tops"))  # one row of n numbers
    seen = stats.where("draw = 0").select(cell, F.col("stat").alias("observed")).crossJoin(F.broadcast(top))
    beyond = F.size(F.filter("tops", lambda t: t >= F.abs("observed") - 1e-12))
    return seen.select(cell, "observed", ((beyond + 1) / (F.size("tops") + 1)).alias("p"))


def paired_bootstrap(units: DataFrame, left: str, right: str, ident: str, n: int, seed: int = 7) -> DataFrame:
    """(mean difference, 95 % interval, two-sided p) of two arms whose units are drawn together; units without both arms are left out."""
    whole = units.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(ident, (F.col(left) - F.col(right)).alias("_d"))
    seen = whole.agg(F.avg("_d").alias("delta"))
    drawn = bootstrap(whole, ident, n, seed).groupBy("draw").agg(F.avg("_d").alias("_m"))
    out = drawn.agg(F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("_m") <= 0).cast("int")), F.avg((F.col("_m") >= 0).cast("int")))).alias("p"))
    return seen.crossJoin(F.broadcast(out))  # one row each


def rank_sum(df: DataFrame, value: str, positive: Column, *group: str) -> DataFrame:
    """Mann-Whitney test of each group: (group, U of the positives, z with the correction for ties).

    Counts of each value come first, so a window row is a distinct value, not an input row.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count_if(positive).alias("_a"), F.count("*").alias("_t"))
    below = F.sum("_t").over(Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("_rank", F.coalesce(below, F.lit(0)) + (F.col("_t") + 1) / 2)
    s = c.groupBy(*group).agg(F.sum(F.col("_a") * F.col("_rank")).alias("_r"), F.sum("_a").cast("double").alias("_n"), F.sum("_t").cast("double").alias("_m"), F.sum(F.pow(F.col("_t").cast("double"), F.lit(3)) - F.col("_t")).alias("_ties"))
    n, m = F.col("_n"), F.col("_m")
    u, spread = F.col("_r") - n * (n + 1) / 2, n * (m - n) / 12 * (m + 1 - F.col("_ties") / (m * (m - 1)))
    return s.where((n > 0) & (m > n)).select(*group, u.alias("u"), F.when(spread > 0, (u - n * (m - n) / 2) / F.sqrt(spread)).otherwise(0.0).alias("z"))


def signed_rank(df: DataFrame, difference: str, *group: str) -> DataFrame:
    """Wilcoxon signed-rank test of each group: (group, rank sum of positive differences, z); zeros are left out."""
    c = df.where(F.col(difference) != 0).groupBy(*group, F.abs(difference).alias("_v")).agg(F.count_if(F.col(difference) > 0).alias("_a"), F.count("*").alias("_t"))
    below = F.sum("_t").over(Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("_rank", F.coalesce(below, F.lit(0)) + (F.col("_t") + 1) / 2)
    s = c.groupBy(*group).agg(F.sum(F.col("_a") * F.col("_rank")).alias("w"), F.sum("_t").cast("double").alias("_n"), F.sum(F.pow(F.col("_t").cast("double"), F.lit(3)) - F.col("_t")).alias("_ties"))
    n = F.col("_n")
    return s.select(*group, "w", ((F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)).alias("z"))


def risk_upper_bound(false_alarms: int, total: int, delta: float) -> float:
    """Clopper-Pearson upper bound of the alarm rate at a one-sided level."""
    return 1.0 if total == 0 or false_alarms >= total else beta_quantile(1 - delta, false_alarms + 1, total - false_alarms)


def learn_then_test(peaks: DataFrame, channel: str, peak: str, event: str, quantiles: tuple[float, ...], alpha: float, delta: float) -> DataFrame:
    """Candidate thresholds (quantiles of each channel's healthy peaks) with their bounds; selected marks the best accepted one.

    A candidate is accepted if the upper bound of its false-alarm rate, at delta over the number of candidates, is alpha
    at most; of the accepted the one of highest recall wins, then of least bound. Candidates are few: one for each
    channel and quantile.
    """
    healthy = peaks.where(~F.col(event))
    marks = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{peak}`)").alias(f"_q{i}") for i, q in enumerate(quantiles)]
    at = healthy.groupBy(channel).agg(*marks)
    grid = at.select(channel, F.posexplode(F.array(*[f"_q{i}" for i in range(len(quantiles))])).alias("_i", "threshold"))
    grid = grid.withColumn("quantile", F.element_at(F.array(*map(F.lit, quantiles)), F.col("_i") + 1)).drop("_i")
    hit = F.col(peak) > F.col("threshold")
    out = peaks.join(F.broadcast(grid), channel).groupBy(channel, "quantile", "threshold")  # one row of grid for each candidate
    out = out.agg(F.count_if(hit & ~F.col(event)).alias("false_alarms"), F.count_if(~F.col(event)).alias("healthy"), (F.count_if(hit & F.col(event)) / F.greatest(F.count_if(F.col(event)), F.lit(1))).alias("recall"))

    @F.pandas_udf("double")
    def bound(k: pd.Series, n: pd.Series, family: pd.Series) -> pd.Series:
        return pd.Series([risk_upper_bound(int(a), int(b), delta / int(m)) for a, b, m in zip(k, n, family)], dtype=float)

    every = Window.partitionBy(F.lit(1))  # candidates only
    out = out.withColumn("_family", F.count("*").over(every)).withColumn("bound", bound("false_alarms", "healthy", "_family"))
    out = out.withColumn("accepted", F.col("bound") <= alpha)
    place = F.row_number().over(every.orderBy(F.desc("accepted"), F.desc("recall"), "bound", channel, "quantile"))
    return out.withColumn("selected", F.col("accepted") & (place == 1)).drop("_family")


def hitting(cells: DataFrame, target, steps: int) -> DataFrame:
    """(state, chance of having met the target within so many steps) from transition rows (s, s2, p).

    The states are few: the matrix is one row, and the steps are folds over it.
    """
    one = cells.agg(F.collect_list(F.struct("s", "s2", "p")).alias("m"), F.array_sort(F.collect_set("s")).alias("states"))
    start = F.transform("states", lambda s: F.when(s == target, 1.0).otherwise(0.0))

    def step(h: Column, _: Column) -> Column:
        def of(s: Column) -> Column:
            at = lambda c: F.coalesce(F.try_element_at(h, F.array_position("states", c["s2"]).cast("int")), F.lit(0.0))
            return F.when(s == target, 1.0).otherwise(F.aggregate(F.filter("m", lambda c: c["s"] == s), F.lit(0.0), lambda a, c: a + c["p"] * at(c)))

        return F.transform("states", of)

    chance = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return one.select(F.explode(F.arrays_zip(F.col("states").alias("s"), chance.alias("chance"))).alias("x")).select("x.s", "x.chance")
