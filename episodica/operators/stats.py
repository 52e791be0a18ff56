"""Statistics: rank AUC, order-statistic quantiles, thresholds, survival, tables, tests in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranked import cumulated, range_of


def average_rank(x: str, *group: str) -> Column:
    """Average-tie rank from 1 within the group."""
    return F.rank().over(Window.partitionBy(*group).orderBy(x)) + (F.count("*").over(Window.partitionBy(*group, x)) - 1) / 2.0


def value_counts_auc(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """Mann-Whitney U and its pairs, for each group (groups lacking a class are dropped).

    Rows are first counted by value, so the ordered pass is over distinct values, and a hot group shrinks before it.
    Without groups the ordered pass runs in ranges of values: each adds the negatives of the ranges below it.
    """
    v = df.groupBy(*group, x).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("n"))
    keys = list(group) or ["_range"]
    if not group:
        v = v.withColumn("_range", range_of(df, x))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = v.withColumn("_u", F.col("p") * (below + F.col("n") / 2.0))
    out = u.groupBy(*keys).agg(F.sum("_u").alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    if not group:
        before = F.coalesce(F.sum("n_neg").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over the ranges
        out = out.withColumn("u", F.col("u") + F.col("n_pos") * before).agg(F.sum("u").alias("u"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    return out.where("n_pos > 0 and n_neg > 0")


def auc(df: DataFrame, x: str, y: str) -> DataFrame:
    return value_counts_auc(df, x, y).select((F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def stratified_auc(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """Sum of the groups' U over the sum of their pairs: weighs pairs, is no mean of AUCs."""
    return value_counts_auc(df, x, y, *group).agg((F.sum("u") / F.sum(F.col("n_pos") * F.col("n_neg"))).alias("auc"), F.count("*").alias("groups"))


def quantile_higher(df: DataFrame, x: str, q: float, *group: str, name: str = "threshold", least: int = 1) -> DataFrame:
    """sorted[ceil(q (n - 1))] of each group: never interpolates; NULL under `least` values."""
    v = cumulated(df.where(F.col(x).isNotNull() & ~F.isnan(x)), x, *group)
    pick = F.min(F.when(F.col("_upto") >= F.ceil((F.col("_all") - 1) * q - 1e-9) + 1, F.col(x)))
    return v.groupBy(*group).agg(F.when(F.max("_all") >= least, pick).alias(name), F.max("_all").alias("n"))


def quantile_linear(df: DataFrame, x: str, q: float, *group: str, name: str = "quantile") -> DataFrame:
    """The quantile that interpolates between the two values around position q (n - 1), from counts by value."""
    v = cumulated(df.where(F.col(x).isNotNull() & ~F.isnan(x)), x, *group)
    at = (F.col("_all") - 1) * q
    near = lambda c: F.min(F.when(F.col("_upto") >= c + 1, F.col(x)))
    low, high = near(F.floor(at)), near(F.ceil(at))
    return v.groupBy(*group).agg((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias(name))


def conformal_threshold(df: DataFrame, x: str, alpha: float, *group: str) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest, infinity if there is none."""
    v = cumulated(df, x, *group)
    pick = F.min(F.when(F.col("_upto") >= F.ceil((F.col("_all") + 1) * (1 - alpha) - 1e-9), F.col(x)))
    return v.groupBy(*group).agg(F.coalesce(pick, F.lit(float("inf"))).alias("threshold"))


def budgeted_threshold(df: DataFrame, x: str, budget: float, *group: str) -> DataFrame:
    """Smallest value with a share of values at or above it within the budget; NULL if even the largest has more."""
    v = cumulated(df, x, *group)
    above = (F.col("_all") - F.col("_upto") + F.col("_n")) / F.col("_all")
    return v.groupBy(*group).agg(F.min(F.when(above <= budget, F.col(x))).alias("threshold"))


def confusion(df: DataFrame, alarm: Column, risk: Column, *columns: str) -> DataFrame:
    """Counts and rates; a rate without cases is NULL."""
    tp, fp, fn, tn = (F.count_if(a & r) for a, r in ((alarm, risk), (alarm, ~risk), (~alarm, risk), (~alarm, ~risk)))
    out = df.groupBy(*columns).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return rates(out)


def rates(df: DataFrame) -> DataFrame:
    """Recall, precision and false positive rate from counts."""
    c = lambda n: F.col(n).cast("double")
    return df.withColumns({"recall": F.try_divide(c("tp"), c("tp") + c("fn")), "precision": F.try_divide(c("tp"), c("tp") + c("fp")), "fpr": F.try_divide(c("fp"), c("fp") + c("tn"))})


def kaplan_meier(df: DataFrame, time: str, event: str) -> DataFrame:
    """(time, at_risk, deaths, survival); the product is cut at a hazard of one, whose logarithm does not exist."""
    t = df.groupBy(time).agg(F.count("*").alias("_n"), F.sum(F.col(event).cast("int")).alias("deaths"))
    back = Window.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)  # over distinct times
    t = t.withColumn("at_risk", F.sum("_n").over(back)).withColumn("_h", F.col("deaths") / F.col("at_risk"))
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    alive = F.when(F.max("_h").over(w) >= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(F.greatest(1 - F.col("_h"), F.lit(1e-300)))).over(w)))
    return t.select(time, "at_risk", "deaths", alive.alias("survival"))


def stationary(cells: DataFrame, doublings: int = 6, most: int = 200) -> DataFrame:
    """(state, share) of a chain after 2**doublings steps from all states alike, from transition rows (s, s2, p).

    The matrix of at most so many states is squared on the driver; more states raise. A state without transitions stays where it is.
    """
    import numpy as np

    rows = cells.select("s", "s2", "p").limit(most * most + 1).collect()
    states = sorted({r[0] for r in rows} | {r[1] for r in rows})
    if len(states) > most or len(rows) > most * most:
        raise ValueError(f"more than {most} states")
    at = {state: i for i, state in enumerate(states)}
    m = np.zeros((len(states), len(states)))
    for s, s2, p in rows:
        m[at[s], at[s2]] += p
    stuck = m.sum(1) == 0
    m[stuck, stuck] = 1.0
    share = np.linalg.matrix_power(m, 2**doublings).mean(0) if states else []
    kind = cells.schema["s"].dataType.simpleString()
    return cells.sparkSession.createDataFrame([(k, float(v)) for k, v in zip(states, share) if v > 0], f"state {kind}, share double")


def transition_matrix(df: DataFrame, ep: str, order: list[str], state: str) -> DataFrame:
    """(state, next state, n, share of the state's transitions)."""
    nxt = F.lead(state).over(Window.partitionBy(ep).orderBy(*order))
    n = df.select(F.col(state).alias("s"), nxt.alias("s2")).where("s2 is not null").groupBy("s", "s2").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("s")))


def calibration_bins(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Equal-width bins: rows, mean prediction, share of positives."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def ece_brier(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    t = calibration_bins(df, p, y, bins)
    e = t.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return e.crossJoin(df.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier")))


def spearman(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """Pearson correlation of average ranks; NULL under three rows or without variation."""
    r = df.select(*group, average_rank(x, *group).alias("_x"), average_rank(y, *group).alias("_y"))
    n, sx, sy = F.count("*"), F.sum("_x"), F.sum("_y")
    vx = n * F.sum(F.col("_x") * F.col("_x")) - sx * sx
    vy = n * F.sum(F.col("_y") * F.col("_y")) - sy * sy
    rho = F.try_divide(n * F.sum(F.col("_x") * F.col("_y")) - sx * sy, F.sqrt(vx * vy))
    return r.groupBy(*group).agg(F.when((n >= 3) & (vx > 0) & (vy > 0), rho).alias("rho"), n.alias("n"))


def rank_residual(df: DataFrame, score: str, baseline: str, *group: str, least: int = 4) -> DataFrame:
    """Residual of the score's ranks on the baseline's ranks within a group, by ordinary least squares."""
    r = df.withColumn("_y", average_rank(score, *group)).withColumn("_x", average_rank(baseline, *group))
    w = Window.partitionBy(*group)
    mx, my = F.avg("_x").over(w), F.avg("_y").over(w)
    sxx = F.avg(F.col("_x") * F.col("_x")).over(w) - mx * mx
    sxy = F.avg(F.col("_x") * F.col("_y")).over(w) - mx * my
    res = F.col("_y") - my - F.coalesce(F.try_divide(sxy, F.when(sxx > 1e-9, sxx)), F.lit(0.0)) * (F.col("_x") - mx)
    return r.withColumn("residual", F.when(F.count("*").over(w) >= least, res)).drop("_x", "_y")


def icc_binary(df: DataFrame, fails: str, n: str) -> DataFrame:
    """One-way ANOVA intraclass correlation of binary outcomes from group counts, for groups of unequal size."""
    a = df.agg(F.count("*").alias("k"), F.sum(n).cast("double").alias("t"), F.sum(F.col(n) * F.col(n)).cast("double").alias("n2"), F.sum(fails).cast("double").alias("f"), F.sum(F.col(fails) * F.col(fails) / F.col(n)).alias("f2"))
    k0 = (F.col("t") - F.col("n2") / F.col("t")) / (F.col("k") - 1)
    msb = (F.col("f2") - F.col("f") * F.col("f") / F.col("t")) / (F.col("k") - 1)
    msw = (F.col("f") - F.col("f2")) / (F.col("t") - F.col("k"))
    return a.select(((msb - msw) / (msb + (k0 - 1) * msw)).alias("icc"), "k")


def benjamini_hochberg(df: DataFrame, p: str, *order: str) -> DataFrame:
    """Adjusted p values: running least of p m / i from the largest p down (a family is a small table)."""
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    i = F.row_number().over(Window.orderBy(p, *order))
    t = df.withColumn("_raw", F.col(p) * m / i)
    return t.withColumn("adjusted", F.least(F.min("_raw").over(Window.orderBy(F.desc(p), *[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_raw")


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))


def sign_test(positive: Column, negative: Column) -> Column:
    """Two-sided exact sign test: twice the smaller binomial tail, at most one."""
    n, k = positive + negative, F.least(positive, negative)
    tail = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * math.log(2)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(2 * tail, F.lit(1.0)))


def hypergeometric_hit(p: Column, k: int, n: Column) -> Column:
    """Chance that k of n drawn at random include one of p: 1 - C(n - p, k) / C(n, k)."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    return 1 - F.aggregate(steps, F.lit(1.0), lambda s, i: s * F.greatest(n - p - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: tables no likelier than the one seen."""
    r, s, n = a + b, a + c, a + b + c + d
    lp = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(n - r + 1) - math.lgamma(s - x + 1) - math.lgamma(n - r - s + x + 1) - math.lgamma(n + 1) + math.lgamma(s + 1) + math.lgamma(n - s + 1)
    seen = lp(a)
    return min(1.0, sum(math.exp(lp(x)) for x in range(max(0, r + s - n), min(r, s) + 1) if lp(x) <= seen + 1e-9))


def beta_quantile(q: float, a: float, b: float) -> float:
    """Quantile of the beta distribution, by bisection on the incomplete beta integral's continued fraction."""

    def cdf(x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - _beta_cf(1 - x, b, a)
        return _beta_cf(x, a, b)

    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
    return (lo + hi) / 2


def _beta_cf(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-30)
        c = 1 + num / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    return (0.0 if k == 0 else beta_quantile(alpha / 2, k, n - k + 1)), (1.0 if k == n else beta_quantile(1 - alpha / 2, k + 1, n - k))
