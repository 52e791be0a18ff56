"""Sorting, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranked import numbered, range_of


def stable_topk(df: DataFrame, score: str, ident: str, k: int) -> DataFrame:
    """k rows of largest score, of equals the least id; rows without a finite score are out."""
    return df.where(F.col(score).isNotNull() & ~F.isnan(score)).orderBy(F.desc(score), ident).limit(k)


def per_pool_topk(df: DataFrame, pool: list[str], score: str, ident: str, k: int) -> DataFrame:
    w = Window.partitionBy(*pool).orderBy(F.desc(score), ident)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quota_topk(df: DataFrame, first: str, second: str, ident: str, k: int) -> DataFrame:
    """(ident, priority): half from the first list, the rest from the second, doubles once; what is missing comes by the better of both ranks.

    Ranks beyond 2 k never count, so both lists are cut by a top-k before they are numbered.
    """

    def top(c: str, name: str) -> DataFrame:
        w = Window.orderBy(F.desc(c), ident)  # over 2 k rows
        return df.orderBy(F.desc(c), ident).limit(2 * k).select(ident, F.row_number().over(w).alias(name))

    r = top(first, "_a").join(top(second, "_b"), ident, "full_outer")
    own = F.when(F.col("_a") <= k // 2, F.col("_a")).when(F.col("_b") <= k - k // 2, F.col("_b") + k).otherwise(F.least("_a", "_b") + 3 * k)
    return r.select(ident, own.alias("priority")).orderBy("priority", ident).limit(k)


def pareto(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in one measure without losing in the other; equal rows all stay.

    The best y of all larger x is the best of the ranges above and of the larger x in the own range.
    """
    best = df.groupBy(x).agg(F.max(y).alias("_y"))
    best = best.withColumn("_range", range_of(df, x))
    above = best.groupBy("_range").agg(F.max("_y").alias("_m"))
    above = above.select("_range", F.max("_m").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))  # a row for each range
    own = F.max("_y").over(Window.partitionBy("_range").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    prior = F.greatest("_own", "_above")  # of those there are
    keep = best.withColumn("_own", own).join(F.broadcast(above), "_range").where(prior.isNull() | (F.col("_y") > prior)).select(x, F.col("_y").alias(y))
    return df.join(keep, [x, y], "left_semi")


def folds(units: DataFrame, ident: str, k: int, seed: int = 7) -> DataFrame:
    """Units dealt into k folds of nearly equal size (the first ones larger), in the order of a hash of their id."""
    from ..functions.scalars import lcg

    n = units.count()
    rows = numbered(units.withColumn("_h", lcg(F.lit(seed), F.col(ident))), "_h", ident, name="_at")
    size, more = divmod(n, k)
    at, edge = F.col("_at"), more * (size + 1)
    fold = F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / max(1, size)))
    return rows.withColumn("fold", fold).drop("_h", "_at")


def evenly_spaced(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """At most k rows of each group at evenly spaced ranks (first and last among them), rounded half to even."""
    w = Window.partitionBy(*group)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(1, k - 1))), 0).cast("int"))
    return r.where((F.col("_n") <= k) | F.array_contains(at, F.col("_r").cast("int"))).drop("_r", "_n")


def balanced_sample(df: DataFrame, group: str, ident: str, k: int, seed: int = 7) -> DataFrame:
    """At most k rows of each group, those of least hash."""
    from ..functions.scalars import lcg

    w = Window.partitionBy(group).orderBy(lcg(F.lit(seed), F.col(ident)), ident)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
