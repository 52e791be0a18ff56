"""Resampling: permutation, sign flips and bootstraps whose draws follow from ids alone.

A draw's randomness is a linear congruential hash of (seed, draw, id), so any engine and any partitioning repeats it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lcg
from .ranked import numbered


def draws(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each draw."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sign_flips(effects: DataFrame, value: str, group: str, n: int, seed: int = 7) -> DataFrame:
    """(draw, mean of the group effects under random signs); draw 0 keeps all signs."""
    d = draws(effects, n)
    sign = F.when(F.col("draw") == 0, 1).otherwise(1 - 2 * F.pmod(F.floor(lcg(F.lit(seed), F.col("draw"), F.col(group)) / 1024), F.lit(2)))
    return d.groupBy("draw").agg(F.avg(F.col(value) * sign).alias("stat"))


def add_one_p(stats: DataFrame, stat: str = "stat") -> DataFrame:
    """(1 + draws at least as far out as the observed draw 0) / (1 + draws), two-sided."""
    seen = stats.where("draw = 0").select(F.abs(stat).alias("_o"))
    rest = stats.where("draw > 0").crossJoin(F.broadcast(seen))  # one row
    return rest.agg(F.max("_o").alias("observed"), ((F.count_if(F.abs(F.col(stat)) >= F.col("_o") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def permuted(df: DataFrame, label: str, group: list[str], ident: str, n: int, seed: int = 7) -> DataFrame:
    """Labels shuffled within groups for every draw: the row of hash rank r gets the label of the row of id rank r."""
    base = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(ident)))
    d = draws(base.drop(label), n)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("draw", *group).orderBy(F.when(F.col("draw") == 0, F.col("_r")).otherwise(lcg(F.lit(seed), F.col("draw"), F.col(ident))), ident)))
    return d.join(base.select(*group, "_r", label), [*group, "_r"]).drop("_r")


def bootstrap(units: DataFrame, ident: str, n: int, seed: int = 7) -> DataFrame:
    """Units drawn with replacement: (draw, all columns of the drawn unit). Units are numbered by id."""
    rows = numbered(units, ident, name="_i")
    size = units.agg(F.count("*").alias("_n"))
    picks = draws(rows.select(F.col("_i").alias("_slot")).crossJoin(F.broadcast(size)), n)
    picks = picks.withColumn("_i", F.pmod(F.floor(lcg(F.lit(seed), F.col("draw"), F.col("_slot")) / 64), F.col("_n")).cast("long"))
    return picks.select("draw", "_i").join(rows, "_i").drop("_i")


def percentile_interval(stats: DataFrame, stat: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    return stats.agg(F.percentile(stat, F.lit(lo)).alias("lo"), F.percentile(stat, F.lit(hi)).alias("hi"))


def crossed_weights(df: DataFrame, first: str, second: str, n: int, seed: int = 7) -> DataFrame:
    """Two-axis bootstrap: every row with the product of its two units' draw counts as weight."""

    def counts(axis: str, salt: int) -> DataFrame:
        u = df.select(axis).distinct()
        return bootstrap(u, axis, n, seed + salt).groupBy("draw", axis).agg(F.count("*").alias(f"_w_{axis}"))

    return df.join(counts(first, 1), first).join(counts(second, 2), ["draw", second]).withColumn("weight", F.col(f"_w_{first}") * F.col(f"_w_{second}"))
