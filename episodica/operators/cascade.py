"""Cascades over low mobility whose alarms heads explain: same-step reference ranks, typed gates, runs of low steps.

A feature's rank at a step is its midrank among healthy episodes of the same task at the same step. A head is the mean
of its members' ranks (1 - rank for members that count downwards), smoothed. Gates say whether heads confirm a type: a loop
by any high instability in the steps before, a static or a feedback type by two high steps in a row. Low mobility over some
steps in a row is suspect, then a warning, then an alarm, under one threshold; the typed alarm also needs a gate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .ranked import cumulated

#: A head is high above this; steps before that a loop looks at; steps in a row of the other gates.
HIGH, LOOK_BACK, IN_ROW = 0.80, 6, 2
#: Width of the mobility mean and of a head's mean, low steps of a warning and of an alarm.
WIDTH, SMOOTH, WARNING, ALARM = 4, 3, 2, 4


def reference_ranks(df: DataFrame, s: W.Series, features: list[str], keys: list[str], reference: Column, least: int) -> DataFrame:
    """df with rank_<feature>: midrank among the reference rows of the same keys; NULL without a value or with fewer than least of them.

    All features are ranked in one pass: values are counted by key and feature.
    """
    rows = df.withColumn("_ref", F.coalesce(reference, F.lit(False)).cast("int"))
    tall = rows.unpivot([s.ep, s.q, *dict.fromkeys(k for k in keys if k not in (s.ep, s.q)), "_ref"], features, "_feature", "_value").where(F.col("_value").isNotNull())
    c = cumulated(tall, "_value", *keys, "_feature", weight=F.col("_ref"))
    match = [*keys, "_feature", "_value"]
    ranked = tall.join(c, match).where(F.col("_all") >= least).select(s.ep, s.q, "_feature", ((2 * F.col("_upto") - F.col("_n")) / (2 * F.col("_all"))).alias("_rank"))
    wide = ranked.groupBy(s.ep, s.q).agg(*[F.max(F.when(F.col("_feature") == f, F.col("_rank"))).alias(f"rank_{f}") for f in features])
    return df.join(wide, [s.ep, s.q], "left")


def with_heads(df: DataFrame, s: W.Series, heads: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """df (with ranks) with a column for each head."""
    member = lambda f, sign: F.col(f"rank_{f}") if sign > 0 else 1 - F.col(f"rank_{f}")
    now = {f"_{h}": W.complete_mean(*[member(f, sign) for f, sign in members]) for h, members in heads.items()}
    df = df.withColumns(now)
    return df.withColumns({h: W.trailing_mean(s, f"_{h}", SMOOTH) for h in heads}).drop(*now)


def with_gates(df: DataFrame, s: W.Series) -> DataFrame:
    """df with loop, static and feedback gates and the phenotype that they give, static first."""
    high = lambda x: F.coalesce(x > HIGH, F.lit(False))
    still = F.when(F.col("lock_in").isNotNull() & F.col("flat_narrow_support").isNotNull(), F.greatest("lock_in", "flat_narrow_support"))
    df = df.withColumns({"_i": high(F.col("instability")), "_s": high(still), "_f": high(F.col("feedback_decoupling"))})
    df = df.withColumns({"loop": W.past_any(s, "_i", LOOK_BACK), "static": W.all_of_last(s, "_s", IN_ROW), "feedback": W.all_of_last(s, "_f", IN_ROW)})
    kind = F.when(F.col("static"), "static").when(F.col("loop"), "loop").when(F.col("feedback"), "feedback").otherwise("untyped")
    return df.withColumn("phenotype", kind).drop("_i", "_s", "_f")


def cascade(df: DataFrame, s: W.Series, mobility: str, threshold: str) -> DataFrame:
    """df (with gates and a threshold) with the run of low steps, states and first steps of warning, alarm and typed alarm so far."""
    df = df.withColumn("score", -W.trailing_mean(s, mobility, WIDTH))
    df = W.run_length(df, s, F.coalesce(F.col("score") > F.col(threshold), F.lit(False)), "low_run")
    typed = reduce(lambda a, b: a | b, map(F.col, ("loop", "static", "feedback")))
    first = lambda c: F.coalesce(F.min(F.when(c, F.col(s.q))).over(s.past), F.lit(-1))
    df = df.withColumns({"first_warning": first(F.col("low_run") >= WARNING), "first_alarm": first(F.col("low_run") >= ALARM), "first_typed": first((F.col("low_run") >= ALARM) & typed)})
    state = F.when(F.col("first_alarm") >= 0, "alarm").when(F.col("first_warning") >= 0, "warning").when(F.col("low_run") > 0, "suspect").otherwise("normal")
    return df.withColumn("state", state)
