"""Joins: validated, matched-control, lead-grid, as-of, self-join events, leave-one-group-out, fallback, nearest neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: must be empty for the one-side of a validated join."""
    return df.groupBy(*keys).count().where("count > 1")


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """Equi-join that fails at run time if a side that must be unique is not."""
    once = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy(*on))).where(F.assert_true(F.col("_n") == 1, F.lit("key is not unique")).isNull()).drop("_n")
    if validate.startswith("one"):
        left = once(left)
    if validate.endswith("one"):
        right = once(right)
    return left.join(right, on, how)


def key_audit(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Number of keys in both, the left only and the right only."""
    a, b = left.select(*on).distinct().withColumn("_l", F.lit(1)), right.select(*on).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, on, "full_outer")
    return j.agg(F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"))


def lead_grid(events: DataFrame, onset: str, leads: list[int], name: str = "q") -> DataFrame:
    """One row for each event and lead, at the step onset + lead."""
    return events.withColumn("lead", F.explode(F.array(*map(F.lit, leads)))).withColumn(name, F.col(onset) + F.col("lead")).where(F.col(name) >= 0)


def matched_controls(cases: DataFrame, population: DataFrame, group: list[str], step: str, event: str, score: str) -> DataFrame:
    """Each case row with the event-free rows of its group at the same step: (event, step, case_score, controls, best, beaten).

    beaten is the share of the controls' scores below the case's, ties half. Controls are counted by score and met in one sorted
    pass with the cases, so no pair of a case and a control is a row. Cases without a control are left out.
    """
    at = [*group, step]
    c = cases.select(*at, F.col(event).alias("_event"), F.col(score).cast("double").alias("_s"), F.lit(0).alias("_n"))
    p = population.groupBy(*at, F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("_n")).withColumn("_event", F.lit(None).cast(cases.schema[event].dataType))
    u = p.withColumn("_case", F.lit(False)).unionByName(c.withColumn("_case", F.lit(True)))
    by = Window.partitionBy(*at)
    there = F.when(F.col("_s").isNotNull(), F.col("_n")).otherwise(0)  # a missing score neither wins nor loses
    upto = F.sum(there).over(by.orderBy("_s").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.sum(there).over(Window.partitionBy(*at, "_s"))
    u = u.withColumn("controls", F.sum("_n").over(by)).withColumn("best", F.max(F.when(~F.col("_case"), F.col("_s"))).over(by)).withColumn("_below", upto - tied).withColumn("_tied", tied)
    found = u.where(F.col("_case") & (F.col("controls") > 0))
    return found.select(F.col("_event").alias(event), step, F.col("_s").alias("case_score"), "controls", "best", F.when(F.col("_s").isNull(), 0.0).otherwise((F.col("_below") + F.col("_tied") / 2) / F.col("controls")).alias("beaten"))


def event_mean_auc(matched: DataFrame, event: str) -> DataFrame:
    """Share of its matched controls that an event beats (ties half), averaged over events."""
    one = matched.groupBy(event).agg((F.sum(F.col("beaten") * F.col("controls")) / F.sum("controls")).alias("w"))
    return one.agg(F.avg("w").alias("auc"), F.count("*").alias("events"))


def paired_extremes(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, pairs, widest): of all pairs of a key's rows in a and b their number and their largest difference, from counts and extremes."""
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"_n{n}"), F.min(value).alias(f"_lo{n}"), F.max(value).alias(f"_hi{n}"))
    j = side(a, 1).join(side(b, 2), key)
    return j.select(key, (F.col("_n1") * F.col("_n2")).alias("pairs"), F.greatest(F.col("_hi1") - F.col("_lo2"), F.col("_hi2") - F.col("_lo1")).alias("widest"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, tie: list[str]) -> DataFrame:
    """Last value of right at or before each left row: one union and one window, no range join."""
    names = [c for c in left.columns if c not in by and c != on]
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, on, F.col(value).alias("_v"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)]).withColumn("_side", F.lit(0))
    u = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "_side", *[f"_t{i}" for i in range(len(tie))]).rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*by, on, *names, value)


def first_return(df: DataFrame, ep: str, q: str, x: str, near: float, gap: int) -> DataFrame:
    """Earliest step whose value is within near of one at least gap steps earlier in the episode (theta self-join inside episodes)."""
    a = df.select(ep, F.col(q).alias("q1"), F.col(x).alias("x1"))
    b = df.select(ep, F.col(q).alias("q2"), F.col(x).alias("x2"))
    hit = a.join(b, ep).where((F.col("q1") <= F.col("q2") - gap) & (F.abs(F.col("x1") - F.col("x2")) <= near))
    return hit.groupBy(ep).agg(F.min("q2").alias("first_return"))


def leave_one_out(df: DataFrame, group: list[str], fold: str, *values: str) -> DataFrame:
    """Sums and counts of all other folds of the group, as the total minus the fold's own (no inequality join)."""
    own = df.groupBy(*group, fold).agg(*[F.sum(v).alias(f"_s_{v}") for v in values], F.count("*").alias("_n"))
    w = Window.partitionBy(*group)
    return own.select(*group, fold, *[((F.sum(f"_s_{v}").over(w) - F.col(f"_s_{v}")) / F.nullif(F.sum("_n").over(w) - F.col("_n"), F.lit(0))).alias(f"other_mean_{v}") for v in values], (F.sum("_n").over(w) - F.col("_n")).alias("other_n"))


def with_fallback(df: DataFrame, x: str, cell: list[str], task: list[str], least: int, stat) -> DataFrame:
    """A statistic of the cell where it has enough rows, else of the task, else of all."""
    c = df.groupBy(*task, *cell).agg(stat(x).alias("_c"), F.count(x).alias("_cn"))
    t = df.groupBy(*task).agg(stat(x).alias("_t"), F.count(x).alias("_tn"))
    g = df.agg(stat(x).alias("_g"))  # one row
    out = c.join(t, task).crossJoin(F.broadcast(g))
    level = F.when(F.col("_cn") >= least, "cell").when(F.col("_tn") >= least, "task").otherwise("global")
    return out.select(*task, *cell, level.alias("level"), F.when(F.col("_cn") >= least, F.col("_c")).when(F.col("_tn") >= least, F.col("_t")).otherwise(F.col("_g")).alias("stat"))


def nearest_in_order(df: DataFrame, group: list[str], key: str, x: str, k: int) -> DataFrame:
    """(group, key, other, rank): the k rows of other keys nearest in x within each group; ties go to the smaller key.

    Rows are read in order of x. The k nearest lie among the k distinct values on either side and the value itself, and
    of one value only its k + 1 smallest keys can be among them, so no pairs of a whole group are formed.
    """
    first = Window.partitionBy(*group, x).orderBy(key)
    few = df.select(*group, key, x).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    values = few.groupBy(*group, x).agg(F.array_sort(F.collect_list(key)).alias("_keys"))  # k + 1 at most
    near = F.collect_list(F.struct(F.col(x).alias("v"), F.col("_keys").alias("keys"))).over(Window.partitionBy(*group).orderBy(x).rowsBetween(-k, k))
    found = values.withColumn("_near", near).select(*group, x, "_near")
    flat = F.flatten(F.transform("_near", lambda t: F.transform(t["keys"], lambda o: F.struct(F.abs(t["v"] - F.col(x)).alias("d"), o.alias("other")))))
    own = df.select(*group, key, x).join(found, [*group, x])
    best = F.slice(F.array_sort(F.filter(flat, lambda t: t["other"] != F.col(key))), 1, k)
    return own.select(*group, key, F.posexplode(best).alias("_at", "_t")).select(*group, key, F.col("_t.other").alias("other"), (F.col("_at") + 1).cast("long").alias("rank"))


def nn_concordance(df: DataFrame, cell: list[str], key: str, x: str, label: str) -> DataFrame:
    """(cell, rows, concordant): rows whose nearest other row of the cell in x has their label; ties go to the smaller key. Rows alone in a cell count nowhere."""
    near = nearest_in_order(df, cell, key, x, 1).select(*cell, key, "other")
    theirs = df.select(*cell, F.col(key).alias("other"), F.col(label).alias("_l"))
    j = near.join(theirs, [*cell, "other"]).join(df.select(*cell, key, label), [*cell, key])
    return j.groupBy(*cell).agg(F.count("*").alias("rows"), F.count_if(F.col("_l") == F.col(label)).alias("concordant"))


def risk_set(steps: DataFrame, onsets: DataFrame, ep: str, q: str, onset: str, horizon: int, through: bool = False) -> DataFrame:
    """Steps that are alive and not past their episode's event, with label: whether it comes within the horizon.

    Steps before the onset count, with label 1 <= onset - q <= horizon; through: the onset's own step counts too, with
    label 0 <= onset - q <= horizon. Episodes without an event are at risk throughout, with label false.
    """
    j = steps.join(onsets.select(ep, F.col(onset).alias("_onset")), ep, "left")
    left = F.col("_onset") - F.col(q)
    first = 0 if through else 1
    return j.where(F.col("_onset").isNull() | (left >= first)).withColumn("label", F.coalesce(left.between(first, horizon), F.lit(False))).drop("_onset")
