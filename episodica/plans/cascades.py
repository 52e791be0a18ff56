"""Queries of the cascades over users' events: users fall into three tasks, even users are the healthy reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import cascade as C
from ..operators import stats as A
from ..operators import windows as W
from .common import BY, EV, S, events, over, r6, s6

LEAST, QUANTILE = 5, 0.3
FEATURES = ["x", "v", "a", "rg"]
#: Heads and the signs of their members among value, change, change of change and trailing range.
HEADS = {"instability": [("v", 1), ("a", 1)], "lock_in": [("v", -1), ("rg", -1)], "flat_narrow_support": [("x", -1), ("rg", -1)], "feedback_decoupling": [("x", 1), ("a", -1)]}


def observed(spark, d):
    e = events(spark, d)
    return e.select("ep", "q", (F.col("ep") % 3).alias("task"), "x", F.abs(W.difference(S, "x", 1)).alias("v"), F.abs(W.difference(S, "x", 2)).alias("a"), W.trailing_range(S, "x", 4).alias("rg"))


def member_sql(f: str, sign: int) -> str:
    return f"r_{f}" if sign > 0 else f"(1 - r_{f})"


def rank_sql(f: str) -> str:
    n = f"count({f}) FILTER (ep % 2 = 0) OVER (PARTITION BY task, q)"
    upto = f"count({f}) FILTER (ep % 2 = 0) OVER (PARTITION BY task, q ORDER BY {f} RANGE UNBOUNDED PRECEDING)"
    own = f"count({f}) FILTER (ep % 2 = 0) OVER (PARTITION BY task, q, {f})"
    return f"CASE WHEN {f} IS NOT NULL AND {n} >= {LEAST} THEN (2 * {upto} - {own}) / (2.0 * {n}) END AS r_{f}"


def last_sql(c: str, n: int) -> str:
    return f"(count(*) {over(n)} = {n} AND bool_and({c}) {over(n)})"


HEADED = f"""{EV}, ob AS (SELECT ep, q, ep % 3 AS task, x, abs(x - lag(x) {BY}) AS v, abs(x - 2 * lag(x) {BY} + lag(x, 2) {BY}) AS a, CASE WHEN count(x) {over(4)} = 4 THEN max(x) {over(4)} - min(x) {over(4)} END AS rg FROM ev),
rk AS (SELECT *, {', '.join(map(rank_sql, FEATURES))} FROM ob),
h0 AS (SELECT *, {', '.join(f"({' + '.join(member_sql(*m) for m in ms)}) / {len(ms)} AS i_{h}" for h, ms in HEADS.items())} FROM rk),
h1 AS (SELECT *, {', '.join(f'CASE WHEN count(i_{h}) {over(3)} = 3 THEN avg(i_{h}) {over(3)} END AS {h}' for h in HEADS)}, CASE WHEN count(v) {over(4)} = 4 THEN -avg(v) {over(4)} END AS score FROM h0)"""


def headed(spark, d):
    rows = C.reference_ranks(observed(spark, d), S, FEATURES, ["task", "q"], F.col("ep") % 2 == 0, LEAST)
    return C.with_heads(rows, S, HEADS)


@register("route_head_ranks", f"WITH {HEADED} SELECT ep, q, {', '.join(s6(h, h) for h in HEADS)} FROM h1")
def route_head_ranks(spark, d):
    """Heads from same-step reference ranks, smoothed."""
    return headed(spark, d).select("ep", "q", *[r6(h, h) for h in HEADS])


@register(
    "shared_threshold_cascade",
    f"""WITH {HEADED}, pk AS (SELECT task, ep, max(score) AS m FROM h1 WHERE ep % 2 = 0 GROUP BY ALL),
    th AS (SELECT task, list_sort(list(m) FILTER (m IS NOT NULL))[CAST(ceil({QUANTILE} * (count(m) - 1) - 1e-9) AS BIGINT) + 1] AS t FROM pk GROUP BY task),
    g0 AS (SELECT h1.*, coalesce(instability > 0.8, false) AS hi, coalesce(lock_in IS NOT NULL AND flat_narrow_support IS NOT NULL AND greatest(lock_in, flat_narrow_support) > 0.8, false) AS hs, coalesce(feedback_decoupling > 0.8, false) AS hf, coalesce(score > t, false) AS low FROM h1 JOIN th USING (task)),
    g1 AS (SELECT *, coalesce(bool_or(hi) OVER (PARTITION BY ep ORDER BY q ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), false) AS loop, {last_sql('hs', 2)} AS static, {last_sql('hf', 2)} AS feedback, (q - coalesce(max(CASE WHEN NOT low THEN q END) {over()}, -1))::INTEGER AS low_run FROM g0),
    g2 AS (SELECT *, {', '.join(f'coalesce(min(CASE WHEN {c} THEN q END) {over()}, -1) AS {n}' for n, c in (('first_warning', 'low_run >= 2'), ('first_alarm', 'low_run >= 4'), ('first_typed', 'low_run >= 4 AND (loop OR static OR feedback)')))} FROM g1)
    SELECT ep, q, {s6('score', 'score')}, low_run, CASE WHEN first_alarm >= 0 THEN 'alarm' WHEN first_warning >= 0 THEN 'warning' WHEN low_run > 0 THEN 'suspect' ELSE 'normal' END AS state, first_warning, first_alarm, first_typed, CASE WHEN static THEN 'static' WHEN loop THEN 'loop' WHEN feedback THEN 'feedback' ELSE 'untyped' END AS phenotype FROM g2""",
)
def shared_threshold_cascade(spark, d):
    """One threshold of a task for suspect steps, warnings and alarms; the typed alarm needs a gate as well."""
    rows = C.with_gates(headed(spark, d), S)
    peaks = observed(spark, d).where("ep % 2 = 0").withColumn("m", -W.trailing_mean(S, "v", C.WIDTH)).groupBy("task", "ep").agg(F.max("m").alias("m"))
    limits = A.quantile_higher(peaks, "m", QUANTILE, "task", name="t").select("task", "t")
    out = C.cascade(rows.join(limits, "task"), S, "v", "t")
    return out.select("ep", "q", r6("score", "score"), F.col("low_run").cast("int").alias("low_run"), "state", "first_warning", "first_alarm", "first_typed", "phenotype")
