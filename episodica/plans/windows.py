"""Queries of the window operators over event episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import windows as W
from .common import BY, EV, S, events, over, r6, s6

X = "x"


def simple(name: str, column, sql: str, places: bool = True) -> None:
    """Register a query that adds one column to every step."""
    text = f"WITH {EV} SELECT ep, q, {s6(sql, 'y') if places else sql + ' AS y'} FROM ev"
    register(name, text)(lambda spark, d: events(spark, d).select("ep", "q", r6(column(), "y") if places else column().alias("y")))


def lag(k: int) -> str:
    return f"lag(x, {k}) {BY}"


simple("local_query", lambda: F.col("q") + 0, "q + 0", places=False)
simple("trailing_mean_complete", lambda: W.trailing_mean(S, X, 4), f"CASE WHEN count(x) {over(4)} = 4 THEN avg(x) {over(4)} END")
simple("trailing_mean_partial", lambda: W.trailing_mean(S, X, 8, complete=False), f"avg(x) {over(8)}")
simple("trailing_range", lambda: W.trailing_range(S, X, 4), f"CASE WHEN count(x) {over(4)} = 4 THEN max(x) {over(4)} - min(x) {over(4)} END")
simple("lag_delta", lambda: W.lag_delta(S, X, 3), f"x - {lag(3)}")
simple("query_velocity", lambda: W.difference(S, X, 1), f"x - {lag(1)}")
simple("query_acceleration", lambda: W.difference(S, X, 2), f"x - 2 * {lag(1)} + {lag(2)}")
simple("query_jerk", lambda: W.difference(S, X, 3), f"x - 3 * {lag(1)} + 3 * {lag(2)} - {lag(3)}")
simple("return_advantage", lambda: W.return_advantage(S, X), f"CASE WHEN {lag(4)} IS NOT NULL THEN abs(x - {lag(1)}) - least(abs(x - {lag(2)}), abs(x - {lag(3)}), abs(x - {lag(4)})) END")
simple("recurrence", lambda: W.recurrence(S, X, 50.0), "greatest(" + ", ".join(f"exp(-abs(x - {lag(k)}) / 50.0)" for k in (2, 3, 4)) + f") - exp(-abs(x - {lag(1)}) / 50.0)")
simple("running_max", lambda: W.running_max(S, X), f"max(x) {over()}")
simple("cumulative_mean", lambda: W.cumulative_mean(S, X), f"avg(x) {over()}")
simple("persistence_min", lambda: W.persistence(S, X, 3), f"CASE WHEN count(x) {over(3)} = 3 THEN min(x) {over(3)} END")
simple("k_of_n_persistence", lambda: W.k_of_n(S, X, 2, 3), f"CASE WHEN q - lag(q, 2) {BY} = 2 THEN x + {lag(1)} + {lag(2)} - greatest(x, {lag(1)}, {lag(2)}) - least(x, {lag(1)}, {lag(2)}) END")
simple("past_any", lambda: W.past_any(S, F.expr("x > 100"), 5), f"coalesce(max(CAST(x > 100 AS INTEGER)) {over(6, '1 PRECEDING')}, 0) = 1", places=False)
simple("consecutive_above", lambda: W.all_of_last(S, F.expr("x > 20"), 3), f"count(x) {over(3)} = 3 AND min(CAST(x > 20 AS INTEGER)) {over(3)} = 1", places=False)
simple("multiscale_scan", lambda: W.multiscale_scan(S, X), "greatest(" + ", ".join(f"sum(x) {over(w)} / sqrt(count(x) {over(w)})" for w in (1, 2, 4, 8)) + ")")
simple("trailing_slope", lambda: W.trailing_slope(S, X, 6), f"CASE WHEN count(x) {over(6)} > 1 THEN regr_slope(x, CAST(q AS DOUBLE)) {over(6)} END")
simple("adjacent_min", lambda: W.adjacent_min(S, X), f"CASE WHEN {lag(1)} IS NOT NULL THEN least(x, {lag(1)}) END")
simple("complete_mean", lambda: W.complete_mean(X, F.lag("x", 1).over(S.by), F.lag("x", 2).over(S.by)), f"(x + {lag(1)} + {lag(2)}) / 3")
simple("max_with_fallback", lambda: W.max_with_fallback(X, F.lag("x", 2).over(S.by)), f"greatest(x, coalesce({lag(2)}, x))")
simple("rank_within", lambda: W.rank_within("x", "ep"), "CASE WHEN count(*) OVER (PARTITION BY ep) > 1 THEN (rank() OVER (PARTITION BY ep ORDER BY x) + (count(*) OVER (PARTITION BY ep, x) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY ep) - 1) ELSE 0.5 END")
simple("signal_sign_lag_gate", lambda: F.signum(W.lag_delta(S, X, 1)), f"CAST(sign(x - {lag(1)}) AS DOUBLE)")


@register(
    "trailing_correlation",
    f"""WITH {EV}, y AS (SELECT *, {lag(1)} AS z FROM ev), w AS (SELECT ep, q, count(z) {over(4)} AS n, sum(x) {over(4)} AS sx, sum(z) {over(4)} AS sz,
    sum(x * x) {over(4)} AS sxx, sum(z * z) {over(4)} AS szz, sum(x * z) {over(4)} AS sxz FROM y)
    SELECT ep, q, {s6('CASE WHEN n = 4 AND 4 * sxx - sx * sx > 1e-9 AND 4 * szz - sz * sz > 1e-9 THEN (4 * sxz - sx * sz) / sqrt((4 * sxx - sx * sx) * (4 * szz - sz * sz)) ELSE 0 END', 'y')} FROM w""",
)
def trailing_correlation(spark, d):
    e = events(spark, d).withColumn("z", F.lag("x", 1).over(S.by))
    return e.select("ep", "q", r6(F.when(F.count("z").over(S.last(4)) == 4, W.trailing_correlation(S, "x", "z", 4)).otherwise(F.lit(0.0)), "y"))


RUN = f"{EV}, i AS (SELECT *, sum(CASE WHEN x > 20 THEN 0 ELSE 1 END) {over()} AS g FROM ev)"


@register("run_length", f"WITH {RUN} SELECT ep, q, CAST(least(sum(CASE WHEN x > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY ep, g ORDER BY q ROWS UNBOUNDED PRECEDING), 6) AS BIGINT) AS y FROM i")
def run_length(spark, d):
    return W.run_length(events(spark, d), S, F.expr("x > 20"), "y", cap=6).select("ep", "q", F.col("y").cast("long").alias("y"))


@register("run_segments", f"WITH {RUN} SELECT ep, min(q) AS start, max(q) AS stop, count(*) AS length FROM i WHERE x > 20 GROUP BY ep, g")
def run_segments(spark, d):
    return W.segments(events(spark, d), S, F.expr("x > 20"))


@register(
    "pulse_trains",
    f"""WITH {RUN}, r AS (SELECT ep, min(q) AS start, max(q) AS stop FROM i WHERE x > 20 GROUP BY ep, g),
    t AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY ep ORDER BY start) - 1 <= 2 THEN 0 ELSE 1 END AS n FROM r),
    u AS (SELECT *, sum(n) OVER (PARTITION BY ep ORDER BY start ROWS UNBOUNDED PRECEDING) AS tr FROM t)
    SELECT ep, min(start) AS first, max(stop) AS last, count(*) AS pulses FROM u GROUP BY ep, tr""",
)
def pulse_trains(spark, d):
    return W.trains(events(spark, d), S, F.expr("x > 20"), 2)


@register("cusum", f"WITH {EV}, c AS (SELECT ep, q, sum(x - 50) {over()} AS c FROM ev) SELECT ep, q, {s6('c - least(min(c) ' + over() + ', 0)', 'y')} FROM c")
def cusum(spark, d):
    return W.cusum(events(spark, d), S, "x", 50.0, "y").select("ep", "q", r6("y", "y"))


@register("ewma", f"WITH {EV} SELECT a.ep, a.q, {s6('sum(CASE WHEN b.q = 0 THEN power(0.6, a.q) ELSE 0.4 * power(0.6, a.q - b.q) END * b.x)', 'y')} FROM ev a JOIN ev b ON a.ep = b.ep AND b.q <= a.q GROUP BY a.ep, a.q")
def ewma(spark, d):
    return W.ewma(events(spark, d), S, "x", 0.4, "y").select("ep", "q", r6("y", "y"))


@register("ema_momentum", f"WITH {EV}, z AS (SELECT ep, q, coalesce(x - {lag(1)}, 0) AS v FROM ev) SELECT a.ep, a.q, {s6('sum(0.4 * power(0.6, a.q - b.q) * b.v)', 'y')} FROM z a JOIN z b ON a.ep = b.ep AND b.q <= a.q GROUP BY a.ep, a.q")
def ema_momentum(spark, d):
    return W.ema_momentum(events(spark, d), S, "x", 0.6, "y").select("ep", "q", r6("y", "y"))


@register("window_signature", f"WITH {EV} SELECT ep, q, {s6('x', 'now')}, {s6('avg(x) ' + over(5), 'mean')}, {s6('CASE WHEN q > 0 THEN regr_slope(x, CAST(q AS DOUBLE)) ' + over(5) + ' END', 'slope')} FROM ev")
def window_signature(spark, d):
    return events(spark, d).select("ep", "q", r6("x", "now"), r6(W.trailing_mean(S, X, 5, False), "mean"), r6(W.trailing_slope(S, X, 5), "slope"))


@register("dynamic_feature_stack", f"WITH {EV} SELECT ep, q, {s6(f'greatest(least(x - {lag(1)}, 12), -12)', 'd1')}, {s6(f'greatest(least(x - 2 * {lag(1)} + {lag(2)}, 12), -12)', 'd2')}, {s6(f'sqrt((power(x - {lag(1)}, 2) + power(x - {lag(2)}, 2) + power(x - {lag(3)}, 2)) / 3)', 'lag_rms')} FROM ev")
def dynamic_feature_stack(spark, d):
    clip = lambda c: F.greatest(F.least(c, F.lit(12.0)), F.lit(-12.0))
    at = [W.lag_delta(S, X, k) for k in (1, 2, 3)]
    two = W.difference(S, X, 2)
    rms = F.sqrt((at[0] * at[0] + at[1] * at[1] + at[2] * at[2]) / 3)
    return events(spark, d).select("ep", "q", r6(clip(at[0]), "d1"), r6(clip(two), "d2"), r6(rms, "lag_rms"))


@register("causal_design", f"WITH {EV} SELECT ep, q, {lag(1)} AS lag1, {lag(1)} IS NOT NULL AS has1, {lag(2)} AS lag2, {lag(2)} IS NOT NULL AS has2 FROM ev")
def causal_design(spark, d):
    return events(spark, d).select("ep", "q", *W.design(S, X, 2))


@register("percentile_vs_reference", f"WITH {EV} SELECT ep, q, k, {s6('(sum(CASE WHEN ep % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY x RANGE UNBOUNDED PRECEDING) + 0.5) / (sum(CASE WHEN ep % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k) + 1)', 'y')} FROM ev")
def percentile_vs_reference(spark, d):
    e = events(spark, d).withColumn("ref", F.col("ep") % 2 == 0)
    return W.midrank(e, "x", "ref", "y", "k").select("ep", "q", "k", r6("y", "y"))


SM = f"{EV}, sm AS (SELECT ep, q, k, x, CASE WHEN count(x) {over(4)} = 4 THEN avg(x) {over(4)} END AS m FROM ev)"


@register("first_crossing", f"WITH {SM} SELECT ep, coalesce(min(CASE WHEN m > 80 THEN q END), -1) AS first FROM sm GROUP BY ep")
def first_crossing(spark, d):
    return W.first_crossing(events(spark, d).withColumn("m", W.trailing_mean(S, X, 4)), S, "m", 80.0)


@register("combined_alarms", f"WITH {SM}, a AS (SELECT ep, coalesce(min(CASE WHEN m > 80 THEN q END), -1) AS a, coalesce(min(CASE WHEN x > 150 THEN q END), -1) AS b FROM sm GROUP BY ep) SELECT ep, CASE WHEN a >= 0 AND b >= 0 THEN greatest(a, b) ELSE -1 END AS both_first, CASE WHEN a < 0 THEN b WHEN b < 0 THEN a ELSE least(a, b) END AS either_first FROM a")
def combined_alarms(spark, d):
    e = events(spark, d).withColumn("m", W.trailing_mean(S, X, 4))
    a = W.first_crossing(e, S, "m", 80.0, "a").join(W.first_crossing(e, S, "x", 150.0, "b"), "ep")
    return a.select("ep", W.both_alarms("a", "b").alias("both_first"), W.either_alarm("a", "b").alias("either_first"))


@register("trajectory_peak", f"WITH {SM} SELECT ep, coalesce(max(m), CAST('-inf' AS DOUBLE)) AS peak FROM sm GROUP BY ep")
def trajectory_peak(spark, d):
    e = events(spark, d).withColumn("m", W.trailing_mean(S, X, 4))
    return W.peaks(e, S, "m")
