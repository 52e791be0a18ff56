"""Monitors replayed in batch: calibrate, alarm, measure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import stats as A
from ..operators import windows as W
from ..streaming import monitors as M
from .common import BY, EV, S, events, over, r6, s6

MON = M.Monitor(4, 2, 60.0)
SMOOTH = f"{EV}, sm AS (SELECT *, CASE WHEN count(x) {over(4)} = 4 THEN avg(x) {over(4)} END AS m FROM ev), ld AS (SELECT ep, bool_or(k = 'error' AND q >= 10) AS risk, count(*) AS n FROM ev GROUP BY ep)"
RUNS = f"{SMOOTH}, ri AS (SELECT *, sum(CASE WHEN coalesce(m > 60, false) THEN 0 ELSE 1 END) {over()} AS g FROM sm), rr AS (SELECT ep, q, m, sum(CASE WHEN coalesce(m > 60, false) THEN 1 ELSE 0 END) OVER (PARTITION BY ep, g ORDER BY q ROWS UNBOUNDED PRECEDING) AS run FROM ri)"


@register("monitor_replay", f"WITH {RUNS}, f AS (SELECT *, min(CASE WHEN run >= 2 THEN q END) {over()} AS f FROM rr) SELECT ep, q, {s6('m', 'smooth')}, CAST(run AS INTEGER) AS run, f IS NOT NULL AS alarm, coalesce(f, -1) AS first_alarm FROM f")
def monitor_replay(spark, d):
    return M.batch(events(spark, d), MON).select("ep", "q", r6("smooth", "smooth"), "run", "alarm", "first_alarm")


GUARD = f"""{EV}, a1 AS (SELECT *, abs(x - lag(x, 1) {BY}) AS v, abs(x - 2 * lag(x, 1) {BY} + lag(x, 2) {BY}) AS a, least(abs(x - lag(x, 2) {BY}), abs(x - lag(x, 3) {BY}), abs(x - lag(x, 4) {BY})) AS c FROM ev),
bs AS (SELECT ep, CASE WHEN count(v) FILTER (q >= 1 AND q < 7) = 6 THEN avg(v) FILTER (q >= 1 AND q < 7) END AS bv, CASE WHEN count(a) FILTER (q >= 2 AND q < 8) = 6 THEN median(a) FILTER (q >= 2 AND q < 8) END AS ba, CASE WHEN count(c) FILTER (q >= 4 AND q < 10) = 6 THEN median(c) FILTER (q >= 4 AND q < 10) END AS bc FROM a1 GROUP BY ep),
a2 AS (SELECT ep, q, -ln(greatest(v, 1e-6) / greatest(bv, 1e-6)) AS fr, ln(greatest(a, 1e-6) / greatest(ba, 1e-6)) AS ar, -(CASE WHEN q >= 4 THEN c END - bc) / 50.0 AS pr FROM a1 JOIN bs USING (ep)),
a3 AS (SELECT ep, q, CASE WHEN count(fr) {over(4)} = 4 THEN avg(fr) {over(4)} END AS fm, CASE WHEN count(ar) {over(4)} = 4 THEN avg(ar) {over(4)} END AS am, CASE WHEN count(pr) {over(3)} = 3 THEN avg(pr) {over(3)} END AS pm FROM a2),
a4 AS (SELECT ep, q, fm, CASE WHEN count(am) {over(2)} = 2 THEN min(am) {over(2)} END AS ap, CASE WHEN count(pm) {over(2)} = 2 THEN min(pm) {over(2)} END AS pp FROM a3),
pk AS (SELECT ep, max(fm) FILTER (q >= 7) AS sf, max(ap) FILTER (q >= 8) AS sa, max(pp) FILTER (q >= 10) AS sp FROM a4 GROUP BY ep),
th AS (SELECT {", ".join(f"list_sort(list({c}) FILTER ({c} IS NOT NULL))[CAST(ceil(0.9 * (count({c}) - 1) - 1e-9) AS BIGINT) + 1] AS t{c}" for c in ("sf", "sa", "sp"))} FROM pk WHERE ep % 2 = 0),
fi AS (SELECT ep, min(q) FILTER (q >= 7 AND fm > tsf) AS ff, min(q) FILTER (q >= 8 AND ap > tsa) AS fa, min(q) FILTER (q >= 10 AND pp > tsp) AS fp FROM a4, th GROUP BY ep),
al AS (SELECT ep, ff AS fs, CASE WHEN fa IS NOT NULL AND fp IS NOT NULL THEN greatest(fa, fp) END AS fh FROM fi)"""
HEADS = ("fm", "ap", "pp")


def _guard(spark, d):
    """First alarms of the freeze head and of the loop (acceleration and periodicity) of each episode.

    Every stream is measured against the episode's own early steps: movement as a log ratio to its mean, acceleration as
    one to its median, the distance to the nearest of two to four steps back as a difference from its median. Streams
    are smoothed, the two loop streams must persist, and thresholds are the conservative quantile of the peaks of even
    episodes. Nothing at a step looks past it.
    """
    e = events(spark, d)
    back = [F.abs(W.lag_delta(S, "x", k)) for k in (2, 3, 4)]
    e = e.withColumn("v", F.abs(W.difference(S, "x", 1))).withColumn("a", F.abs(W.difference(S, "x", 2))).withColumn("c", F.when(F.col("q") >= 4, F.least(*back)))
    ep = Window.partitionBy("ep")

    def early(x: str, start: int, count: int, reduce):
        own = F.when((F.col("q") >= start) & (F.col("q") < start + count), F.col(x))
        return F.when(F.count(own).over(ep) == count, reduce(own).over(ep))

    half = lambda x: F.percentile(x, F.lit(0.5))
    e = e.withColumn("bv", early("v", 1, 6, F.avg)).withColumn("ba", early("a", 2, 6, half)).withColumn("bc", early("c", 4, 6, half))
    ratio = lambda x, b: F.when(F.col(b).isNotNull(), F.ln(F.greatest(x, F.lit(1e-6)) / F.greatest(b, F.lit(1e-6))))
    e = e.withColumn("fr", F.when(F.col("v").isNotNull(), -ratio("v", "bv"))).withColumn("ar", F.when(F.col("a").isNotNull(), ratio("a", "ba"))).withColumn("pr", -(F.col("c") - F.col("bc")) / 50.0)
    e = e.withColumn("fm", W.trailing_mean(S, "fr", 4)).withColumn("am", W.trailing_mean(S, "ar", 4)).withColumn("pm", W.trailing_mean(S, "pr", 3))
    e = e.withColumn("ap", W.persistence(S, "am", 2)).withColumn("pp", W.persistence(S, "pm", 2))
    # no head speaks before its baseline is whole
    e = e.select("ep", "q", *[F.when(F.col("q") >= at, F.col(h)).alias(h) for h, at in zip(HEADS, (7, 8, 10))])
    peaks = e.where("ep % 2 = 0").groupBy("ep").agg(*[F.max(h).alias(h) for h in HEADS])
    tall = peaks.unpivot("ep", list(HEADS), "head", "peak")
    th = A.quantile_higher(tall, "peak", 0.9, "head", name="t")
    one = F.broadcast(th.agg(*[F.max(F.when(F.col("head") == h, F.col("t"))).alias(f"t_{h}") for h in HEADS]))  # one row of three thresholds
    first = e.crossJoin(one).groupBy("ep").agg(*[F.min(F.when(F.col(h) > F.col(f"t_{h}"), F.col("q"))).alias(h) for h in HEADS])
    return first.select("ep", F.col("fm").alias("fs"), F.when(F.col("ap").isNotNull() & F.col("pp").isNotNull(), F.greatest("ap", "pp")).alias("fh"))


@register("intrinsic_guard", f"WITH {GUARD} SELECT ep, coalesce(fs, -1) AS freeze_first, coalesce(fh, -1) AS loop_first, coalesce(least(coalesce(fs, fh), coalesce(fh, fs)), -1) AS first_alarm FROM al")
def intrinsic_guard(spark, d):
    a = _guard(spark, d).select("ep", F.coalesce("fs", F.lit(-1)).alias("freeze_first"), F.coalesce("fh", F.lit(-1)).alias("loop_first"))
    return a.withColumn("first_alarm", W.either_alarm("freeze_first", "loop_first"))


@register("guard_metrics", f"WITH {GUARD}, lb AS (SELECT ep, bool_or(k = 'error' AND q >= 10) AS r FROM ev GROUP BY ep), j AS (SELECT ep % 3 AS suite, (fs IS NOT NULL OR fh IS NOT NULL) AS a, r FROM al JOIN lb USING (ep)), c AS (SELECT suite, count(*) FILTER (a AND r) AS tp, count(*) FILTER (a AND NOT r) AS fp, count(*) FILTER (NOT a AND r) AS fn, count(*) FILTER (NOT a AND NOT r) AS tn FROM j GROUP BY suite) SELECT suite, tp, fp, fn, tn, {s6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END', 'recall')}, {s6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END', 'precision')}, {s6('CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END', 'fpr')} FROM c")
def guard_metrics(spark, d):
    labels = events(spark, d).groupBy("ep").agg(F.bool_or((F.col("k") == "error") & (F.col("q") >= 10)).alias("r"))
    j = _guard(spark, d).join(labels, "ep").withColumn("a", F.col("fs").isNotNull() | F.col("fh").isNotNull()).withColumn("suite", F.col("ep") % 3)
    return A.confusion(j, F.col("a"), F.col("r"), "suite").select("suite", "tp", "fp", "fn", "tn", r6("recall", "recall"), r6("precision", "precision"), r6("fpr", "fpr"))


@register("range_regimes", f"WITH {EV}, z AS (SELECT ep, q, CASE WHEN count(x) {over(4)} = 4 THEN max(x) {over(4)} - min(x) {over(4)} END AS rg FROM ev), w AS (SELECT ep, q, rg, CASE WHEN count(rg) {over(3)} = 3 THEN max(rg) {over(3)} END AS hi, CASE WHEN count(rg) {over(2)} = 2 THEN min(rg) {over(2)} END AS lo FROM z) SELECT ep, coalesce(min(q) FILTER (hi < 30), -1) AS lock_first, coalesce(min(q) FILTER (lo > 150), -1) AS unstable_first, coalesce(min(q) FILTER (hi < 30 OR lo > 150), -1) AS first_alarm FROM w GROUP BY ep")
def range_regimes(spark, d):
    """Alarms of two regimes of one scalar, either of which opens: locked (the trailing range stays low for three steps) or unstable (it stays high for two)."""
    e = events(spark, d).withColumn("rg", F.when(F.count("x").over(S.last(4)) == 4, W.trailing_range(S, "x", 4)))
    lock, unstable = -W.persistence(S, -F.col("rg"), 3) < 30, W.persistence(S, "rg", 2) > 150
    e = e.select("ep", "q", lock.alias("lock"), unstable.alias("unstable"))
    first = lambda c, name: F.coalesce(F.min(F.when(c, F.col("q"))), F.lit(-1)).alias(name)
    return e.groupBy("ep").agg(first(F.col("lock"), "lock_first"), first(F.col("unstable"), "unstable_first"), first(F.col("lock") | F.col("unstable"), "first_alarm"))


@register("acceleration_spikes", f"WITH {EV}, z AS (SELECT ep, q, abs(x - 2 * lag(x, 1) {BY} + lag(x, 2) {BY}) AS a FROM ev), b AS (SELECT *, avg(a) OVER (PARTITION BY ep ORDER BY q ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS b, count(a) OVER (PARTITION BY ep ORDER BY q ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS n FROM z) SELECT ep, coalesce(min(q) FILTER (n = 8 AND a > 2 * b), -1) AS first FROM b GROUP BY ep")
def acceleration_spikes(spark, d):
    """First step whose acceleration is over twice the mean of the eight before it."""
    e = events(spark, d).withColumn("a", F.abs(W.difference(S, "x", 2)))
    before = S.by.rowsBetween(-8, -1)
    e = e.withColumn("b", F.avg("a").over(before)).withColumn("n", F.count("a").over(before))
    return e.groupBy("ep").agg(F.coalesce(F.min(F.when((F.col("n") == 8) & (F.col("a") > 2 * F.col("b")), F.col("q"))), F.lit(-1)).alias("first"))


@register("standardised_guard", f"WITH {EV}, t AS (SELECT k, avg(x) AS mu, stddev_samp(x) AS sd FROM ev WHERE ep % 2 = 0 GROUP BY k), z AS (SELECT ep, q, (x - mu) / greatest(sd, 1e-9) AS z FROM ev JOIN t USING (k)), m AS (SELECT ep, q, CASE WHEN count(z) {over(4)} = 4 THEN avg(z) {over(4)} END AS m FROM z) SELECT ep, coalesce(min(q) FILTER (m > 0.8), -1) AS first FROM m GROUP BY ep")
def standardised_guard(spark, d):
    """First alarm of a score that is standardised by the mean and spread of known episodes (see cold_start_monitor for tasks without a profile)."""
    e = events(spark, d)
    t = e.where("ep % 2 = 0").groupBy("k").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
    z = e.join(t, "k").withColumn("z", (F.col("x") - F.col("mu")) / F.greatest("sd", F.lit(1e-9)))
    return W.first_crossing(z.withColumn("m", W.trailing_mean(S, "z", 4)), S, "m", 0.8)


@register("precision_cascade", f"WITH {SMOOTH}, c AS (SELECT ep, min(q) FILTER (m > 60) AS wide FROM sm GROUP BY ep), n AS (SELECT sm.ep, min(q) FILTER (x > 120 AND q >= wide AND q <= wide + 6) AS narrow FROM sm JOIN c USING (ep) GROUP BY sm.ep) SELECT ep, coalesce(wide, -1) AS wide_first, coalesce(narrow, -1) AS confirmed_first FROM c JOIN n USING (ep)")
def precision_cascade(spark, d):
    """A wide first stage opens a window of seven steps in which a narrow second stage must confirm."""
    e = events(spark, d).withColumn("m", W.trailing_mean(S, "x", 4))
    e = e.withColumn("wide", F.min(F.when(F.col("m") > 60, F.col("q"))).over(Window.partitionBy("ep")))
    confirmed = (F.col("x") > 120) & F.col("q").between(F.col("wide"), F.col("wide") + 6)
    return e.groupBy("ep").agg(F.coalesce(F.min("wide"), F.lit(-1)).alias("wide_first"), F.coalesce(F.min(F.when(confirmed, F.col("q"))), F.lit(-1)).alias("confirmed_first"))


@register("self_reference_ratio", f"WITH {EV}, b AS (SELECT ep, median(x) FILTER (q < 6) AS b FROM ev GROUP BY ep), r AS (SELECT ep, q, avg(x) {over(3)} / greatest(b, 1e-9) AS r FROM ev JOIN b USING (ep)) SELECT ep, coalesce(min(q) FILTER (q >= 6 AND r < 0.4), -1) AS collapse FROM r GROUP BY ep")
def self_reference_ratio(spark, d):
    e = events(spark, d)
    base = F.percentile(F.when(F.col("q") < 6, F.col("x")), F.lit(0.5)).over(Window.partitionBy("ep"))
    r = e.withColumn("r", W.trailing_mean(S, "x", 3, complete=False) / F.greatest(base, F.lit(1e-9)))
    return r.groupBy("ep").agg(F.coalesce(F.min(F.when((F.col("q") >= 6) & (F.col("r") < 0.4), F.col("q"))), F.lit(-1)).alias("collapse"))


@register("route_derivative_monitor", f"WITH {EV}, z AS (SELECT ep, q, x, x - lag(x) {BY} AS v FROM ev), p AS (SELECT ep, q, (sum(CASE WHEN ep % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY x RANGE UNBOUNDED PRECEDING) + 0.5) / (sum(CASE WHEN ep % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q) + 1) AS a, (sum(CASE WHEN ep % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY v RANGE UNBOUNDED PRECEDING) + 0.5) / (sum(CASE WHEN ep % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q) + 1) AS b FROM z WHERE v IS NOT NULL) SELECT ep, q, {s6('greatest(a, b)', 'fused')} FROM p")
def route_derivative_monitor(spark, d):
    e = events(spark, d).withColumn("v", W.lag_delta(S, "x", 1)).where("v is not null").withColumn("ref", F.col("ep") % 2 == 0)
    e = W.midrank(W.midrank(e, "x", "ref", "a", "q"), "v", "ref", "b", "q")
    return e.select("ep", "q", r6(F.greatest("a", "b"), "fused"))


@register("timing_metrics", f"WITH {RUNS}, f AS (SELECT ep, min(q) FILTER (run >= 2) AS f FROM rr GROUP BY ep), o AS (SELECT ep, min(q) AS onset FROM ev WHERE x > 200 GROUP BY ep) SELECT count(*) AS events, count(f) AS fired, {s6('quantile_cont(onset - f, 0.25)', 'q25')}, {s6('quantile_cont(onset - f, 0.5)', 'q50')}, {s6('quantile_cont(onset - f, 0.75)', 'q75')} FROM o LEFT JOIN f USING (ep)")
def timing_metrics(spark, d):
    e = events(spark, d)
    f = M.batch(e, MON).groupBy("ep").agg(F.min(F.when(F.col("run") >= 2, F.col("q"))).alias("f"))
    j = e.where("x > 200").groupBy("ep").agg(F.min("q").alias("onset")).join(f, "ep", "left").withColumn("lead", F.col("onset") - F.col("f"))
    return j.agg(F.count("*").alias("events"), F.count("f").alias("fired"), *[r6(F.percentile("lead", F.lit(q)), f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


@register("tumbling_windows", f"SELECT date_trunc('day', ts) AS start, event_type AS k, count(*) AS n, {s6('avg(value)', 'mean')} FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    return M.windowed_counts(events(spark, d)).select("start", "k", "n", r6("mean", "mean"))


@register("session_windows", f"WITH {EV}, s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ep ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM ev), g AS (SELECT *, sum(b) OVER (PARTITION BY ep ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT ep, min(ts) AS start, count(*) AS n FROM g GROUP BY ep, g")
def session_windows(spark, d):
    return M.session_counts(events(spark, d))
