"""Queries of joins, aggregations, resampling, selection and set operators."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalars as L
from ..operators import joins as J
from ..operators import resample as R
from ..operators import select as T
from ..operators import sequence as G
from ..operators import stats as A
from ..operators import windows as W
from ..sources import io
from .common import BY, EV, S, embeddings, events, over, r6, s6, table

# ---- joins -------------------------------------------------------------------------------------------------------


@register("validated_join", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def validated_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return J.validated_join(o, c, ["c_custkey"], validate="many_to_one")


@register("key_set_audit", "SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (b AND NOT a) AS right_only FROM (SELECT coalesce(c.k IS NOT NULL, false) AS a, coalesce(o.k IS NOT NULL, false) AS b FROM (SELECT DISTINCT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k)")
def key_set_audit(spark, d):
    return J.key_audit(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@register("left_join_suffixed", "SELECT c.c_custkey, c.c_acctbal AS bal_a, s.s_acctbal AS bal_b FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey")
def left_join_suffixed(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("bal_a"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("bal_b"))
    return c.join(s, "c_custkey", "left")


@register("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


ONSET = f"{EV}, sm AS (SELECT *, avg(x) {over(4)} AS m FROM ev), on_ AS (SELECT ep, min(q) AS onset FROM ev WHERE x > 200 GROUP BY ep)"


def _smoothed(spark, d):
    return events(spark, d).withColumn("m", W.trailing_mean(S, "x", 4, complete=False))


def _onsets(spark, d):
    return events(spark, d).where("x > 200").groupBy("ep").agg(F.min("q").alias("onset"))


@register("lead_grid", f"WITH {ONSET} SELECT o.ep, l AS lead, o.onset + l AS q, {s6('m', 'm')} FROM on_ o, (SELECT unnest([-4, -2, -1, 0]) AS l) g JOIN sm ON sm.ep = o.ep AND sm.q = o.onset + l")
def lead_grid(spark, d):
    g = J.lead_grid(_onsets(spark, d), "onset", [-4, -2, -1, 0])
    return g.join(_smoothed(spark, d).select("ep", "q", "m"), ["ep", "q"]).select("ep", "lead", "q", r6("m", "m"))


MATCH = f"""{ONSET}, c AS (SELECT o.ep AS event, o.ep % 5 AS scene, sm.q, sm.m AS cs FROM on_ o JOIN sm ON sm.ep = o.ep AND sm.q = o.onset - 2),
p AS (SELECT sm.ep % 5 AS scene, q, m FROM sm WHERE ep NOT IN (SELECT ep FROM on_))"""


def _matched(spark, d):
    sm = _smoothed(spark, d).withColumn("scene", F.col("ep") % 5)
    on = _onsets(spark, d)
    cases = on.withColumn("q", F.col("onset") - 2).join(sm, ["ep", "q"]).withColumn("event", F.col("ep"))
    return J.matched_controls(cases, sm.join(on, "ep", "left_anti"), ["scene"], "q", "event", "m")


@register("matched_controls", f"WITH {MATCH} SELECT event, q, count(*) AS controls, {s6('max(m)', 'best')} FROM c JOIN p USING (scene, q) GROUP BY event, q")
def matched_controls(spark, d):
    return _matched(spark, d).groupBy("event", "q").agg(F.sum("controls").alias("controls"), r6(F.max("best"), "best"))


@register("event_mean_auc", f"WITH {MATCH}, w AS (SELECT event, avg(CASE WHEN cs > m THEN 1.0 WHEN cs = m THEN 0.5 ELSE 0.0 END) AS w FROM c JOIN p USING (scene, q) GROUP BY event) SELECT {s6('avg(w)', 'auc')}, count(*) AS events FROM w")
def event_mean_auc(spark, d):
    return J.event_mean_auc(_matched(spark, d), "event").select(r6("auc", "auc"), "events")


@register("asof_join", "SELECT a.event_id, b.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_join(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"), F.col("event_id").alias("rid"))
    return J.asof_join(left, right, ["user_id"], "ts", "last_purchase", ["rid"]).select("event_id", "last_purchase")


@register("theta_self_join", f"WITH {EV} SELECT a.ep, min(b.q) AS first_return FROM ev a JOIN ev b ON a.ep = b.ep AND a.q <= b.q - 3 AND abs(a.x - b.x) <= 0.5 GROUP BY a.ep")
def theta_self_join(spark, d):
    return J.first_return(events(spark, d), "ep", "q", "x", 0.5, 3)


@register("leave_one_group_out", f"WITH {EV} SELECT k, f AS fold, {s6('(sum(s) OVER (PARTITION BY k) - s) / (sum(n) OVER (PARTITION BY k) - n)', 'other_mean')}, CAST(sum(n) OVER (PARTITION BY k) - n AS BIGINT) AS other_n FROM (SELECT k, ep % 4 AS f, sum(x) AS s, count(*) AS n FROM ev GROUP BY ALL)")
def leave_one_group_out(spark, d):
    return J.leave_one_out(events(spark, d).withColumn("fold", F.col("ep") % 4), ["k"], "fold", "x").select("k", "fold", r6("other_mean_x", "other_mean"), "other_n")


@register("fallback_statistics", f"WITH {EV}, c AS (SELECT k, ep, avg(x) AS c, count(x) AS n FROM ev GROUP BY ALL), t AS (SELECT k, avg(x) AS t FROM ev GROUP BY k) SELECT k, ep, CASE WHEN n >= 8 THEN 'cell' ELSE 'task' END AS level, {s6('CASE WHEN n >= 8 THEN c ELSE t END', 'stat')} FROM c JOIN t USING (k)")
def fallback_statistics(spark, d):
    return J.with_fallback(events(spark, d), "x", ["ep"], ["k"], 8, F.avg).select("k", "ep", "level", r6("stat", "stat"))


@register("knn_join", f"WITH {EV}, z AS (SELECT a.ep, a.q, b.ep AS other, row_number() OVER (PARTITION BY a.ep, a.q ORDER BY abs(a.x - b.x), b.ep) AS r FROM ev a JOIN ev b ON a.q = b.q AND a.ep <> b.ep AND a.ep % 3 = b.ep % 3) SELECT ep, q, other, r AS rank FROM z WHERE r <= 3")
def knn_join(spark, d):
    return J.nearest_in_order(events(spark, d).withColumn("g", F.col("ep") % 3), ["g", "q"], "ep", "x", 3).select("ep", "q", "other", "rank")


@register("nn_concordance", "WITH c AS (SELECT c_custkey AS i, c_nationkey AS cell, c_acctbal AS x, c_mktsegment = 'BUILDING' AS f FROM customer), z AS (SELECT a.cell, a.f, b.f AS g FROM c a JOIN c b ON a.cell = b.cell AND a.i <> b.i QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY abs(a.x - b.x), b.i) = 1) SELECT cell, count(*) AS rows, count(*) FILTER (f = g) AS concordant FROM z GROUP BY cell")
def nn_concordance(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_nationkey").alias("cell"), F.col("c_acctbal").alias("x"), (F.col("c_mktsegment") == "BUILDING").alias("f"))
    return J.nn_concordance(c, ["cell"], "i", "x", "f")


@register("risk_set", f"WITH {EV}, o AS (SELECT ep, min(q) AS o FROM ev WHERE x > 200 GROUP BY ep) SELECT q, count(*) AS at_risk, count(*) FILTER (o - q BETWEEN 1 AND 5) AS within FROM ev LEFT JOIN o USING (ep) WHERE o IS NULL OR q < o GROUP BY q")
def risk_set(spark, d):
    """Episodes alive and before their event at each step, and those whose event comes within five steps."""
    r = J.risk_set(events(spark, d), _onsets(spark, d), "ep", "q", "onset", 5)
    return r.groupBy("q").agg(F.count("*").alias("at_risk"), F.count_if("label").alias("within"))


@register("same_seed_replay", "SELECT a.o_custkey AS k, count(*) AS pairs, round(max(abs(a.o_totalprice - b.o_totalprice)) + 1e-9, 6) + 0.0 AS widest FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' GROUP BY a.o_custkey")
def same_seed_replay(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", "o_totalprice")
    return J.paired_extremes(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "k", "o_totalprice").select("k", "pairs", r6("widest", "widest"))


# ---- aggregation -------------------------------------------------------------------------------------------------


@register("value_counts", "SELECT event_type AS k, count(*) AS n, round(count(*) / sum(count(*)) OVER () + 1e-9, 6) + 0.0 AS share FROM events GROUP BY event_type")
def value_counts(spark, d):
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"))
    return c.select("k", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), "share"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@register("pivot_counts", "SELECT user_id AS ep, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def pivot_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("ep")).pivot("event_type", KINDS).count().na.fill(0)


CONF = """al AS (SELECT o_custkey, o_totalprice > 100000 AS a, o_orderstatus = 'F' AS r, o_orderpriority AS g FROM orders)"""
RATES = ", ".join(s6(f"CASE WHEN {b} > 0 THEN {a} / ({b}) END", n) for n, a, b in (("recall", "tp", "tp + fn"), ("precision", "tp", "tp + fp"), ("fpr", "fp", "fp + tn")))
COUNTS = "count(*) FILTER (a AND r) AS tp, count(*) FILTER (a AND NOT r) AS fp, count(*) FILTER (NOT a AND r) AS fn, count(*) FILTER (NOT a AND NOT r) AS tn"


def _alarms(spark, d):
    return table(spark, d, "orders").select((F.col("o_totalprice") > 100000).alias("a"), (F.col("o_orderstatus") == "F").alias("r"), F.col("o_orderpriority").alias("g"), F.col("o_custkey"))


def _rates(df, *keys):
    return df.select(*keys, "tp", "fp", "fn", "tn", r6("recall", "recall"), r6("precision", "precision"), r6("fpr", "fpr"))


@register("confusion_metrics", f"WITH {CONF}, c AS (SELECT g, {COUNTS} FROM al GROUP BY g) SELECT g, tp, fp, fn, tn, {RATES} FROM c")
def confusion_metrics(spark, d):
    return _rates(A.confusion(_alarms(spark, d), F.col("a"), F.col("r"), "g"), "g")


@register("multi_level_rollup", f"WITH {CONF}, c AS (SELECT g, h, grouping(g, h) AS level, {COUNTS} FROM (SELECT a, r, g, o_custkey % 3 AS h FROM al) GROUP BY GROUPING SETS ((), (g), (g, h))) SELECT g, h, level, tp, fp, fn, tn, {RATES} FROM c")
def multi_level_rollup(spark, d):
    a = _alarms(spark, d).withColumn("h", F.col("o_custkey") % 3)
    a.createOrReplaceTempView("_alarms_rollup")
    c = spark.sql("SELECT g, h, grouping_id(g, h) AS level, count_if(a and r) AS tp, count_if(a and not r) AS fp, count_if(not a and r) AS fn, count_if(not a and not r) AS tn FROM _alarms_rollup GROUP BY GROUPING SETS ((), (g), (g, h))")
    return _rates(A.rates(c), "g", "h", F.col("level").cast("long").alias("level"))


def auc_sql(x: str, y: str, src: str, group: str = "") -> str:
    p = f"PARTITION BY {group}" if group else ""
    pv = f"PARTITION BY {group}, {x}" if group else f"PARTITION BY {x}"
    return f"r AS (SELECT {group + ',' if group else ''} {y} AS y, rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({pv}) - 1) / 2.0 AS r FROM {src}), u AS (SELECT {group + ',' if group else ''} sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0 AS u, count(*) FILTER (y = 1) AS np, count(*) FILTER (y <> 1) AS nn FROM r {'GROUP BY ' + group if group else ''})"


LAB = "lb AS (SELECT quality, toxic, n_chars, source FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id")


@register("pairwise_auc", f"WITH {LAB}, {auc_sql('n_chars', 'quality', 'lb')} SELECT {s6('u / (np * nn)', 'auc')}, np AS n_pos, nn AS n_neg FROM u")
def pairwise_auc(spark, d):
    return A.auc(_labelled(spark, d), "n_chars", "quality").select(r6("auc", "auc"), "n_pos", "n_neg")


@register("stratified_auc", f"WITH {LAB}, {auc_sql('n_chars', 'quality', 'lb', 'source')} SELECT {s6('sum(u) / sum(np * nn)', 'auc')}, count(*) AS groups FROM u WHERE np > 0 AND nn > 0")
def stratified_auc(spark, d):
    return A.stratified_auc(_labelled(spark, d), "n_chars", "quality", "source").select(r6("auc", "auc"), "groups")


@register("group_auc_matrix", f"WITH {LAB}, lg AS (SELECT n_chars, unnest(['quality', 'toxic']) AS label, unnest([quality, toxic]) AS y FROM lb), {auc_sql('n_chars', 'y', 'lg', 'label')} SELECT label, {s6('u / (np * nn)', 'auc')} FROM u WHERE np > 0 AND nn > 0")
def group_auc_matrix(spark, d):
    long = _labelled(spark, d).unpivot(["n_chars"], ["quality", "toxic"], "label", "y")
    return A.value_counts_auc(long, "n_chars", "y", "label").select("label", r6(F.col("u") / (F.col("n_pos") * F.col("n_neg")), "auc"))


@register("quantile_higher", "SELECT event_type AS k, list_sort(list(value))[CAST(ceil(0.9 * (count(*) - 1) - 1e-9) AS BIGINT) + 1] AS threshold, count(*) AS n FROM events GROUP BY event_type")
def quantile_higher(spark, d):
    return A.quantile_higher(table(spark, d, "events").select(F.col("event_type").alias("k"), "value"), "value", 0.9, "k").select("k", "threshold", F.col("n").cast("long").alias("n"))


@register("linear_quantiles", "SELECT event_type AS k, " + ", ".join(s6(f"quantile_cont(value, {q})", f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)) + " FROM events GROUP BY event_type")
def linear_quantiles(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("k")).agg(*[r6(F.percentile("value", F.lit(q)), f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)])


@register("median_mad", f"WITH m AS (SELECT event_type AS k, value, median(value) OVER (PARTITION BY event_type) AS m FROM events) SELECT k, {s6('any_value(m)', 'median')}, {s6('median(abs(value - m))', 'mad')} FROM m GROUP BY k")
def median_mad(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("k"), "value")
    m = e.groupBy("k").agg(F.median("value").alias("m"))
    return e.join(m, "k").groupBy("k").agg(r6(F.first("m"), "median"), r6(F.median(F.abs(F.col("value") - F.col("m"))), "mad"))


@register("robust_scaling", f"WITH s AS (SELECT event_type AS k, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS i FROM events GROUP BY event_type) SELECT event_id, {s6('greatest(least((value - m) / greatest(i, 1e-9), 8), -8)', 'z')} FROM events JOIN s ON event_type = k")
def robust_scaling(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("k"), "value")
    s = e.groupBy("k").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    z = (F.col("value") - F.col("p")[1]) / F.greatest(F.col("p")[2] - F.col("p")[0], F.lit(1e-9))
    return e.join(s, "k").select("event_id", r6(L.clipped(z, -8.0, 8.0), "z"))


@register("self_baseline", f"WITH {EV}, b AS (SELECT ep, median(x) FILTER (q < 5) AS b FROM ev GROUP BY ep) SELECT ep, q, {s6('x / greatest(abs(b), 1e-5)', 'ratio')} FROM ev JOIN b USING (ep)")
def self_baseline(spark, d):
    e = events(spark, d)
    b = F.percentile(F.when(F.col("q") < 5, F.col("x")), F.lit(0.5)).over(Window.partitionBy("ep"))
    return e.select("ep", "q", r6(F.col("x") / F.greatest(F.abs(b), F.lit(1e-5)), "ratio"))


@register("conformal_threshold", f"WITH {EV}, m AS (SELECT ep % 4 AS f, ep, max(x) AS m FROM ev GROUP BY ALL) SELECT f, coalesce(list_sort(list(m))[CAST(ceil((count(*) + 1) * 0.9 - 1e-9) AS BIGINT)], CAST('inf' AS DOUBLE)) AS threshold FROM m GROUP BY f")
def conformal_threshold(spark, d):
    m = events(spark, d).groupBy((F.col("ep") % 4).alias("f"), "ep").agg(F.max("x").alias("m"))
    return A.conformal_threshold(m, "m", 0.1, "f")


@register("budgeted_threshold", "WITH a AS (SELECT event_type AS k, value, count(*) OVER (PARTITION BY event_type ORDER BY value DESC) / count(*) OVER (PARTITION BY event_type) AS s FROM events) SELECT k, min(value) FILTER (s <= 0.05) AS threshold FROM a GROUP BY k")
def budgeted_threshold(spark, d):
    return A.budgeted_threshold(table(spark, d, "events").select(F.col("event_type").alias("k"), "value"), "value", 0.05, "k")


@register("episode_cluster_maxima", f"WITH {EV}, m AS (SELECT ep % 5 AS scene, ep, max(x) AS m FROM ev GROUP BY ALL) SELECT scene, max(m) AS top, {s6('avg(m)', 'mean_top')} FROM m GROUP BY scene")
def episode_cluster_maxima(spark, d):
    m = events(spark, d).groupBy((F.col("ep") % 5).alias("scene"), "ep").agg(F.max("x").alias("m"))
    return m.groupBy("scene").agg(F.max("m").alias("top"), r6(F.avg("m"), "mean_top"))


Z = 1.959963984540054
WIL = f"((k / n + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n))"
HALF = f"({Z} * sqrt((k / n) * (1 - k / n) / n + {Z * Z} / (4.0 * n * n)) / (1 + {Z * Z} / n))"


@register("wilson_interval", f"WITH c AS (SELECT source, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, {s6(f'greatest({WIL} - {HALF}, 0)', 'lo')}, {s6(f'least({WIL} + {HALF}, 1)', 'hi')} FROM c")
def wilson_interval(spark, d):
    c = _labelled(spark, d).groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    lo, hi = L.wilson("k", "n")
    return c.select("source", r6(lo, "lo"), r6(hi, "hi"))


@register("dirichlet_marginal", f"WITH c AS (SELECT user_id AS ep, event_type AS k, count(*) AS n FROM events GROUP BY ALL) SELECT ep, k, {s6('(n + 0.5) / (sum(n) OVER (PARTITION BY ep) + 2.5)', 'p')} FROM c")
def dirichlet_marginal(spark, d):
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("ep"), F.col("event_type").alias("k")).agg(F.count("*").alias("n"))
    return c.select("ep", "k", r6((F.col("n") + 0.5) / (F.sum("n").over(Window.partitionBy("ep")) + 2.5), "p"))


@register("binary_icc", f"WITH c AS (SELECT user_id AS g, count(*) AS n, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id), a AS (SELECT count(*) AS k, sum(n)::DOUBLE AS t, sum(n * n)::DOUBLE AS n2, sum(f)::DOUBLE AS f, sum(f * f / n) AS f2 FROM c), b AS (SELECT (t - n2 / t) / (k - 1) AS k0, (f2 - f * f / t) / (k - 1) AS msb, (f - f2) / (t - k) AS msw, k FROM a) SELECT {s6('(msb - msw) / (msb + (k0 - 1) * msw)', 'icc')}, k FROM b")
def binary_icc(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("f"))
    return A.icc_binary(c, "f", "n").select(r6("icc", "icc"), "k")


@register("committor_table", f"SELECT o_custkey % 7 AS cell, o_orderpriority AS task, count(*) AS n, {s6('avg(CAST(o_orderstatus = {q}F{q} AS INTEGER))'.format(q=chr(39)), 'p')} FROM orders GROUP BY ALL")
def committor_table(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 7).alias("cell"), F.col("o_orderpriority").alias("task")).agg(F.count("*").alias("n"), r6(F.avg((F.col("o_orderstatus") == "F").cast("int")), "p"))


DUR = f"{EV}, du AS (SELECT ep, count(*) AS n, min(q) FILTER (k = 'error') AS e FROM ev GROUP BY ep), dd AS (SELECT coalesce(e, n) AS t, e IS NOT NULL AS d FROM du)"


def _durations(spark, d):
    u = events(spark, d).groupBy("ep").agg(F.count("*").alias("n"), F.min(F.when(F.col("k") == "error", F.col("q"))).alias("e"))
    return u.select("ep", "n", F.coalesce("e", "n").cast("long").alias("t"), F.col("e").isNotNull().alias("d"))


@register("kaplan_meier", f"WITH {DUR}, t AS (SELECT t, count(*) AS c, CAST(sum(CAST(d AS INTEGER)) AS BIGINT) AS deaths FROM dd GROUP BY t), r AS (SELECT t, deaths, CAST(sum(c) OVER (ORDER BY t DESC) AS BIGINT) AS at_risk FROM t) SELECT t, at_risk, deaths, {s6('CASE WHEN max(deaths / at_risk) OVER (ORDER BY t) >= 1 THEN 0 ELSE exp(sum(ln(greatest(1 - deaths / at_risk, 1e-300))) OVER (ORDER BY t)) END', 'survival')} FROM r")
def kaplan_meier(spark, d):
    return A.kaplan_meier(_durations(spark, d), "t", "d").select("t", "at_risk", "deaths", r6("survival", "survival"))


@register("cause_specific_hazard", f"WITH {EV}, f AS (SELECT ep, min(q) FILTER (k = 'error') AS a, min(q) FILTER (k = 'purchase') AS b, count(*) AS n FROM ev GROUP BY ep), c AS (SELECT least(coalesce(a, n), coalesce(b, n)) AS t, CASE WHEN coalesce(a, n) < coalesce(b, n) THEN 'error' WHEN coalesce(b, n) < coalesce(a, n) THEN 'purchase' ELSE 'none' END AS cause FROM f) SELECT cause, t, count(*) AS n FROM c GROUP BY ALL")
def cause_specific_hazard(spark, d):
    f = events(spark, d).groupBy("ep").agg(F.min(F.when(F.col("k") == "error", F.col("q"))).alias("a"), F.min(F.when(F.col("k") == "purchase", F.col("q"))).alias("b"), F.count("*").alias("n"))
    a, b = F.coalesce("a", "n"), F.coalesce("b", "n")
    return f.select(F.least(a, b).alias("t"), F.when(a < b, "error").when(b < a, "purchase").otherwise("none").alias("cause")).groupBy("cause", "t").agg(F.count("*").alias("n"))


@register("survival_audit", f"WITH {DUR} SELECT d, count(*) AS n, {s6('avg(CAST(t > 3 AS INTEGER))', 'alive')} FROM dd GROUP BY d")
def survival_audit(spark, d):
    return _durations(spark, d).groupBy("d").agg(F.count("*").alias("n"), r6(F.avg((F.col("t") > 3).cast("int")), "alive"))


@register("transition_matrix", f"WITH {EV}, t AS (SELECT k AS s, lead(k) {BY} AS s2 FROM ev), c AS (SELECT s, s2, count(*) AS n FROM t WHERE s2 IS NOT NULL GROUP BY ALL) SELECT s, s2, n, {s6('n / sum(n) OVER (PARTITION BY s)', 'p')} FROM c")
def transition_matrix(spark, d):
    return A.transition_matrix(events(spark, d), "ep", ["q"], "k").select("s", "s2", "n", r6("p", "p"))


_SQUARED = ", ".join(f"m{k + 1} AS MATERIALIZED (SELECT a.s, b.s2, sum(a.p * b.p) AS p FROM m{k} a JOIN m{k} b ON a.s2 = b.s GROUP BY ALL)" for k in range(4))


@register("stationary_distribution", f"WITH {EV}, t AS (SELECT k AS s, lead(k) {BY} AS s2 FROM ev), c AS (SELECT s, s2, count(*) AS n FROM t WHERE s2 IS NOT NULL GROUP BY ALL), m0 AS MATERIALIZED (SELECT s, s2, n / sum(n) OVER (PARTITION BY s) AS p FROM c), {_SQUARED} SELECT s2 AS state, {s6('sum(p) / (SELECT count(DISTINCT s) FROM m0)', 'share')} FROM m4 GROUP BY s2")
def stationary_distribution(spark, d):
    """Where the chain of event types is after sixteen steps from all types alike."""
    return A.stationary(A.transition_matrix(events(spark, d), "ep", ["q"], "k"), 4).select("state", r6("share", "share"))


@register("symbolic_entropy", f"WITH {EV}, s AS (SELECT ep, ntile(4) OVER (PARTITION BY ep ORDER BY x, q) AS z, k FROM ev), c AS (SELECT ep, k, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT ep, n / sum(n) OVER (PARTITION BY ep) AS p FROM c) SELECT ep, {s6('-sum(p * ln(p))', 'entropy')} FROM p GROUP BY ep")
def symbolic_entropy(spark, d):
    c = events(spark, d).groupBy("ep", "k").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("ep")))
    return c.groupBy("ep").agg(r6(-F.sum(F.col("p") * F.ln("p")), "entropy"))


CAL = "cp AS (SELECT least(n_chars / 20000.0, 1.0) AS p, toxic AS y FROM labels JOIN documents USING (doc_id))"


def _predicted(spark, d):
    return _labelled(spark, d).select(F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("p"), F.col("toxic").alias("y"))


@register("calibration_bins", f"WITH {CAL} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, {s6('avg(p)', 'mean_p')}, {s6('avg(y)', 'rate')} FROM cp GROUP BY 1")
def calibration_bins(spark, d):
    return A.calibration_bins(_predicted(spark, d), "p", "y", 10).select("bin", "n", r6("mean_p", "mean_p"), r6("rate", "rate"))


@register("ece_brier", f"WITH {CAL}, b AS (SELECT count(*) AS n, avg(p) AS m, avg(y) AS r FROM cp GROUP BY least(floor(p * 10), 9)) SELECT {s6('(SELECT sum(n * abs(m - r)) / sum(n) FROM b)', 'ece')}, {s6('(SELECT avg(power(p - y, 2)) FROM cp)', 'brier')}")
def ece_brier(spark, d):
    return A.ece_brier(_predicted(spark, d), "p", "y", 10).select(r6("ece", "ece"), r6("brier", "brier"))


@register("probability_table", f"WITH {CAL}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, sum(y) AS k FROM cp GROUP BY 1) SELECT bin, n, {s6('CASE WHEN n >= 20 THEN (k + 0.5) / (n + 1) ELSE (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM b) END', 'p')} FROM b")
def probability_table(spark, d):
    b = _predicted(spark, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    g = b.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("g"))  # one row
    return b.crossJoin(F.broadcast(g)).select("bin", "n", r6(F.when(F.col("n") >= 20, (F.col("k") + 0.5) / (F.col("n") + 1)).otherwise(F.col("g")), "p"))


@register("noisy_or_fusion", f"SELECT doc_id, {s6('1 - (1 - least(n_chars / 20000.0, 1.0)) * (1 - toxic * 0.5) * (1 - quality * 0.25)', 'p')} FROM labels JOIN documents USING (doc_id)")
def noisy_or_fusion(spark, d):
    return _labelled(spark, d).select("doc_id", r6(1 - (1 - F.least(F.col("n_chars") / 20000.0, F.lit(1.0))) * (1 - F.col("toxic") * 0.5) * (1 - F.col("quality") * 0.25), "p"))


def ranks(x: str, g: str, src: str) -> str:
    return f"rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0"


@register("spearman", f"WITH r AS (SELECT c_mktsegment AS g, {ranks('c_acctbal', 'c_mktsegment', '')} AS a, {ranks('c_custkey', 'c_mktsegment', '')} AS b FROM customer) SELECT g, {s6('corr(a, b)', 'rho')}, count(*) AS n FROM r GROUP BY g")
def spearman(spark, d):
    return A.spearman(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "g"), "c_acctbal", "c_custkey", "g").select("g", r6("rho", "rho"), "n")


@register("rank_residual", f"WITH r AS (SELECT c_custkey, c_nationkey AS g, {ranks('c_acctbal', 'c_nationkey', '')} AS y, {ranks('c_custkey', 'c_nationkey', '')} AS x FROM customer) SELECT c_custkey, {s6('CASE WHEN count(*) OVER (PARTITION BY g) >= 4 THEN y - avg(y) OVER (PARTITION BY g) - regr_slope(y, x) OVER (PARTITION BY g) * (x - avg(x) OVER (PARTITION BY g)) END', 'residual')} FROM r")
def rank_residual(spark, d):
    return A.rank_residual(table(spark, d, "customer"), "c_acctbal", "c_custkey", "c_nationkey").select("c_custkey", r6("residual", "residual"))


@register("aligned_means", f"WITH {ONSET} SELECT sm.q - o.onset AS offset_, count(*) AS n, {s6('avg(m)', 'mean')}, {s6('stddev_samp(m) / sqrt(count(*))', 'se')} FROM on_ o JOIN sm USING (ep) WHERE abs(sm.q - o.onset) <= 3 GROUP BY 1 HAVING count(*) > 1")
def aligned_means(spark, d):
    j = _onsets(spark, d).join(_smoothed(spark, d), "ep").withColumn("offset_", F.col("q") - F.col("onset")).where("abs(offset_) <= 3")
    return j.groupBy("offset_").agg(F.count("*").alias("n"), F.avg("m").alias("a"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("b")).where("n > 1").select("offset_", "n", r6("a", "mean"), r6("b", "se"))


# ---- significance and resampling ---------------------------------------------------------------------------------


@register("exact_random_hit", f"WITH c AS (SELECT user_id AS ep, count(*) AS n, count(*) FILTER (event_type = 'error') AS p FROM events GROUP BY user_id HAVING count(*) >= 3) SELECT ep, {s6('1 - greatest(n - p, 0) * greatest(n - p - 1, 0) * greatest(n - p - 2, 0) / (n * (n - 1) * (n - 2))', 'hit')} FROM c")
def exact_random_hit(spark, d):
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("ep")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("p")).where("n >= 3")
    return c.select("ep", r6(A.hypergeometric_hit(F.col("p"), 3, F.col("n")), "hit"))


@register("exact_sign_test", f"WITH c AS (SELECT user_id AS ep, count(*) FILTER (value > 40) AS a, count(*) FILTER (value <= 40) AS b FROM events GROUP BY user_id), t AS (SELECT ep, a + b AS n, unnest(range(0, least(a, b) + 1)) AS i FROM c) SELECT ep, {s6('least(2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 1)', 'p')} FROM t GROUP BY ep")
def exact_sign_test(spark, d):
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("ep")).agg(F.count_if(F.col("value") > 40).alias("a"), F.count_if(F.col("value") <= 40).alias("b"))
    return c.select("ep", r6(A.sign_test(F.col("a"), F.col("b")), "p"))


@register("benjamini_hochberg", f"WITH p AS (SELECT event_type AS k, exp(-avg(value) / 20) AS p FROM events GROUP BY event_type), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM p) SELECT k, {s6('least(min(p * m / i) OVER (ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING), 1)', 'adjusted')} FROM r")
def benjamini_hochberg(spark, d):
    p = table(spark, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.exp(-F.avg("value") / 20).alias("p"))
    return A.benjamini_hochberg(p, "p", "k").select("k", r6("adjusted", "adjusted"))


M = 2147483647


def lcg_sql(*terms: str) -> str:
    out = "12345::BIGINT"
    for t in terms:
        out = f"(({out} * 48271 + ({t} % {M}) * 69621 + 11) % {M})"
    return out


EFF = "ef AS (SELECT user_id AS g, avg(value) - 50 AS e FROM events GROUP BY user_id)"


@register("sign_flip_draws", f"WITH {EFF} SELECT CAST(dr AS INTEGER) AS draw, {s6(f'avg(e * CASE WHEN dr = 0 THEN 1 ELSE 1 - 2 * (CAST(floor({lcg_sql("7", "dr", "g")} / 1024) AS BIGINT) % 2) END)', 'stat')} FROM ef, (SELECT unnest(range(50)) AS dr) GROUP BY dr")
def sign_flip_draws(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("g")).agg((F.avg("value") - 50).alias("e"))
    return R.sign_flips(e, "e", "g", 50).select("draw", r6("stat", "stat"))


@register("sign_flip_p", f"WITH {EFF}, s AS (SELECT dr, avg(e * CASE WHEN dr = 0 THEN 1 ELSE 1 - 2 * (CAST(floor({lcg_sql('7', 'dr', 'g')} / 1024) AS BIGINT) % 2) END) AS stat FROM ef, (SELECT unnest(range(200)) AS dr) GROUP BY dr), o AS (SELECT abs(stat) AS o FROM s WHERE dr = 0) SELECT {s6('max(o)', 'observed')}, {s6('(count(*) FILTER (abs(stat) >= o - 1e-12) + 1) / (count(*) + 1)', 'p')} FROM s, o WHERE dr > 0")
def sign_flip_p(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("g")).agg((F.avg("value") - 50).alias("e"))
    return R.add_one_p(R.sign_flips(e, "e", "g", 200)).select(r6("observed", "observed"), r6("p", "p"))


@register("group_bootstrap", f"WITH {EFF}, nb AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM ef), pk AS (SELECT dr, CAST(floor({lcg_sql('7', 'dr', 'nb.i')} / 64) AS BIGINT) % n AS i FROM nb, (SELECT unnest(range(40)) AS dr)) SELECT CAST(dr AS INTEGER) AS draw, {s6('avg(e)', 'stat')} FROM pk JOIN nb USING (i) GROUP BY dr")
def group_bootstrap(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("g")).agg((F.avg("value") - 50).alias("e"))
    return R.bootstrap(e, "g", 40).groupBy("draw").agg(r6(F.avg("e"), "stat"))


@register(
    "label_permutation",
    f"""WITH l AS (SELECT doc_id, source, n_chars, toxic, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM labels JOIN documents USING (doc_id)),
    p AS (SELECT dr, source, n_chars, row_number() OVER (PARTITION BY dr, source ORDER BY CASE WHEN dr = 0 THEN r ELSE {lcg_sql('7', 'dr', 'doc_id')} END, doc_id) AS r FROM l, range(20) t(dr))
    SELECT dr::INTEGER AS draw, sum(toxic) AS positives, {s6('avg(p.n_chars) FILTER (toxic = 1)', 'stat')} FROM p JOIN l USING (source, r) GROUP BY dr""",
)
def label_permutation(spark, d):
    x = _labelled(spark, d)
    p = R.permuted(x.select("doc_id", "source", "n_chars", "toxic"), "toxic", ["source"], "doc_id", 20)
    return p.groupBy("draw").agg(F.sum("toxic").alias("positives"), r6(F.avg(F.when(F.col("toxic") == 1, F.col("n_chars"))), "stat"))


def axis_sql(k: int, c: str) -> str:
    """Draw counts of the units of an axis, whose seed is 7 + k."""
    return f"u{k} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {c} FROM events)), w{k} AS (SELECT dr, {c}, count(*) AS w FROM (SELECT dr, CAST(floor({lcg_sql(str(7 + k), 'dr', 'i')} / 64) AS BIGINT) % n AS i FROM u{k}, range(20) t(dr)) JOIN u{k} USING (i) GROUP BY ALL)"


@register("crossed_bootstrap", f"WITH {axis_sql(1, 'user_id')}, {axis_sql(2, 'event_type')} SELECT dr::INTEGER AS draw, {s6('sum(w1.w * w2.w * value) / sum(w1.w * w2.w)', 'stat')} FROM events JOIN w1 USING (user_id) JOIN w2 USING (dr, event_type) GROUP BY dr")
def crossed_bootstrap(spark, d):
    x = table(spark, d, "events").select("user_id", F.col("event_type").alias("k"), "value")
    w = R.crossed_weights(x, "user_id", "k", 20)
    return w.groupBy("draw").agg(r6(F.sum(F.col("weight") * F.col("value")) / F.sum("weight"), "stat"))


# ---- selection and sets ------------------------------------------------------------------------------------------


@register("stable_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def stable_topk(spark, d):
    return T.stable_topk(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25)


@register("per_pool_topk", "SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def per_pool_topk(spark, d):
    return T.per_pool_topk(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", 2).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@register("quota_topk", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS a, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS b FROM customer) SELECT c_custkey, CAST(CASE WHEN a <= 5 THEN a WHEN b <= 5 THEN b + 10 ELSE least(a, b) + 30 END AS BIGINT) AS priority FROM r ORDER BY 2, 1 LIMIT 10")
def quota_topk(spark, d):
    return T.quota_topk(table(spark, d, "customer"), "c_acctbal", "c_nationkey", "c_custkey", 10).select("c_custkey", F.col("priority").cast("long").alias("priority"))


@register("head_union", "(SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 8) UNION (SELECT c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 4)")
def head_union(spark, d):
    c = table(spark, d, "customer")
    return T.stable_topk(c, "c_acctbal", "c_custkey", 8).select("c_custkey").union(c.orderBy(F.desc("c_nationkey"), "c_custkey").limit(4).select("c_custkey")).distinct()


@register("first_fire_table", f"WITH {ONSET}, f AS (SELECT ep, min(q) AS fire FROM sm WHERE m > 90 GROUP BY ep) SELECT o.ep % 5 AS pool, count(*) AS events, count(fire) AS fired, count(*) FILTER (fire <= onset) AS in_time, {s6('avg(onset - fire)', 'mean_lead')} FROM on_ o LEFT JOIN f USING (ep) GROUP BY 1")
def first_fire_table(spark, d):
    f = _smoothed(spark, d).where("m > 90").groupBy("ep").agg(F.min("q").alias("fire"))
    j = _onsets(spark, d).join(f, "ep", "left")
    return j.groupBy((F.col("ep") % 5).alias("pool")).agg(F.count("*").alias("events"), F.count("fire").alias("fired"), F.count_if(F.col("fire") <= F.col("onset")).alias("in_time"), r6(F.avg(F.col("onset") - F.col("fire")), "mean_lead"))


@register("argmax_selector", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS least_ FROM orders GROUP BY o_custkey")
def argmax_selector(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("least_"))


@register("pareto_frontier", "SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))")
def pareto_frontier(spark, d):
    return T.pareto(table(spark, d, "part"), "p_size", "p_retailprice").select("p_partkey")


@register("constrained_selection", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <= 20 AND p_brand IS NOT NULL ORDER BY p_retailprice DESC, p_size, p_partkey LIMIT 1")
def constrained_selection(spark, d):
    return table(spark, d, "part").where("p_size <= 20 and p_brand is not null").orderBy(F.desc("p_retailprice"), "p_size", "p_partkey").limit(1).select("p_partkey", "p_size", "p_retailprice")


@register("pooled_union", "SELECT 'c' AS side, c_acctbal AS v FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier")
def pooled_union(spark, d):
    return table(spark, d, "customer").select(F.lit("c").alias("side"), F.col("c_acctbal").alias("v")).unionByName(table(spark, d, "supplier").select(F.lit("s").alias("side"), F.col("s_acctbal").alias("v")))


@register("set_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@register("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@register("state_disjoint_folds", f"WITH u AS (SELECT DISTINCT user_id AS ep FROM events) SELECT ep, CAST(ntile(4) OVER (ORDER BY {lcg_sql('7', 'ep')}, ep) - 1 AS INTEGER) AS fold FROM u")
def state_disjoint_folds(spark, d):
    return T.folds(table(spark, d, "events").select(F.col("user_id").alias("ep")).distinct(), "ep", 4).select("ep", F.col("fold").cast("int").alias("fold"))


@register("parity_split", "SELECT n_nationkey, CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1) % 2 AS INTEGER) AS half FROM nation")
def parity_split(spark, d):
    return table(spark, d, "nation").select("n_nationkey", ((F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")) - 1) % 2).alias("half"))


@register("even_subsample", f"WITH {EV}, r AS (SELECT ep, q, count(*) OVER (PARTITION BY ep) AS n FROM ev) SELECT ep, q FROM r WHERE n <= 5 OR list_contains(list_transform(range(5), lambda i: CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT)), q)")
def even_subsample(spark, d):
    return T.evenly_spaced(events(spark, d), ["ep"], ["q"], 5).select("ep", "q")


@register("balanced_sample", f"SELECT event_type AS k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {lcg_sql('7', 'event_id')}, event_id) AS r FROM events) WHERE r <= 15")
def balanced_sample(spark, d):
    return T.balanced_sample(table(spark, d, "events").withColumnRenamed("event_type", "k"), "k", "event_id", 15).select("k", "event_id")


# ---- scalars -----------------------------------------------------------------------------------------------------


@register("sanitise_identifiers", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def sanitise_identifiers(spark, d):
    return table(spark, d, "part").select("p_partkey", L.sanitised("p_name").alias("name"))


@register("path_parts", "SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[-1] AS tail FROM pages")
def path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", L.path_part("url", "/", 3).alias("host"), L.path_part("url", "/", -1).alias("tail"))


@register("log_sum_exp", f"SELECT vec_id, {s6('ln(list_sum(list_transform(embedding, lambda t: exp(CAST(t AS DOUBLE)))))', 'y')} FROM embeddings")
def log_sum_exp(spark, d):
    return embeddings(spark, d).select("vec_id", r6(L.log_sum_exp("v"), "y"))


@register("discretise", "SELECT event_id, CAST((value >= 10) AS INTEGER) + CAST((value >= 50) AS INTEGER) + CAST((value >= 200) AS INTEGER) AS bin FROM events")
def discretise(spark, d):
    return table(spark, d, "events").select("event_id", L.binned("value", [10.0, 50.0, 200.0]).alias("bin"))


@register("normal_scores")
def normal_scores(spark, d):
    r = table(spark, d, "customer").withColumn("p", (A.average_rank("c_acctbal", "c_nationkey") - 0.5) / F.count("*").over(Window.partitionBy("c_nationkey")))
    return r.select("c_custkey", r6(L.normal_quantile("p"), "z"))


@register("json_parse", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("json_safe_encode")
def json_safe_encode(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") > 300, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return io.without_nan(e).select("event_id", F.to_json(F.struct("event_id", "value"), {"ignoreNullFields": "false"}).alias("json"))


# ---- sequence models ---------------------------------------------------------------------------------------------

BOS = f"lg AS (SELECT ep, q, k, coalesce(lag(k, 1) {BY}, '^') AS l1, coalesce(lag(k, 2) {BY}, '^') AS l2, row_number() OVER (PARTITION BY ep ORDER BY q DESC) = 1 AS z FROM ev), al AS (SELECT k AS target, l1, l2 FROM lg UNION ALL SELECT '$', k, l1 FROM lg WHERE z)"
NG = f"{EV}, {BOS}, ng AS (SELECT 0 AS \"order\", '' AS context, target FROM al UNION ALL SELECT 1, l1, target FROM al UNION ALL SELECT 2, l2 || ' ' || l1, target FROM al), nc AS (SELECT \"order\", context, target, count(*) AS n FROM ng GROUP BY ALL)"


@register("ngram_counts", f"WITH {NG} SELECT \"order\", context, target, n FROM nc")
def ngram_counts(spark, d):
    return G.ngram_counts(events(spark, d), "ep", ["q"], "k", 2)


@register("ngram_probabilities", f"WITH {NG} SELECT \"order\", context, target, {s6('(n + 0.5) / (sum(n) OVER (PARTITION BY \"order\", context) + 3.0)', 'p')} FROM nc")
def ngram_probabilities(spark, d):
    return G.smoothed(G.ngram_counts(events(spark, d), "ep", ["q"], "k", 2), 6).select("order", "context", "target", r6("p", "p"))


@register("backoff_scores", f"WITH {NG}, pr AS (SELECT *, sum(n) OVER (PARTITION BY \"order\", context) AS s, (n + 0.5) / (sum(n) OVER (PARTITION BY \"order\", context) + 3.0) AS p FROM nc), pb AS (SELECT * FROM pr WHERE s >= 100 OR \"order\" = 0) SELECT ep, count(*) AS words, {s6('sum(ln(coalesce(b.p, a.p, z.p, 1e-6)))', 'log_p')} FROM lg LEFT JOIN pb b ON b.\"order\" = 2 AND b.context = l2 || ' ' || l1 AND b.target = k LEFT JOIN pb a ON a.\"order\" = 1 AND a.context = l1 AND a.target = k LEFT JOIN pb z ON z.\"order\" = 0 AND z.target = k GROUP BY ep")
def backoff_scores(spark, d):
    e = events(spark, d)
    p = G.backed_off(G.smoothed(G.ngram_counts(e, "ep", ["q"], "k", 2), 6), 100)
    return G.sequence_score(e, p, "ep", ["q"], "k", 2, 1e-6).select("ep", "words", r6("log_p", "log_p"))


@register("position_grammar", f"WITH {EV}, c AS (SELECT least(q, 10) AS position, k AS target, count(*) AS n FROM ev GROUP BY ALL) SELECT position, target, n, {s6('n / sum(n) OVER (PARTITION BY position)', 'p')} FROM c")
def position_grammar(spark, d):
    return G.position_counts(events(spark, d), "q", "k", 10).select("position", "target", "n", r6("p", "p"))


@register("duration_model", f"WITH {EV}, n AS (SELECT ep, q, k, CASE WHEN lag(k) {BY} = k THEN 0 ELSE 1 END AS s FROM ev), r AS (SELECT ep, k, sum(s) {over()} AS g FROM n), l AS (SELECT k, count(*) AS length FROM r GROUP BY ep, g, k), t AS (SELECT k, length, count(*) AS runs FROM l GROUP BY ALL) SELECT k, length, runs, {s6('runs / sum(runs) OVER (PARTITION BY k ORDER BY length DESC)', 'hazard')} FROM t")
def duration_model(spark, d):
    return G.durations(events(spark, d), "ep", "q", "k").select("k", "length", "runs", r6("hazard", "hazard"))


PRIOR, TRANS = [0.7, 0.3], [[0.9, 0.1], [0.2, 0.8]]
EMIT = [{"view": 0.4, "click": 0.3, "purchase": 0.15, "signup": 0.1, "error": 0.05}, {"view": 0.1, "click": 0.1, "purchase": 0.1, "signup": 0.1, "error": 0.6}]


def _words(spark, d):
    return events(spark, d).groupBy("ep").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "k"))), lambda s: s["k"]).alias("words"))


@register("prefix_forward_filter")
def prefix_forward_filter(spark, d):
    f = _words(spark, d).withColumn("f", G.forward_filter(F.col("words"), PRIOR, TRANS, EMIT))
    return f.select("ep", r6(F.col("f.belief")[1], "p_late"), r6("f.evidence", "evidence"))


@register("best_path_score")
def best_path_score(spark, d):
    return _words(spark, d).select("ep", r6(G.decode_path(F.col("words"), TRANS, EMIT), "score"))


# ---- sources -----------------------------------------------------------------------------------------------------


@register("episode_reconciliation", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 4)")
def episode_reconciliation(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return io.reconciled(rows, table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(4).alias("expected")), "l_orderkey", "expected")


@register("label_firewall", "SELECT doc_id, lang, n_chars FROM documents")
def label_firewall(spark, d):
    return io.guarded(table(spark, d, "documents"), "doc_id", "lang", "n_chars")


@register("content_hash", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def content_hash(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@register("trace_locate", f"WITH {EV} SELECT a.ep, a.q AS start FROM ev a JOIN ev b ON a.ep = b.ep AND b.q = a.q + 1 JOIN ev c ON a.ep = c.ep AND c.q = a.q + 2 WHERE a.k = 'click' AND b.k = 'view' AND c.k = 'error'")
def trace_locate(spark, d):
    trace = spark.createDataFrame([(0, "click"), (1, "view"), (2, "error")], "pos int, word string")
    return io.locate(events(spark, d), "ep", "q", "k", trace, "pos", "word")


@register("table_fingerprint")
def table_fingerprint(spark, d):
    return io.table_hash(table(spark, d, "nation"))


