"""Further queries: distances between groups, response and straightness of paths, events, crossfits, grammars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import vectors as V
from ..functions.scalars import lcg
from ..operators import sequence as G
from ..operators import stats as A
from ..operators import windows as W
from .common import BY, EV, S, embeddings, episodes, events, numbered_in_label, r6, s6, table
from .stats import lcg_sql
from .vectors import EM, GR, LABEL_GR, LABEL_PATH, PATH, _group, _path, _site_pairs, dist, zsum

# ---- groups of vectors -------------------------------------------------------------------------------------------


@register("pairwise_rms", f"WITH {GR}, z AS (SELECT a.label, a.v, b.v AS u FROM t a JOIN t b ON a.label = b.label AND a.site = b.site AND a.r < b.r) SELECT label, {s6('sqrt(avg(' + zsum('v', 'u', '(x - y) * (x - y)') + '))', 'rms')} FROM z GROUP BY label")
def pairwise_rms(spark, d):
    return _site_pairs(_group(spark, d), "v").groupBy("label").agg(r6(F.sqrt(F.avg(F.pow(V.euclidean("v", "v2"), F.lit(2)))), "rms"))


@register("leave_one_out_distance", f"WITH {GR}, x AS (SELECT label, vec_id, unnest(v) AS v, unnest(range(64)) AS i FROM t), c AS (SELECT label, vec_id, v - (sum(v) OVER (PARTITION BY label, i) - v) / (count(*) OVER (PARTITION BY label, i) - 1) AS e FROM x) SELECT vec_id, {s6('sqrt(sum(e * e))', 'distance')} FROM c GROUP BY vec_id")
def leave_one_out_distance(spark, d):
    """Distance to the mean of the episode's other members, from one sum for each episode and place; NaN where there is no other."""
    e = episodes(embeddings(spark, d)).select("vec_id", "label", "v")
    sums = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("s"), F.max("n").alias("n"))  # one entry for each place
    gap = F.zip_with("v", "s", lambda v, s: v - (s - v) / (F.col("n") - 1))
    return e.join(sums, "label").select("vec_id", r6(F.when(F.col("n") > 1, V.norm(gap)).otherwise(F.lit(float("nan"))), "distance"))


@register("layer_disagreement", f"WITH {LABEL_GR}, z AS (SELECT a.label, a.p, b.p AS q FROM t a JOIN t b ON a.label = b.label AND (a.r - 1) // 4 = (b.r - 1) // 4 AND a.r < b.r) SELECT label, count(*) AS pairs, {s6('avg(sqrt(least(greatest(1 - ' + zsum('p', 'q', 'sqrt(x * y)') + ', 0), 1)))', 'disagreement')} FROM z GROUP BY label")
def layer_disagreement(spark, d):
    g = numbered_in_label(embeddings(spark, d).select("vec_id", "label", "p")).withColumn("site", F.floor((F.col("r") - 1) / 4))
    return _site_pairs(g, "p").groupBy("label").agg(F.count("*").alias("pairs"), r6(F.avg(V.hellinger("p", "p2")), "disagreement"))


@register("random_sign_sketch", f"WITH {EM} SELECT vec_id, {s6('list_sum(list_transform(list_zip(v, range(64)), lambda t: t[1] * (1 - 2 * (CAST(floor((t[2] * 69621 + 11) / 16.0) AS BIGINT) % 2)))) / 8', 'y')} FROM em")
def random_sign_sketch(spark, d):
    return embeddings(spark, d).select("vec_id", r6(V.total(F.transform("v", lambda x, i: x * (1 - 2 * F.pmod(F.floor((i * 69621 + 11) / 16), F.lit(2))))) / 8, "y"))


@register("seeded_permutation", f"SELECT vec_id, list_transform(list_sort(list_transform(range(10), lambda i: {{'h': {lcg_sql('3', 'vec_id', 'i')}, 'i': i}})), lambda t: CAST(t.i AS INTEGER)) AS perm FROM embeddings")
def seeded_permutation(spark, d):
    items = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(lcg(F.lit(3), F.col("vec_id"), i).alias("h"), i.alias("i")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(F.array_sort(items), lambda t: t["i"]).alias("perm"))


@register("conditional_graph", f"WITH {LABEL_GR}, s AS (SELECT label, v AS s FROM t WHERE r = 1), z AS (SELECT t.label, t.v, s.s FROM t JOIN s USING (label) WHERE r > 1), o AS (SELECT label, {zsum('v', 's', 'x * y')} AS c, {zsum('v', 'v', 'x * y')} AS n FROM z) SELECT label, {s6('avg(greatest(n - c * c, 1e-8))', 'residual')} FROM o GROUP BY label")
def conditional_graph(spark, d):
    """Each member of a label against its first."""
    g = embeddings(spark, d).select("vec_id", "label", "v")
    z = g.join(g.groupBy("label").agg(F.min("vec_id").alias("first"), F.min_by("v", "vec_id").alias("s")), "label").where("vec_id > first")
    c = V.dot("v", "s")
    return z.groupBy("label").agg(r6(F.avg(F.greatest(V.dot("v", "v") - c * c, F.lit(1e-8))), "residual"))


# ---- paths -------------------------------------------------------------------------------------------------------


@register("perturbation_response", f"WITH {LABEL_PATH}, p AS (SELECT label, vec_id, {dist('v', 'v0')} AS dd, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS f FROM w), a AS (SELECT label, max(dd) AS peak, arg_max(dd, f) AS term FROM p GROUP BY label) SELECT label, {s6('peak', 'peak')}, {s6('term', 'terminal')}, {s6('CASE WHEN peak > 1e-12 THEN (peak - term) / peak END', 'funnel')} FROM a")
def perturbation_response(spark, d):
    """Distance from a label's first member: the largest, the last, and what share of the largest is lost at the end."""
    e = embeddings(spark, d).select("label", "vec_id", "v")
    starts = e.groupBy(F.col("label").alias("_label")).agg(F.min_by("v", "vec_id").alias("v0"))
    p = e.join(starts, F.col("label").eqNullSafe(F.col("_label"))).select("label", "vec_id", V.euclidean("v", "v0").alias("dd"))
    a = p.groupBy("label").agg(F.max("dd").alias("peak"), F.max_by("dd", "vec_id").alias("term"))
    return a.select("label", r6("peak", "peak"), r6("term", "terminal"), r6(F.when(F.col("peak") > 1e-12, (F.col("peak") - F.col("term")) / F.col("peak")), "funnel"))


@register("contraction_slope", f"WITH {PATH}, p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS f, {dist('v', 'v1')} AS dd FROM w WHERE v1 IS NOT NULL) SELECT label, {s6('regr_slope(ln(greatest(dd, 1e-12)), CAST(f AS DOUBLE))', 'slope')} FROM p GROUP BY label HAVING count(*) > 1")
def contraction_slope(spark, d):
    p = _path(spark, d).where("v1 is not null").withColumn("f", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    p = p.select("label", F.col("f").cast("double").alias("f"), F.ln(F.greatest(V.euclidean("v", "v1"), F.lit(1e-12))).alias("y"))
    return p.groupBy("label").agg(F.regr_slope("y", "f").alias("s"), F.count("*").alias("n")).where("n > 1").select("label", r6("s", "slope"))


@register("settling_ratio", f"WITH {PATH}, p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS f, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS g, {dist('v', 'v1')} AS dd FROM w WHERE v1 IS NOT NULL) SELECT label, {s6('ln((avg(dd) FILTER (g <= 3) + 1e-6) / (avg(dd) FILTER (f <= 3) + 1e-6))', 'settling')} FROM p GROUP BY label")
def settling_ratio(spark, d):
    o = Window.partitionBy("label")
    p = _path(spark, d).where("v1 is not null").select("label", V.euclidean("v", "v1").alias("dd"), F.row_number().over(o.orderBy("vec_id")).alias("f"), F.row_number().over(o.orderBy(F.desc("vec_id"))).alias("g"))
    tail, head = F.avg(F.when(F.col("g") <= 3, F.col("dd"))), F.avg(F.when(F.col("f") <= 3, F.col("dd")))
    return p.groupBy("label").agg(r6(F.ln((tail + 1e-6) / (head + 1e-6)), "settling"))


@register("flow_straightness", f"WITH {EV} SELECT ep, count(*) AS n, {s6('regr_slope(x, CAST(q AS DOUBLE))', 'slope')}, {s6('regr_intercept(x, CAST(q AS DOUBLE))', 'intercept')}, {s6('abs(arg_max(x, q) - arg_min(x, q)) / greatest(sum(abs(d)), 1e-9)', 'straightness')} FROM (SELECT *, x - lag(x) {BY} AS d FROM ev) GROUP BY ep HAVING count(*) > 2")
def flow_straightness(spark, d):
    e = events(spark, d).withColumn("d", F.abs(W.lag_delta(S, "x", 1))).withColumn("t", F.col("q").cast("double"))
    a = e.groupBy("ep").agg(F.count("*").alias("n"), F.regr_slope("x", "t").alias("s"), F.regr_intercept("x", "t").alias("i"), (F.abs(F.max_by("x", "q") - F.min_by("x", "q")) / F.greatest(F.sum("d"), F.lit(1e-9))).alias("st"))
    return a.where("n > 2").select("ep", "n", r6("s", "slope"), r6("i", "intercept"), r6("st", "straightness"))


@register("lagged_correlation", f"WITH {EV}, l AS (SELECT ep, x, lag(x, 2) {BY} AS y FROM ev) SELECT ep, {s6('corr(x, y)', 'r')} FROM l WHERE y IS NOT NULL GROUP BY ep HAVING count(*) > 3")
def lagged_correlation(spark, d):
    lagged = events(spark, d).select("ep", "x", F.lag("x", 2).over(S.by).alias("y")).where("y is not null")
    return lagged.groupBy("ep").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).where("n > 3").select("ep", r6("r", "r"))


# ---- events and labels -------------------------------------------------------------------------------------------


@register("energy_statistic", "WITH c AS (SELECT c_nationkey AS cell, c_acctbal AS x, c_mktsegment = 'BUILDING' AS f FROM customer), p AS (SELECT a.cell, a.f AS fa, b.f AS fb, abs(a.x - b.x) AS d FROM c a JOIN c b ON a.cell = b.cell), s AS (SELECT cell, 2 * avg(d) FILTER (fa AND NOT fb) - avg(d) FILTER (fa AND fb) - avg(d) FILTER (NOT fa AND NOT fb) AS e FROM p GROUP BY cell) SELECT cell, " + s6("e", "energy") + " FROM s WHERE e IS NOT NULL")
def energy_statistic(spark, d):
    """Energy distance of two labels within a cell, from sorted prefix sums: no pair is formed.

    The sum of |x - y| over the pairs of a sorted list is sum(x_i (2 i - n - 1)), so all three means follow from ranks.
    """
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("cell"), F.col("c_acctbal").alias("x"), (F.col("c_mktsegment") == "BUILDING").alias("f"))

    def spread(df, *keys):
        w = Window.partitionBy(*keys)
        i, n = F.row_number().over(w.orderBy("x")), F.count("*").over(w)
        return df.withColumn("_t", F.col("x") * (2 * i - n - 1)).groupBy(*keys).agg(F.sum("_t").alias("pairs"), F.count("*").alias("n"))

    own = spread(c, "cell", "f")
    a = own.where("f").select("cell", F.col("pairs").alias("pf"), F.col("n").alias("nf"))
    b = own.where("not f").select("cell", F.col("pairs").alias("ps"), F.col("n").alias("ns"))
    j = spread(c, "cell").select("cell", F.col("pairs").alias("pa")).join(a, "cell").join(b, "cell")
    between = (F.col("pa") - F.col("pf") - F.col("ps")) / (F.col("nf") * F.col("ns"))
    e = 2 * between - 2 * F.col("pf") / (F.col("nf") * F.col("nf")) - 2 * F.col("ps") / (F.col("ns") * F.col("ns"))
    return j.select("cell", r6(e, "energy"))


@register("centred_dwell_events", f"WITH {EV}, w AS (SELECT ep, q, avg(CAST(x > 40 AS INTEGER)) OVER (PARTITION BY ep ORDER BY q ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM ev) SELECT ep, coalesce(min(q) FILTER (m >= 0.6), -1) AS onset, count(*) FILTER (m >= 0.6) AS dwell FROM w GROUP BY ep")
def centred_dwell_events(spark, d):
    m = F.avg(F.expr("x > 40").cast("int")).over(S.by.rowsBetween(-2, 2))
    return events(spark, d).withColumn("m", m).groupBy("ep").agg(F.coalesce(F.min(F.when(F.col("m") >= 0.6, F.col("q"))), F.lit(-1)).alias("onset"), F.count_if(F.col("m") >= 0.6).alias("dwell"))


@register("edge_events", f"WITH {EV}, e AS (SELECT ep, q, x < 10 AND lag(x) {BY} >= 10 AS fell, max(x) OVER (PARTITION BY ep ORDER BY q ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) > 100 AS lifted FROM ev) SELECT ep, coalesce(min(q) FILTER (fell AND lifted), max(q) FILTER (fell), -1) AS grasp FROM e GROUP BY ep")
def edge_events(spark, d):
    fell = F.expr("x < 10") & (F.lag("x").over(S.by) >= 10)
    lifted = F.max("x").over(S.by.rowsBetween(1, 3)) > 100
    e = events(spark, d).withColumn("fell", fell).withColumn("lifted", lifted)
    return e.groupBy("ep").agg(F.coalesce(F.min(F.when(F.col("fell") & F.col("lifted"), F.col("q"))), F.max(F.when(F.col("fell"), F.col("q"))), F.lit(-1)).alias("grasp"))


@register("healthy_return_table", f"WITH {EV}, z AS (SELECT ep, q, least(CAST(floor(x / 40) AS INTEGER), 4) AS level, min(x) OVER (PARTITION BY ep ORDER BY q ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) < 20 AS back FROM ev) SELECT level, count(*) AS n, {s6('(count(*) FILTER (back) + 0.5) / (count(*) + 1)', 'p')} FROM z WHERE back IS NOT NULL GROUP BY level")
def healthy_return_table(spark, d):
    z = events(spark, d).select(F.least(F.floor(F.col("x") / 40), F.lit(4)).cast("int").alias("level"), (F.min("x").over(S.by.rowsBetween(1, 3)) < 20).alias("back")).where("back is not null")
    return z.groupBy("level").agg(F.count("*").alias("n"), r6((F.count_if(F.col("back")) + 0.5) / (F.count("*") + 1), "p"))


@register("first_above_control", f"WITH {EV}, c AS (SELECT q, quantile_cont(x, 0.9) AS t FROM ev WHERE ep % 2 = 0 GROUP BY q) SELECT ep, min(q) AS first FROM ev JOIN c USING (q) WHERE ep % 2 = 1 AND x > t GROUP BY ep")
def first_above_control(spark, d):
    e = events(spark, d)
    c = e.where("ep % 2 = 0").groupBy("q").agg(F.percentile("x", F.lit(0.9)).alias("t"))
    return e.where("ep % 2 = 1").join(c, "q").where("x > t").groupBy("ep").agg(F.min("q").alias("first"))


@register("crossfit_thresholds", f"WITH {EV}, m AS (SELECT ep, ep % 4 AS f, max(x) AS m FROM ev GROUP BY ALL), t AS (SELECT h AS f, list_sort(list(m))[CAST(ceil(0.9 * (count(*) - 1) - 1e-9) AS BIGINT) + 1] AS t FROM m, (SELECT unnest(range(4)) AS h) WHERE f <> h GROUP BY h) SELECT ep, coalesce(min(q) FILTER (x > t), -1) AS first_alarm FROM ev JOIN t ON f = ep % 4 GROUP BY ep")
def crossfit_thresholds(spark, d):
    """Thresholds of a fold from the peaks of all other folds, replayed on the fold's own episodes."""
    e = events(spark, d).withColumn("f", (F.col("ep") % 4).cast("int"))
    peaks = e.groupBy("ep", "f").agg(F.max("x").alias("m"))
    others = peaks.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("f <> h")
    t = A.quantile_higher(others, "m", 0.9, "h", name="t").select(F.col("h").alias("f"), "t")
    return e.join(t, "f").groupBy("ep").agg(F.coalesce(F.min(F.when(F.col("x") > F.col("t"), F.col("q"))), F.lit(-1)).alias("first_alarm"))


@register("peak_bound", f"WITH {EV}, m AS (SELECT ep % 4 AS f, ep, max(x) AS m FROM ev GROUP BY ALL) SELECT f, list_reverse_sort(list(m))[CAST(floor(0.1 * count(*)) AS BIGINT) + 1] AS bound FROM m GROUP BY f")
def peak_bound(spark, d):
    m = events(spark, d).groupBy((F.col("ep") % 4).alias("f"), "ep").agg(F.max("x").alias("m"))
    w = Window.partitionBy("f")
    r = m.withColumn("r", F.row_number().over(w.orderBy(F.desc("m")))).withColumn("n", F.count("*").over(w))
    return r.where(F.col("r") == F.floor(F.col("n") * 0.1) + 1).select("f", F.col("m").alias("bound"))


# ---- grammars ----------------------------------------------------------------------------------------------------


@register("position_context_grammar", f"WITH {EV}, l AS (SELECT least(q, 10) AS position, coalesce(lag(k) {BY}, '^') AS context, k AS target FROM ev), p AS (SELECT position, target, n / sum(n) OVER (PARTITION BY position) AS pp FROM (SELECT position, target, count(*) AS n FROM l GROUP BY ALL)), c AS (SELECT position, context, target, count(*) AS n FROM l GROUP BY ALL) SELECT c.position, context, c.target, {s6('(n + 2.5 * pp) / (sum(n) OVER (PARTITION BY c.position, context) + 2.5)', 'p')} FROM c JOIN p ON c.position = p.position AND c.target = p.target")
def position_context_grammar(spark, d):
    e = events(spark, d).withColumn("context", F.coalesce(F.lag("k").over(S.by), F.lit("^"))).withColumn("position", F.least("q", F.lit(10)))
    p = G.position_counts(e, "position", "k", 10).select("position", "target", F.col("p").alias("pp"))
    c = e.groupBy("position", "context", F.col("k").alias("target")).agg(F.count("*").alias("n"))
    n = F.sum("n").over(Window.partitionBy("position", "context"))
    return c.withColumn("s", n).join(p, ["position", "target"]).select("position", "context", "target", r6((F.col("n") + 2.5 * F.col("pp")) / (F.col("s") + 2.5), "p"))


