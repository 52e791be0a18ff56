"""Queries of family-wise and paired tests, rank tests, threshold selection, Markov chances, late paths and fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import vectors as V
from ..operators import inference as I
from ..operators import stats as A
from ..operators.windows import geometric_mean
from ..runtime import ship
from .common import BY, EV, S, events, r6, s6, table
from .stats import _labelled, lcg_sql
from .vectors import PATH, _path, dist

SIGN = f"CASE WHEN dr = 0 THEN 1 ELSE 1 - 2 * (CAST(floor({lcg_sql('7', 'dr', 'g')} / 1024) AS BIGINT) % 2) END"


@register(
    "sign_flip_maxt",
    f"WITH ef AS (SELECT user_id AS g, event_type AS k, avg(value) - 50 AS e FROM events GROUP BY ALL), s AS (SELECT dr, k, avg(e * {SIGN}) AS stat FROM ef, (SELECT unnest(range(101)) AS dr) GROUP BY dr, k), t AS (SELECT dr, max(abs(stat)) AS top FROM s WHERE dr > 0 GROUP BY dr) SELECT k, {s6('any_value(stat)', 'observed')}, {s6('(count(*) FILTER (top >= abs(stat) - 1e-12) + 1) / (count(*) + 1)', 'p')} FROM s, t WHERE s.dr = 0 GROUP BY k",
)
def sign_flip_maxt(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("g"), F.col("event_type").alias("k")).agg((F.avg("value") - 50).alias("e"))
    return I.sign_flip_maxt(e, "e", "g", "k", 100).select("k", r6("observed", "observed"), r6("p", "p"))


@register(
    "paired_bootstrap",
    f"WITH {EV}, ar AS (SELECT ep AS g, avg(x) FILTER (q % 2 = 0) AS a, avg(x) FILTER (q % 2 = 1) AS b FROM ev GROUP BY ep), df AS (SELECT g, a - b AS e FROM ar WHERE a IS NOT NULL AND b IS NOT NULL), nb AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM df), pk AS (SELECT dr, CAST(floor({lcg_sql('7', 'dr', 'nb.i')} / 64) AS BIGINT) % n AS i FROM nb, (SELECT unnest(range(60)) AS dr)), m AS (SELECT dr, avg(e) AS m FROM pk JOIN nb USING (i) GROUP BY dr) SELECT {s6('(SELECT avg(e) FROM df)', 'delta')}, {s6('quantile_cont(m, 0.025)', 'lo')}, {s6('quantile_cont(m, 0.975)', 'hi')}, {s6('least(1.0, 2 * least(avg(CAST(m <= 0 AS INTEGER)), avg(CAST(m >= 0 AS INTEGER))))', 'p')} FROM m",
)
def paired_bootstrap(spark, d):
    arms = events(spark, d).groupBy("ep").agg(F.avg(F.when(F.col("q") % 2 == 0, F.col("x"))).alias("a"), F.avg(F.when(F.col("q") % 2 == 1, F.col("x"))).alias("b"))
    return I.paired_bootstrap(arms, "a", "b", "ep", 60).select(*[r6(c, c) for c in ("delta", "lo", "hi", "p")])


RANKED = "count(*) AS t, sum(count(*)) OVER (PARTITION BY {g} ORDER BY {v}) - count(*) + (count(*) + 1) / 2.0 AS r"


@register(
    "mann_whitney",
    f"WITH c AS (SELECT source, n_chars, count(*) FILTER (quality = 1) AS a, {RANKED.format(g='source', v='n_chars')} FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL GROUP BY source, n_chars), s AS (SELECT source, sum(a * r) AS r, sum(a) AS n, sum(t) AS m, sum(power(t, 3) - t) AS ties FROM c GROUP BY source), u AS (SELECT *, r - n * (n + 1) / 2 AS u, n * (m - n) / 12 * (m + 1 - ties / (m * (m - 1))) AS spread FROM s WHERE n > 0 AND m > n) SELECT source, u * 1.0 AS u, {s6('CASE WHEN spread > 0 THEN (u - n * (m - n) / 2) / sqrt(spread) ELSE 0 END', 'z')} FROM u",
)
def mann_whitney(spark, d):
    return I.rank_sum(_labelled(spark, d), "n_chars", F.col("quality") == 1, "source").select("source", "u", r6("z", "z"))


@register(
    "wilcoxon_signed_rank",
    f"WITH {EV}, df AS (SELECT ep % 5 AS scene, floor((x - lag(x) {BY}) * 10) AS y FROM ev), c AS (SELECT scene, abs(y) AS v, count(*) FILTER (y > 0) AS a, {RANKED.format(g='scene', v='abs(y)')} FROM df WHERE y <> 0 GROUP BY scene, abs(y)), s AS (SELECT scene, sum(a * r) AS w, sum(t) AS n, sum(power(t, 3) - t) AS ties FROM c GROUP BY scene) SELECT scene, w * 1.0 AS w, {s6('(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)', 'z')} FROM s",
)
def wilcoxon_signed_rank(spark, d):
    y = events(spark, d).select((F.col("ep") % 5).alias("scene"), F.floor((F.col("x") - F.lag("x").over(S.by)) * 10).alias("y"))
    return I.signed_rank(y, "y", "scene").select("scene", "w", r6("z", "z"))


QUANTILES = (0.5, 0.75, 0.9, 0.95, 1.0)


@register("learn_then_test")
def learn_then_test(spark, d):
    ship(spark)
    e = events(spark, d).groupBy("ep").agg(F.max("x").alias("level"), (F.max("x") - F.min("x")).alias("range"), (F.max_by("k", F.struct("x", "q")) == "error").alias("event"))
    peaks = e.select("event", F.explode(F.create_map(F.lit("level"), "level", F.lit("range"), "range")).alias("channel", "peak"))
    return I.learn_then_test(peaks, "channel", "peak", "event", QUANTILES, 0.3, 0.1)


STEP = "(SELECT st.s, CASE WHEN st.s = 'error' THEN 1.0 ELSE coalesce(sum(p.p * h.h), 0) END AS h FROM st LEFT JOIN p ON p.s = st.s LEFT JOIN {h} h ON h.s = p.s2 GROUP BY st.s)"


@register(
    "hitting_probability",
    f"WITH {EV}, t AS (SELECT k AS s, lead(k) {BY} AS s2 FROM ev), c AS (SELECT s, s2, count(*) AS n FROM t WHERE s2 IS NOT NULL GROUP BY ALL), p AS (SELECT s, s2, n / sum(n) OVER (PARTITION BY s) AS p FROM c), st AS (SELECT DISTINCT s FROM p), h0 AS (SELECT s, CASE WHEN s = 'error' THEN 1.0 ELSE 0.0 END AS h FROM st), h1 AS {STEP.format(h='h0')}, h2 AS {STEP.format(h='h1')}, h3 AS {STEP.format(h='h2')}, h4 AS {STEP.format(h='h3')} SELECT s, {s6('h', 'chance')} FROM h4",
)
def hitting_probability(spark, d):
    return I.hitting(A.transition_matrix(events(spark, d), "ep", ["q"], "k"), "error", 4).select("s", r6("chance", "chance"))


@register(
    "late_path_and_curvature",
    f"WITH {PATH}, n AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 2 AS i, count(*) OVER (PARTITION BY label) - 1 AS f, {dist('v', 'v1')} AS step, CASE WHEN v2 IS NOT NULL THEN sqrt(list_sum(list_transform(list_zip(v, v1, v2), lambda t: power(t[1] - 2 * t[2] + t[3], 2)))) END AS bend FROM w) SELECT label, {s6('coalesce(sum(step) FILTER (i >= ceil(0.5 * f)), 0)', 'v_late')}, {s6('any_value(f) * sum(bend) / (sum(step) + 1e-9)', 'a_route')} FROM n WHERE i >= 0 GROUP BY label",
)
def late_path_and_curvature(spark, d):
    o = Window.partitionBy("label").orderBy("vec_id")
    steps = F.count("*").over(Window.partitionBy("label")) - 1
    bend = F.sqrt(F.aggregate(F.arrays_zip("v", "v1", "v2"), F.lit(0.0), lambda s, t: s + F.pow(t["v"] - 2 * t["v1"] + t["v2"], F.lit(2))))
    n = _path(spark, d).select("label", (F.row_number().over(o) - 2).alias("i"), steps.alias("f"), V.euclidean("v", "v1").alias("step"), F.when(F.col("v2").isNotNull(), bend).alias("bend"))
    late = F.coalesce(F.sum(F.when(F.col("i") >= F.ceil(0.5 * F.col("f")), F.col("step"))), F.lit(0.0))
    return n.where("i >= 0").groupBy("label").agg(r6(late, "v_late"), r6(F.max("f") * F.sum("bend") / (F.sum("step") + 1e-9), "a_route"))


@register("adjacent_geometric_mean", f"WITH {EV} SELECT ep, q, {s6(f'CASE WHEN lag(x) {BY} IS NOT NULL THEN sqrt(least(greatest(x / 100 * ((lag(x) {BY}) / 100), 0), 1)) END', 'g')} FROM ev")
def adjacent_geometric_mean(spark, d):
    return events(spark, d).select("ep", "q", r6(geometric_mean(F.col("x") / 100, F.lag("x").over(S.by) / 100), "g"))


PCT = "(rank() OVER (PARTITION BY scene ORDER BY {v}) + (count(*) OVER (PARTITION BY scene, {v}) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY scene)"


@register(
    "percentile_fusion",
    f"WITH e AS (SELECT user_id % 5 AS scene, user_id AS ep, max(value) AS a, -min(value) AS b, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT scene, ep, {PCT.format(v='a')} AS pa, {PCT.format(v='b')} AS pb, {PCT.format(v='n')} AS pn FROM e) SELECT scene, ep, {s6('(pa + pb + pn) / 3', 'mean_percentile')}, {s6('greatest(pa, pb, pn)', 'max_percentile')} FROM p",
)
def percentile_fusion(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("scene"), F.col("user_id").alias("ep")).agg(F.max("value").alias("a"), (-F.min("value")).alias("b"), F.count("*").alias("n"))
    whole = F.count("*").over(Window.partitionBy("scene"))
    p = [(F.rank().over(Window.partitionBy("scene").orderBy(v)) + (F.count("*").over(Window.partitionBy("scene", v)) - 1) / 2 - 0.5) / whole for v in ("a", "b", "n")]
    return e.select("scene", "ep", *[x.alias(f"p{i}") for i, x in enumerate(p)]).select("scene", "ep", r6((F.col("p0") + F.col("p1") + F.col("p2")) / 3, "mean_percentile"), r6(F.greatest("p0", "p1", "p2"), "max_percentile"))
