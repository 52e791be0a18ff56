"""Queries of the models by task and phase: a user is an episode, users fall into five tasks, even users are healthy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import phases as H
from ..operators import windows as W
from .common import EV, S, embeddings, events, over, r6, s6

TASKS, RIDGE_LEAST, CELL_LEAST, RETURN_LEAST = 5, 64, 40, 32


def healthy():
    return F.col("ep") % 2 == 0


def steps(spark, d):
    """ep, q, task, x, v (running total, value) and progress of every step."""
    e = events(spark, d)
    n = F.count("*").over(Window.partitionBy("ep"))
    total = F.sum("x").over(S.past)
    return e.select("ep", "q", (F.col("ep") % TASKS).alias("task"), "x", F.array(total / 1000, F.col("x") / 100).alias("v"), (F.col("q") / F.greatest(n - 1, F.lit(1))).alias("progress"))


STEPS = f"""{EV}, st AS (SELECT ep, q, ep % {TASKS} AS task, x, sum(x) {over()} / 1000 AS a, x / 100 AS b, q / greatest(count(*) OVER (PARTITION BY ep) - 1, 1) AS y FROM ev)"""
#: Ridge of each task (or of all rows) by its two normal equations.
RIDGE = f"""{STEPS}, rm AS (SELECT task, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) * covar_pop(a, a) + 10 AS aa, count(*) * covar_pop(b, b) + 10 AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS wy FROM st WHERE ep % 2 = 0 GROUP BY GROUPING SETS ((task), ())),
rw AS (SELECT task, n, ma, mb, my, (ay * bb - wy * ab) / (aa * bb - ab * ab) AS wa, (wy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM rm),
rp AS (SELECT st.*, CASE WHEN t.n >= {RIDGE_LEAST} THEN struct_pack(wa := t.wa, wb := t.wb, b := t.my - t.wa * t.ma - t.wb * t.mb) ELSE struct_pack(wa := g.wa, wb := g.wb, b := g.my - g.wa * g.ma - g.wb * g.mb) END AS w FROM st LEFT JOIN rw t ON t.task = st.task, (SELECT * FROM rw WHERE task IS NULL) g),
ph AS MATERIALIZED (SELECT ep, q, task, x, a, b, least(greatest(w.wa * a + w.wb * b + w.b, 0), 1) AS phase FROM rp),
pb AS (SELECT *, least(greatest(floor(phase * 5), 0), 4)::INTEGER AS bin FROM ph)"""


def with_phase(spark, d):
    return H.phase_ridge(steps(spark, d), healthy(), "task", "v", "progress", 2, least=RIDGE_LEAST)


@register("phase_ridge", f"WITH {RIDGE} SELECT ep, q, {s6('phase', 'phase')} FROM ph")
def phase_ridge(spark, d):
    return with_phase(spark, d).select("ep", "q", r6("phase", "phase"))


#: Shrunk Gaussians of two dimensions of any grouping of rows (a, b).
def gauss_sql(source: str, sets: str, keys: str) -> str:
    return f"""g0 AS (SELECT {keys}, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM {source} GROUP BY GROUPING SETS ({sets})),
g1 AS (SELECT g0.*, x.a - ma AS a, x.b - mb AS b FROM {source} x JOIN g0 ON {' AND '.join(f'(g0.{k} IS NULL OR g0.{k} = x.{k})' for k in keys.split(', '))}),
g2 AS (SELECT {keys}, n, ma, mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab, avg(power(a * a + b * b, 2)) AS f FROM g1 GROUP BY ALL),
g3 AS (SELECT *, (aa + bb) / 2 AS mu, aa * aa + bb * bb + 2 * ab * ab AS sq FROM g2),
g4 AS (SELECT *, (f - sq) / (2 * n) AS be, (sq - 2 * mu * (aa + bb) + 2 * mu * mu) / 2 AS de FROM g3),
g5 AS (SELECT *, CASE WHEN least(be, de) <= 0 THEN 0 ELSE least(be, de) / de END AS sh FROM g4),
g6 AS (SELECT *, (1 - sh) * aa + sh * mu AS ca, (1 - sh) * bb + sh * mu AS cb, (1 - sh) * ab AS cc FROM g5),
gs AS MATERIALIZED (SELECT {keys}, n, ma, mb, cb / (ca * cb - cc * cc) AS pa, ca / (ca * cb - cc * cc) AS pb, -cc / (ca * cb - cc * cc) AS pc FROM g6)"""


def away_sql(g: str) -> str:
    return f"(({g}.pa * (a - {g}.ma) * (a - {g}.ma) + {g}.pb * (b - {g}.mb) * (b - {g}.mb) + 2 * {g}.pc * (a - {g}.ma) * (b - {g}.mb)) / 2)"


@register(
    "dynamics_density",
    f"""WITH {RIDGE}, he AS (SELECT * FROM pb WHERE ep % 2 = 0), {gauss_sql('he', '(task, bin), (task), ()', 'task, bin')}
    SELECT p.ep, p.q, {s6(f'CASE WHEN c.n >= {CELL_LEAST} THEN {away_sql("c")} WHEN t.n >= {CELL_LEAST} THEN {away_sql("t")} ELSE {away_sql("g")} END', 'score')}, CASE WHEN c.n >= {CELL_LEAST} THEN 'cell' WHEN t.n >= {CELL_LEAST} THEN 'task' ELSE 'all' END AS level
    FROM pb p LEFT JOIN (SELECT * FROM gs WHERE bin IS NOT NULL) c ON c.task = p.task AND c.bin = p.bin LEFT JOIN (SELECT * FROM gs WHERE bin IS NULL AND task IS NOT NULL) t ON t.task = p.task, (SELECT * FROM gs WHERE task IS NULL) g""",
)
def dynamics_density(spark, d):
    rows = H.dynamics_density(with_phase(spark, d), healthy(), "task", "v", "phase", 2, least=CELL_LEAST)
    return rows.select("ep", "q", r6("score", "score"), "level")


def reference_sql(keys: str, name: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    at = f"count(*) FILTER (ep % 2 = 0) OVER ({part} ORDER BY x RANGE UNBOUNDED PRECEDING)"
    return f"({at} + 0.5) / (count(*) FILTER (ep % 2 = 0) OVER ({part}) + 1) AS {name}"


CDF = f"""{RIDGE}, pc AS (SELECT *, {reference_sql('task, bin', 'p1')}, {reference_sql('task', 'p2')}, {reference_sql('', 'p3')}, count(*) FILTER (ep % 2 = 0) OVER (PARTITION BY task, bin) AS n1, count(*) FILTER (ep % 2 = 0) OVER (PARTITION BY task) AS n2 FROM pb),
pp AS MATERIALIZED (SELECT ep, q, phase, CASE WHEN n1 >= {CELL_LEAST} THEN p1 WHEN n2 > 0 THEN p2 ELSE p3 END AS p FROM pc)"""


def with_percentile(spark, d):
    return H.phase_percentile(with_phase(spark, d), healthy(), "task", "x", "phase", least=CELL_LEAST)


@register("phase_conditional_cdf", f"WITH {CDF} SELECT ep, q, {s6('p', 'percentile')} FROM pp")
def phase_conditional_cdf(spark, d):
    return with_percentile(spark, d).select("ep", "q", r6("percentile", "percentile"))


def chance_sql(t: str) -> str:
    return f"({t}.r + 2) / ({t}.t + 4)"


@register(
    "healthy_return_model",
    f"""WITH {CDF}, dw AS (SELECT *, (q - coalesce(max(CASE WHEN p < 0.9 THEN q END) {over()}, -1))::INTEGER AS dwell, coalesce(phase - lag(phase) OVER (PARTITION BY ep ORDER BY q), 0) AS v, lead(1, 3) OVER (PARTITION BY ep ORDER BY q) IS NOT NULL AS there, min(p) OVER (PARTITION BY ep ORDER BY q ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS low FROM pp),
    bi AS (SELECT *, (p >= 0.8)::INTEGER + (p >= 0.9)::INTEGER + (p >= 0.95)::INTEGER + (p >= 0.98)::INTEGER AS l, least(dwell, 3) AS w, (v >= -0.02)::INTEGER + (v >= 0.02)::INTEGER AS s FROM dw),
    ct AS (SELECT l, w, s, count(*) AS t, sum((low < 0.8)::INTEGER) AS r FROM bi WHERE ep % 2 = 0 AND there GROUP BY GROUPING SETS ((l, w, s), (l, w), (l), ()))
    SELECT ep, q, b.dwell, b.l AS level, b.w AS dwell_bin, b.s AS velocity_bin, {s6(f'CASE WHEN c3.t >= {RETURN_LEAST} THEN {chance_sql("c3")} WHEN c2.t >= {RETURN_LEAST} THEN {chance_sql("c2")} WHEN c1.t >= {RETURN_LEAST} THEN {chance_sql("c1")} ELSE {chance_sql("c0")} END', 'chance')}
    FROM bi b LEFT JOIN (SELECT * FROM ct WHERE s IS NOT NULL) c3 ON c3.l = b.l AND c3.w = b.w AND c3.s = b.s LEFT JOIN (SELECT * FROM ct WHERE s IS NULL AND w IS NOT NULL) c2 ON c2.l = b.l AND c2.w = b.w LEFT JOIN (SELECT * FROM ct WHERE w IS NULL AND l IS NOT NULL) c1 ON c1.l = b.l, (SELECT * FROM ct WHERE l IS NULL) c0""",
)
def healthy_return_model(spark, d):
    """Chance to come back within three steps, by level, dwell and phase velocity."""
    rows = H.healthy_return(with_percentile(spark, d), S, healthy(), "percentile", "phase", least=RETURN_LEAST)
    return rows.select("ep", "q", F.col("dwell").cast("int").alias("dwell"), "level", "dwell_bin", "velocity_bin", r6("chance", "chance"))


# ---- anchors and shrinkage


@register(
    "anchor_template",
    f"""WITH {EV}, sg AS (SELECT ep, q, x / 100 AS a, CASE WHEN count(*) {over(4)} > 1 THEN regr_slope(x / 100, q::DOUBLE) {over(4)} ELSE 0 END AS b FROM ev),
    oc AS (SELECT ep, min(q) AS onset FROM ev WHERE x > 200 GROUP BY ep),
    ne AS (SELECT sg.*, q - onset AS o FROM sg JOIN oc USING (ep) WHERE q - onset BETWEEN -3 AND 3 AND ep % 2 = 0),
    pr AS (SELECT o, avg(a) AS ma, avg(b) AS mb FROM ne GROUP BY o HAVING count(*) >= 4),
    rs AS (SELECT a - ma AS a, b - mb AS b FROM ne JOIN pr USING (o)),
    m AS (SELECT count(*) AS n, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab, avg(power(a * a + b * b, 2)) AS f FROM rs),
    s1 AS (SELECT *, (aa + bb) / 2 AS mu, aa * aa + bb * bb + 2 * ab * ab AS sq FROM m),
    s2 AS (SELECT *, least((f - sq) / (2 * n), (sq - 2 * mu * (aa + bb) + 2 * mu * mu) / 2) AS be, (sq - 2 * mu * (aa + bb) + 2 * mu * mu) / 2 AS de FROM s1),
    s3 AS (SELECT *, CASE WHEN be <= 0 THEN 0 ELSE be / de END AS sh FROM s2),
    s4 AS (SELECT (1 - sh) * aa + sh * mu AS ca, (1 - sh) * bb + sh * mu AS cb, (1 - sh) * ab AS cc FROM s3)
    SELECT ep, q, {s6('-min((cb * (a - ma) * (a - ma) + ca * (b - mb) * (b - mb) - 2 * cc * (a - ma) * (b - mb)) / (ca * cb - cc * cc) / 2)', 'score')} FROM sg, pr, s4 GROUP BY ep, q""",
)
def anchor_template(spark, d):
    """How near each step's value and slope are to what they are around the onsets of healthy episodes."""
    e = events(spark, d)
    onset = e.where("x > 200").groupBy("ep").agg(F.min("q").alias("onset"))
    x = F.col("x") / 100
    slope = F.when(F.count("*").over(S.last(4)) > 1, W.trailing_slope(S, x, 4)).otherwise(0.0)
    rows = e.withColumn("v", F.array(x, slope)).join(onset, "ep", "left")
    return H.anchor_template(rows, S, "onset", healthy(), "v", 2).select("ep", "q", r6("score", "score"))


@register(
    "shrunk_mahalanobis",
    f"""WITH he AS (SELECT vec_id, label AS task, 0 AS bin, list_sum([x::DOUBLE FOR x IN embedding[1:32]]) AS a, list_sum([x::DOUBLE FOR x IN embedding[33:64]]) AS b FROM embeddings), {gauss_sql('he', '(task)', 'task')}
    SELECT vec_id, {s6(away_sql('gs'), 'distance')} FROM he JOIN gs USING (task)""",
)
def shrunk_mahalanobis(spark, d):
    """Distance from the mean of the own label, with that label's shrunk covariance."""
    half = lambda start: F.aggregate(F.slice("v", start, 32), F.lit(0.0), lambda s, x: s + x)
    e = embeddings(spark, d).select("vec_id", "label", F.array(half(1), half(33)).alias("z"))

    def gauss(m):
        mean, precision, _ = H.shrunk(m, 2)
        return mean.tolist(), precision.ravel().tolist()

    models = H.worked(H.keyed_moments(e, ["label"], "z", 2), ["label"], "mean array<double>, precision array<double>", gauss)
    j = e.join(models, "label").withColumn("away", F.zip_with("z", "mean", lambda x, m: x - m))
    return j.select("vec_id", r6(H.form(F.col("away"), "precision", 2) / 2, "distance"))
