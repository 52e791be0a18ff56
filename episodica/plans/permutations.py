"""Queries of family-wise permutation tests with vectors of draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import maxt as M
from .common import EV, events, r6, s6
from .stats import _labelled, lcg_sql

DRAWS, MOD = 60, 2147483647


def fifth(x: str) -> str:
    """SQL of the hash's fifth power."""
    two = f"({x} * {x} % {MOD})"
    return f"(({two} * {two} % {MOD}) * {x} % {MOD})"


P = f"top AS (SELECT dr, max(dist) AS t FROM st WHERE dr > 0 GROUP BY dr) SELECT cell, {s6('any_value(st.stat)', 'observed')}, {s6(f'(count(*) FILTER (t >= st.dist - 1e-12) + 1) / ({DRAWS} + 1)', 'p')} FROM st, top WHERE st.dr = 0 GROUP BY cell"


@register(
    "label_maxt",
    f"""WITH l AS (SELECT doc_id, source, lang, toxic, n_chars FROM labels JOIN documents USING (doc_id)),
    h AS (SELECT doc_id, source, toxic, dr, sum(toxic) OVER (PARTITION BY source, dr) AS m, {lcg_sql('7', 'dr', 'doc_id')} AS x FROM l, range({DRAWS + 1}) t(dr)),
    y AS (SELECT doc_id, dr, CASE WHEN dr = 0 THEN toxic ELSE (rank() OVER (PARTITION BY source, dr ORDER BY {fifth('x')}) <= m)::INTEGER END AS y FROM h),
    v AS (SELECT doc_id, lang, cell, v FROM (SELECT doc_id, lang, n_chars::DOUBLE AS length, (n_chars % 17)::DOUBLE AS rest, (doc_id % 101)::DOUBLE AS place FROM l) UNPIVOT (v FOR cell IN (length, rest, place))),
    r AS (SELECT doc_id, lang, cell, rank() OVER (PARTITION BY cell, lang ORDER BY v) + (count(*) OVER (PARTITION BY cell, lang, v) - 1) / 2.0 AS r FROM v),
    w AS (SELECT dr, cell, lang, sum(y * r) - sum(y) * (sum(y) + 1) / 2.0 AS wins, sum(y) * (count(*) - sum(y)) AS pairs FROM r JOIN y USING (doc_id) GROUP BY ALL),
    st AS (SELECT dr, cell, sum(CASE WHEN pairs > 0 THEN wins ELSE 0 END) / sum(pairs) AS stat, abs(sum(CASE WHEN pairs > 0 THEN wins ELSE 0 END) / sum(pairs) - 0.5) AS dist FROM w GROUP BY ALL), {P}""",
)
def label_maxt(spark, d):
    """Which of three measures of a document set toxic ones apart within languages, labels shuffled within sources."""
    x = _labelled(spark, d)
    tall = x.select("doc_id", "source", "lang", "toxic", F.col("n_chars").cast("double").alias("length"), (F.col("n_chars") % 17).cast("double").alias("rest"), (F.col("doc_id") % 101).cast("double").alias("place"))
    tall = tall.unpivot(["doc_id", "source", "lang", "toxic"], ["length", "rest", "place"], "cell", "v")
    return M.label_maxt(tall, "doc_id", "toxic", "source", "cell", "lang", "v", DRAWS).select("cell", r6("observed", "observed"), r6("p", "p"))


def flips_sql(studentised: bool, weighted: bool) -> str:
    mean = "sum(w * e * sg) / sum(w)"
    error = f"sqrt(greatest(sum(w * e * e) / sum(w) - ({mean}) * ({mean}), 0) * sum(w * w) / (sum(w) * sum(w)))"
    stat = f"CASE WHEN {error} > 1e-12 THEN ({mean}) / {error} END" if studentised else mean
    return f"""WITH {EV}, ef AS (SELECT ep AS g, k AS cell, avg(x) - 50 AS e, {'count(*)::DOUBLE' if weighted else '1.0'} AS w FROM ev GROUP BY ALL),
    sg AS (SELECT *, CASE WHEN dr = 0 THEN 1 ELSE 1 - 2 * (({fifth('x')} // 1024) % 2) END AS sg FROM (SELECT *, {lcg_sql('7', 'dr', 'g')} AS x FROM ef, range({DRAWS + 1}) t(dr))),
    st AS (SELECT dr, cell, stat, abs(stat) AS dist FROM (SELECT dr, cell, {stat} AS stat FROM sg GROUP BY dr, cell) WHERE stat IS NOT NULL), {P}"""


def _effects(spark, d):
    return events(spark, d).groupBy(F.col("ep").alias("g"), F.col("k").alias("cell")).agg((F.avg("x") - 50).alias("e"), F.count("*").alias("w"))


@register("studentised_sign_flip_maxt", flips_sql(True, False))
def studentised_sign_flip_maxt(spark, d):
    return M.sign_flip_maxt(_effects(spark, d), "e", "g", "cell", DRAWS).select("cell", r6("observed", "observed"), r6("p", "p"))


@register("weighted_sign_flip_maxt", flips_sql(False, True))
def weighted_sign_flip_maxt(spark, d):
    """Mean effects weighted by an episode's events, not studentised."""
    return M.sign_flip_maxt(_effects(spark, d), "e", "g", "cell", DRAWS, weight="w", studentised=False).select("cell", r6("observed", "observed"), r6("p", "p"))
