"""Queries of the vector functions and within-query dynamics over embeddings."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import vectors as V
from .common import EM, EM2, EP, embeddings, episodes, in_order, pairs, r6, s6


def zsum(a: str, b: str, f: str) -> str:
    """SQL sum over two lists of an expression in x and y."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: {re.sub(r'\b[xy]\b', lambda m: 't[1]' if m[0] == 'x' else 't[2]', f)}))"


BC = zsum("p", "q", "sqrt(x * y)")
DOT, NV, NU = zsum("v", "u", "x * y"), "sqrt(list_sum(list_transform(v, lambda t: t * t)))", "sqrt(list_sum(list_transform(u, lambda t: t * t)))"
INTER = "len(list_intersect(ia, ib))"


def pair(name: str, column, sql: str) -> None:
    register(name, f"WITH {EM2} SELECT vec_id, {s6(sql, 'y')} FROM pr")(lambda spark, d: pairs(spark, d).select("vec_id", r6(column(), "y")))


def rounded(name: str, column, sql: str) -> None:
    """A query of one array for each embedding, its entries rounded."""
    want = f"list_transform({sql}, lambda t: round(t + 1e-9, 6) + 0.0)"
    register(name, f"WITH {EM} SELECT vec_id, {want} AS y FROM em")(lambda spark, d: embeddings(spark, d).select("vec_id", F.transform(column(), lambda t: F.round(t + F.lit(1e-9), 6) + F.lit(0.0)).alias("y")))


def single(name: str, column, sql: str, cte: str = EM) -> None:
    src = "em" if cte == EM else "es"
    register(name, f"WITH {cte} SELECT vec_id, {s6(sql, 'y')} FROM {src}")(lambda spark, d: embeddings(spark, d).select("vec_id", r6(column(), "y")))


pair("hellinger_affinity", lambda: V.hellinger("p", "q"), f"sqrt(least(greatest(1 - {BC}, 0), 1))")
pair("hellinger_chord", lambda: V.hellinger_chord("p", "q"), "sqrt(" + zsum("p", "q", "power(sqrt(x) - sqrt(y), 2)") + " / 2)")
pair("hellinger_snapped", lambda: V.hellinger_snapped("p", "q", 0.3), f"CASE WHEN {BC} > 0.7 THEN 0 ELSE sqrt(least(greatest(1 - {BC}, 0), 1)) END")
pair("weighted_jaccard", lambda: V.weighted_jaccard("p", "q"), zsum("p", "q", "least(x, y)") + " / greatest(" + zsum("p", "q", "greatest(x, y)") + ", 1e-12)")
pair("support_jaccard", lambda: V.support_jaccard_distance("ids", "ib"), f"1 - {INTER} / (8.0 - {INTER})")
pair("cosine_similarity", lambda: V.cosine("v", "u"), f"CASE WHEN {NV} * {NU} <= 1e-8 THEN 0 ELSE {DOT} / ({NV} * {NU}) END")
pair("euclidean_distance", lambda: V.euclidean("v", "u"), "sqrt(" + zsum("v", "u", "(x - y) * (x - y)") + ")")
pair("rms_distance", lambda: V.rms("v", "u"), "sqrt(" + zsum("v", "u", "(x - y) * (x - y)") + " / len(v))")
pair("total_variation", lambda: V.total_variation("p", "q"), zsum("p", "q", "abs(x - y)") + " / 2")
SW = "list_sum(list_transform(list_intersect(ia, ib), lambda i: sqrt(p[i + 1] * q[i + 1])))"
pair("sparse_hellinger", lambda: V.sparse_hellinger("ids", "w", "ib", "wb"), f"sqrt(least(greatest(1 - coalesce({SW}, 0), 0), 1))")
LO = "coalesce(list_sum(list_transform(list_intersect(ia, ib), lambda i: least(p[i + 1], q[i + 1]))), 0)"
ALL = "(list_sum(list_transform(ia, lambda i: p[i + 1])) + list_sum(list_transform(ib, lambda i: q[i + 1])))"
pair("selected_mass_jaccard", lambda: V.selected_jaccard("ids", "w", "ib", "wb"), f"{LO} / greatest({ALL} - {LO}, 1e-12)")

H = "-list_sum(list_transform(p, lambda t: t * ln(greatest(t, 1e-12))))"
DESC = "list_reverse_sort(p)"
single("gate_entropy", lambda: V.entropy("p", normal=True), f"{H} / ln(len(p))")
single("raw_entropy", lambda: V.entropy("p"), H)
single("top_margin", lambda: V.margin("p"), f"{DESC}[1] - {DESC}[2]")
single("top4_mass", lambda: V.top_mass("p", 4), f"list_sum({DESC}[1:4])")
single("tail_mass", lambda: V.tail_mass("w"), f"1 - list_sum({DESC}[1:4])")
single("support_boundary", lambda: V.support_boundary("p", "ids"), f"{DESC}[4] - {DESC}[5]")
single("vector_norm", lambda: V.norm("v"), "sqrt(list_sum(list_transform(v, lambda t: t * t)))")
single("square_root_embedding_norm", lambda: V.norm(V.rooted("p")), "sqrt(list_sum(list_transform(p, lambda t: sqrt(t) * sqrt(t))))")
single("strict_normalisation", lambda: V.total(V.strict_normalised(F.transform("v", F.abs), 64)), "list_sum(p)")
rounded("topk_weight_renormalisation", lambda: V.weights_of("w"), f"list_transform({DESC}[1:4], lambda t: t / list_sum({DESC}[1:4]))")
single("dense_support_mass", lambda: V.total(V.densified("ids", "w", 64)), f"list_sum({DESC}[1:4])")
single("linear_position_slope", lambda: V.slope("v"), "(SELECT regr_slope(y, CAST(i AS DOUBLE)) FROM (SELECT unnest(v) AS y, unnest(range(64)) AS i))")
COM = "list_sum(list_transform(list_zip(p, range(64)), lambda t: t[1] * (t[2] + 0.5)))"
single("flow_centre_of_mass", lambda: V.centre_of_mass("p"), f"{COM} / greatest(list_sum(p), 1e-12)")
rounded("path_resampling", lambda: V.resampled("v", 10), "list_transform(range(10), lambda i: v[1 + 7 * i])")
QS = "list_sum(list_transform(p, lambda s: power(round(sqrt(s) * 15) / 15, 2)))"
single("quantised_probability", lambda: F.array_max(V.quantised("p", 4)), f"CASE WHEN {QS} > 0 THEN power(round(sqrt(list_max(p)) * 15) / 15, 2) / {QS} ELSE 1.0 / 64 END")
SK = "list_sum(list_transform(list_zip(v, range(64)), lambda t: CASE WHEN (t[2] * 48271 + 7) % 8 = b THEN t[1] * (1 - 2 * (CAST(floor((t[2] * 69621 + 7) / 16.0) AS BIGINT) % 2)) ELSE 0 END))"
rounded("count_sketch", lambda: V.count_sketch("v", 8), f"list_transform(range(8), lambda b: {SK})")


@register("expert_relabelling", f"WITH {EM2} SELECT vec_id, list_transform(ids, lambda i: CAST((i * 5 + 3) % 64 AS INTEGER)) AS ids FROM es")
def expert_relabelling(spark, d):
    return embeddings(spark, d).select("vec_id", F.transform(V.relabelled("ids", 5, 3, 64), lambda i: i.cast("int")).alias("ids"))


@register(
    "route_comparison",
    f"WITH {EM2} SELECT vec_id, {s6(f'sqrt(least(greatest(1 - {BC}, 0), 1))', 'hellinger')}, {s6(f'{DOT} / ({NV} * {NU})', 'cosine')}, {s6(f'{INTER} / (8.0 - {INTER})', 'jaccard')}, {INTER} = 4 AS same_set FROM pr",
)
def route_comparison(spark, d):
    return pairs(spark, d).select("vec_id", r6(V.hellinger("p", "q"), "hellinger"), r6(V.cosine("v", "u"), "cosine"), r6(1 - V.support_jaccard_distance("ids", "ib"), "jaccard"), (F.size(F.array_intersect("ids", "ib")) == 4).alias("same_set"))


@register(
    "support_occupancy",
    f"""WITH {EM2}, x AS (SELECT label, unnest(ids) AS e FROM es), c AS (SELECT label, e, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT label, e, n / sum(n) OVER (PARTITION BY label) AS p, n FROM c)
    SELECT label, count(*) AS used, max(n) AS most, {s6('1 + sum(p * ln(p)) / ln(64)', 'concentration')} FROM t GROUP BY label""",
)
def support_occupancy(spark, d):
    c = embeddings(spark, d).select("label", F.explode("ids").alias("e")).groupBy("label", "e").agg(F.count("*").alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("label")))
    return c.groupBy("label").agg(F.count("*").alias("used"), F.max("n").alias("most"), r6(1 + F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(64.0)), "concentration"))


@register(
    "expert_mutual_information",
    f"""WITH {EM}, x AS (SELECT vec_id, label, unnest(p) AS p, unnest(range(64)) AS e FROM em), m AS (SELECT label, e, avg(p) AS m FROM x GROUP BY ALL), h AS (SELECT label, -sum(m * ln(greatest(m, 1e-12))) AS h FROM m GROUP BY label),
    o AS (SELECT label, avg({H}) AS o FROM em GROUP BY label) SELECT label, {s6('h - o', 'mi')} FROM h JOIN o USING (label)""",
)
def expert_mutual_information(spark, d):
    e = embeddings(spark, d)
    m = e.select("label", F.posexplode("p").alias("e", "p")).groupBy("label", "e").agg(F.avg("p").alias("m"))
    h = m.groupBy("label").agg((-F.sum(F.col("m") * F.ln(F.greatest("m", F.lit(1e-12))))).alias("h"))
    o = e.groupBy("label").agg(F.avg(V.entropy("p")).alias("o"))
    return h.join(o, "label").select("label", r6(F.col("h") - F.col("o"), "mi"))


GR = f"{EP}, g AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM ep), t AS (SELECT *, (r - 1) // 12 AS site FROM g)"


#: The same of whole labels.
LABEL_GR = GR.replace(EP, EM).replace("FROM ep)", "FROM em)")


def _group(spark, d, size: int = 12):
    """All embeddings of an episode in order of id, dealt over sites of a few members, as the tokens of a site are."""
    e = episodes(embeddings(spark, d)).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return e.withColumn("site", F.floor((F.col("r") - 1) / size))


def _site_pairs(g, *cols: str):
    """Pairs of the members of each site; the second member's columns have a 2 at their end."""
    b = g.select("label", "site", F.col("r").alias("r2"), *[F.col(c).alias(c + "2") for c in cols])
    return g.select("label", "site", "r", *cols).join(b, ["label", "site"]).where("r < r2")


@register(
    "token_consensus",
    f"""WITH {GR}, z AS (SELECT a.label, a.p, b.p AS q FROM t a JOIN t b ON a.label = b.label AND a.site = b.site AND a.r < b.r)
    SELECT label, {s6(f'avg({zsum("p", "q", "least(x, y)")} / greatest({zsum("p", "q", "greatest(x, y)")}, 1e-12))', 'consensus')}, {s6(f'avg(sqrt(least(greatest(1 - {BC}, 0), 1)))', 'dispersion')} FROM z GROUP BY label""",
)
def token_consensus(spark, d):
    """Mean over all pairs of members of a site, over all sites of an episode."""
    return _site_pairs(_group(spark, d), "p").groupBy("label").agg(r6(F.avg(V.weighted_jaccard("p", "p2")), "consensus"), r6(F.avg(V.hellinger("p", "p2")), "dispersion"))


@register(
    "pairwise_median_distance",
    f"WITH {GR}, z AS (SELECT a.label, a.v, b.v AS u FROM t a JOIN t b ON a.label = b.label AND a.site = b.site AND a.r < b.r) SELECT label, {s6('median(sqrt(' + zsum('v', 'u', '(x - y) * (x - y)') + '))', 'median_distance')} FROM z GROUP BY label",
)
def pairwise_median_distance(spark, d):
    return _site_pairs(_group(spark, d), "v").groupBy("label").agg(r6(F.median(V.euclidean("v", "v2")), "median_distance"))


@register(
    "state_action_gap",
    f"WITH {GR}, s AS (SELECT label, p AS q FROM t WHERE r = 1), z AS (SELECT t.label, t.p, s.q FROM t JOIN s USING (label) WHERE r > 1) SELECT label, {s6(f'avg(sqrt(least(greatest(1 - {BC}, 0), 1)))', 'gap')} FROM z GROUP BY label",
)
def state_action_gap(spark, d):
    g = _group(spark, d)
    return g.where("r > 1").select("label", "p").join(g.where("r = 1").select("label", F.col("p").alias("q")), "label").groupBy("label").agg(r6(F.avg(V.hellinger("p", "q")), "gap"))


#: Embeddings of an episode in order of id as a path of steps.
PATH = f"{EP}, w AS (SELECT vec_id, label, v, p, lag(v) OVER o AS v1, lag(v, 2) OVER o AS v2, lag(p) OVER o AS p1, lead(p) OVER o AS p2, first_value(v) OVER o AS v0 FROM ep WINDOW o AS (PARTITION BY label ORDER BY vec_id))"


#: The same of whole labels.
LABEL_PATH = PATH.replace(EP, EM).replace("FROM ep WINDOW", "FROM em WINDOW")


def _path(spark, d):
    o = Window.partitionBy("label").orderBy("vec_id")
    return episodes(embeddings(spark, d)).select("vec_id", "label", "v", "p", F.lag("v").over(o).alias("v1"), F.lag("v", 2).over(o).alias("v2"), F.lag("p").over(o).alias("p1"), F.lead("p").over(o).alias("p2"))


def dist(a: str, b: str) -> str:
    return f"sqrt({zsum(a, b, '(x - y) * (x - y)')})"


@register("path_speed", f"WITH {LABEL_PATH} SELECT label, {s6(f'sum({dist("v", "v1")})', 'path')}, {s6(f'avg({dist("v", "v1")})', 'speed')} FROM w WHERE v1 IS NOT NULL GROUP BY label")
def path_speed(spark, d):
    s = V.euclidean("x", "x1")
    return in_order(embeddings(spark, d), "v").where("x1 is not null").groupBy("label").agg(r6(F.sum(s), "path"), r6(F.avg(s), "speed"))


@register("path_efficiency", f"WITH {PATH}, e AS (SELECT label, sum({dist('v', 'v1')}) AS len, arg_min(v, vec_id) AS a, arg_max(v, vec_id) AS b FROM w WHERE v1 IS NOT NULL GROUP BY label) SELECT label, {s6(f'{dist("a", "b")} / greatest(len, 1e-12)', 'efficiency')} FROM e")
def path_efficiency(spark, d):
    e = _path(spark, d).where("v1 is not null").groupBy("label").agg(F.sum(V.euclidean("v", "v1")).alias("len"), F.min_by("v", "vec_id").alias("a"), F.max_by("v", "vec_id").alias("b"))
    return e.select("label", r6(V.euclidean("a", "b") / F.greatest("len", F.lit(1e-12)), "efficiency"))


ACC = "sqrt(list_sum(list_transform(list_zip(p1, p, p2), lambda t: power(sqrt(t[3]) - 2 * sqrt(t[2]) + sqrt(t[1]), 2)))) / sqrt(2)"


@register("route_acceleration", f"WITH {LABEL_PATH} SELECT label, {s6(f'avg({ACC})', 'acceleration')} FROM w WHERE p1 IS NOT NULL AND p2 IS NOT NULL GROUP BY label")
def route_acceleration(spark, d):
    step = F.zip_with(V.rooted("xn"), F.zip_with(V.rooted("x"), V.rooted("x1"), lambda b, a: 2 * b - a), lambda c, x: c - x)
    return in_order(embeddings(spark, d), "p").where("x1 is not null and xn is not null").groupBy("label").agg(r6(F.avg(V.norm(step) / F.sqrt(F.lit(2.0))), "acceleration"))


@register("late_flow_volatility", f"WITH {PATH} SELECT label, {s6(f'avg(1 - {zsum("p", "p1", "least(x, y)")} / greatest({zsum("p", "p1", "greatest(x, y)")}, 1e-12))', 'volatility')} FROM w WHERE p1 IS NOT NULL GROUP BY label")
def late_flow_volatility(spark, d):
    return _path(spark, d).where("p1 is not null").groupBy("label").agg(r6(F.avg(1 - V.weighted_jaccard("p", "p1")), "volatility"))


TURN = "list_sum(list_transform(list_zip(v, v1, v2), lambda t: (t[1] - t[2]) * (t[2] - t[3])))"


@register("velocity_turn", f"WITH {LABEL_PATH} SELECT vec_id, {s6(f'1 - {TURN} / ({dist("v", "v1")} * {dist("v1", "v2")})', 'turn')} FROM w WHERE v2 IS NOT NULL")
def velocity_turn(spark, d):
    sub = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    return in_order(embeddings(spark, d), "v").where("x2 is not null").select("vec_id", r6(1 - V.cosine(sub("x", "x1"), sub("x1", "x2")), "turn"))
