"""Queries through array stores that Spark writes from the tables, of paths from a front to a back stage, and of site graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import transfer as T
from ..functions import vectors as V
from ..operators import graphs as R
from ..operators.ranked import numbered
from ..sources import arrays as A
from .common import RANGE, S, r6, s6, table

CHUNK = 128


def numbered_vectors(spark, d):
    return numbered(table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")), "vec_id")


ROWS = "n AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, embedding AS v FROM embeddings)"
NORM = "sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN v]))"


@register("zarr_scan", f"WITH {ROWS} SELECT row, vec_id, {s6(NORM, 'norm')} FROM n")
def zarr_scan(spark, d):
    """All rows of a store that the table was written to, of two of its three arrays."""
    path = A.work_path(spark, "zarr")
    A.write_zarr(numbered_vectors(spark, d), path, CHUNK)
    return A.read_zarr(spark, path, "vec_id", "vector").select("row", "vec_id", r6(V.norm(V.doubles("vector")), "norm"))


@register("zarr_row_range", f"WITH {ROWS} SELECT label, count(*) AS n, min(row) AS first, max(row) AS last FROM n WHERE row >= 100 AND row < 300 GROUP BY label")
def zarr_row_range(spark, d):
    """The limits on row reach the store's planner: blocks outside are not opened."""
    path = A.work_path(spark, "zarr")
    A.write_zarr(numbered_vectors(spark, d), path, CHUNK)
    r = A.read_zarr(spark, path, "label").where("row >= 100 AND row < 300")
    return r.groupBy("label").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))


@register("npz_bundles", f"WITH {ROWS} SELECT label, count(*) AS n, {s6(f'sum({NORM})', 'norms')} FROM n GROUP BY label")
def npz_bundles(spark, d):
    """A table through schema-tagged bundles and back."""
    path = A.work_path(spark, "npz")
    A.write_npz(table(spark, d, "embeddings").select("label", F.col("embedding").alias("vector")), path, "vectors", "1", rows=100)
    return A.read_npz(spark, path, "vectors", "1").groupBy("label").agg(F.count("*").alias("n"), r6(F.sum(V.norm(V.doubles("vector"))), "norms"))


# ---- front and back paths: 8 flow steps of 4 coordinates each


def paths(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    path = lambda start, width: F.array(*[F.slice("v", start + 4 * t, width) for t in range(8)])
    return v.select("vec_id", "label", path(1, 4).alias("front"), path(33, 4).alias("back"), path(33, 2).alias("narrow"))


#: One row for each vector, flow step and coordinate: values f and b, their changes, and changes of changes.
TALL = """t0 AS (SELECT vec_id, j // 4 AS t, j % 4 AS j, embedding[j + 1]::DOUBLE AS f, embedding[j + 33]::DOUBLE AS b FROM embeddings, range(32) r(j)),
t1 AS (SELECT *, f - lag(f) OVER w AS fv, b - lag(b) OVER w AS bv FROM t0 WINDOW w AS (PARTITION BY vec_id, j ORDER BY t)),
t2 AS (SELECT *, bv - fv AS gv, fv - lag(fv) OVER w AS fa, bv - lag(bv) OVER w AS ba, lead(bv, 1) OVER w AS bp1, lead(bv, 2) OVER w AS bp2, lag(bv, 1) OVER w AS bm1, lag(bv, 2) OVER w AS bm2 FROM t1 WINDOW w AS (PARTITION BY vec_id, j ORDER BY t))"""


def cos_sql(a: str, b: str, where: str = "true") -> str:
    dot, size = f"sum({a} * {b}) FILTER ({where})", f"(sqrt(sum({a} * {a}) FILTER ({where})) * sqrt(sum({b} * {b}) FILTER ({where})))"
    return f"CASE WHEN {size} > 1e-8 THEN least(greatest({dot} / {size}, -1), 1) WHEN {size} IS NOT NULL THEN 0 END"


#: One row for each vector and flow step.
STEPS = f"""{TALL}, st AS (SELECT vec_id, t, sqrt(sum((b - f) * (b - f))) AS gap, sqrt(sum(fv * fv)) AS fs, sqrt(sum(bv * bv)) AS bs, sqrt(sum(gv * gv)) AS gs, sqrt(sum((ba - fa) * (ba - fa))) AS gg,
sqrt(sum(f * f)) AS fn, sqrt(sum(b * b)) AS bn, {cos_sql('f', 'b')} AS al, {cos_sql('fv', 'bv')} AS va, {cos_sql('fv', 'bp1', 'bp1 IS NOT NULL')} AS p1, {cos_sql('fv', 'bp2', 'bp2 IS NOT NULL')} AS p2, {cos_sql('fv', 'bm1', 'bm1 IS NOT NULL')} AS m1, {cos_sql('fv', 'bm2', 'bm2 IS NOT NULL')} AS m2,
sqrt(sum(bv * bv) FILTER (j < 2)) AS ns, sqrt(sum(ba * ba) FILTER (j < 2)) AS ng, sqrt(sum(fa * fa)) AS fg FROM t2 GROUP BY vec_id, t)"""


def lr(a: str, b: str) -> str:
    return f"ln((({a}) + 1e-8) / (({b}) + 1e-8))"


def early_sql(x: str) -> str:
    return f"avg({x}) FILTER (t BETWEEN 1 AND 3)"


def late_sql(x: str) -> str:
    return f"avg({x}) FILTER (t BETWEEN 5 AND 7)"


def centre_sql(x: str) -> str:
    return f"(sum({x} * (t - 0.5)) / 7 / greatest(sum({x}), 1e-8))"


def at_sql(x: str, t: int) -> str:
    return f"max({x}) FILTER (t = {t})"


FLOW = {
    "gap_initial": at_sql("gap", 0), "gap_terminal": at_sql("gap", 7), "gap_log_ratio": lr(at_sql("gap", 7), at_sql("gap", 0)), "gap_path": "sum(gs)", "gap_endpoint": "max(ge)", "gap_efficiency": "max(ge) / greatest(sum(gs), 1e-8)",
    "gap_curvature": "avg(gg)", "gap_settling_log_ratio": lr(late_sql("gs"), early_sql("gs")), "front_path": "sum(fs)", "back_path": "sum(bs)", "back_front_path_log_ratio": lr("sum(bs)", "sum(fs)"),
    "back_front_early_log_ratio": lr(early_sql("bs"), early_sql("fs")), "back_front_late_log_ratio": lr(late_sql("bs"), late_sql("fs")), "velocity_alignment_mean": "avg(va)", "velocity_alignment_early": early_sql("va"), "velocity_alignment_late": late_sql("va"),
    "velocity_opposition_fraction": "avg((va < 0)::INTEGER) FILTER (t > 0)", "mixed_velocity": "avg(gs)", "front_time_center": centre_sql("fs"), "back_time_center": centre_sql("bs"), "handoff_delay": f"{centre_sql('bs')} - {centre_sql('fs')}",
    "initial_alignment": at_sql("al", 0), "terminal_alignment": at_sql("al", 7), "alignment_change": f"{at_sql('al', 7)} - {at_sql('al', 0)}", "front_terminal_norm": at_sql("fn", 7), "back_terminal_norm": at_sql("bn", 7), "terminal_norm_log_ratio": lr(at_sql("bn", 7), at_sql("fn", 7)),
    "front_settling_log_ratio": lr(late_sql("fs"), early_sql("fs")), "back_settling_log_ratio": lr(late_sql("bs"), early_sql("bs")), "settling_difference": f"{lr(late_sql('bs'), early_sql('bs'))} - {lr(late_sql('fs'), early_sql('fs'))}",
    "lag_alignment_m2": "avg(m2)", "lag_alignment_m1": "avg(m1)", "lag_alignment_p1": "avg(p1)", "lag_alignment_p2": "avg(p2)",
}


@register("flow_transfer", f"WITH {STEPS}, en AS (SELECT vec_id, sqrt(sum(g * g)) AS ge FROM (SELECT vec_id, j, sum(gv) AS g FROM t2 GROUP BY vec_id, j) GROUP BY vec_id) SELECT vec_id, {', '.join(s6(x, n) for n, x in FLOW.items())} FROM st JOIN en USING (vec_id) GROUP BY vec_id")
def flow_transfer(spark, d):
    return T.flow(paths(spark, d).select("vec_id", "front", "back")).select("vec_id", *[r6(n, n) for n in FLOW])


CHANNEL = {
    "source_path": "sum(fs)", "target_path": "sum(ns)", "target_source_path_log_ratio": lr("sum(ns)", "sum(fs)"), "target_source_early_log_ratio": lr(early_sql("ns"), early_sql("fs")), "target_source_late_log_ratio": lr(late_sql("ns"), late_sql("fs")),
    "source_settling_log_ratio": lr(late_sql("fs"), early_sql("fs")), "target_settling_log_ratio": lr(late_sql("ns"), early_sql("ns")), "settling_difference": f"{lr(late_sql('ns'), early_sql('ns'))} - {lr(late_sql('fs'), early_sql('fs'))}",
    "source_time_center": centre_sql("fs"), "target_time_center": centre_sql("ns"), "handoff_delay": f"{centre_sql('ns')} - {centre_sql('fs')}", "speed_correlation": "corr(fs, ns)",
    "speed_lag_correlation_m2": "corr(fs, n_m2)", "speed_lag_correlation_m1": "corr(fs, n_m1)", "speed_lag_correlation_p1": "corr(fs, n_p1)", "speed_lag_correlation_p2": "corr(fs, n_p2)",
    "source_roughness": "sum(fg) / greatest(sum(fs), 1e-8)", "target_roughness": "sum(ng) / greatest(sum(ns), 1e-8)", "roughness_difference": "sum(ng) / greatest(sum(ns), 1e-8) - sum(fg) / greatest(sum(fs), 1e-8)",
}


@register("channel_transfer", f"WITH {STEPS}, sh AS (SELECT *, lag(ns, 2) OVER w AS n_m2, lag(ns, 1) OVER w AS n_m1, lead(ns, 1) OVER w AS n_p1, lead(ns, 2) OVER w AS n_p2 FROM st WINDOW w AS (PARTITION BY vec_id ORDER BY t)) SELECT vec_id, {', '.join(s6(x, n) for n, x in CHANNEL.items())} FROM sh GROUP BY vec_id")
def channel_transfer(spark, d):
    return T.channel(paths(spark, d).select("vec_id", "front", F.col("narrow").alias("back"))).select("vec_id", *[r6(n, n) for n in CHANNEL])


#: The last points along episodes (ranges of ids of a label): values and their lags by coordinate, then one row for each step.
ALONG = f"""l0 AS (SELECT vec_id, (label * 1000000 + vec_id // {RANGE})::BIGINT AS ep, embedding FROM embeddings),
l1 AS (SELECT *, (row_number() OVER (PARTITION BY ep ORDER BY vec_id) - 1)::INTEGER AS q FROM l0),
l2 AS (SELECT ep, q, j, embedding[28 + j + 1]::DOUBLE AS f, embedding[60 + j + 1]::DOUBLE AS b FROM l1, range(4) r(j)),
l3 AS (SELECT *, b - f AS g FROM l2)"""


def lags_sql(*names: str) -> str:
    return ", ".join(f"lag({x}, {k}) OVER w AS {x}{k}" for x in names for k in (1, 2, 3, 4))


def rooted(x: str, where: str = "") -> str:
    return f"sqrt(sum(({x}) * ({x})){where})"


def home_sql(x: str) -> str:
    return f"CASE WHEN max(q) >= 4 THEN {rooted(f'{x} - {x}1')} - least({', '.join(rooted(f'{x} - {x}{k}') for k in (2, 3, 4))}) END"


PAIR = {"front_d1": rooted("f - f1"), "back_d1": rooted("b - b1"), "gap_d1": rooted("g - g1"), "response_log_ratio": lr(rooted("b - b1"), rooted("f - f1")), "velocity_alignment": cos_sql("(f - f1)", "(b - b1)"), "parallel_gain": "sum((f - f1) * (b - b1)) / (sum((f - f1) * (f - f1)) + 1e-8)"}
PAIR |= {f"{n}_acceleration": rooted(f"{x} - 2 * {x}1 + {x}2") for n, x in (("front", "f"), ("back", "b"), ("gap", "g"))}
PAIR |= {"acceleration_log_ratio": lr(PAIR["back_acceleration"], PAIR["front_acceleration"]), "gap_jerk": rooted("g - 3 * g1 + 3 * g2 - g3")}
PAIR |= {f"{n}_lag4": rooted(f"{x} - {x}4") for n, x in (("front", "f"), ("back", "b"), ("gap", "g"))}
PAIR |= {"lag4_log_ratio": lr(PAIR["back_lag4"], PAIR["front_lag4"])} | {f"{n}_return_advantage": home_sql(x) for n, x in (("front", "f"), ("back", "b"), ("gap", "g"))}
PAIR |= {"return_difference": f"({PAIR['back_return_advantage']}) - ({PAIR['front_return_advantage']})"}
PAIR |= {f"{n}_turn_instability": f"1 - ({cos_sql(f'({x} - {x}1)', f'({x}1 - {x}2)')})" for n, x in (("front", "f"), ("back", "b"), ("gap", "g"))}
PAIR |= {"turn_difference": f"({PAIR['back_turn_instability']}) - ({PAIR['front_turn_instability']})"}


def along(spark, d):
    from ..operators.windows import local_query

    p = paths(spark, d).select(((F.col("label") * 1_000_000) + F.floor(F.col("vec_id") / RANGE)).cast("long").alias("ep"), "vec_id", F.element_at("front", -1).alias("front"), F.element_at("back", -1).alias("back"))
    return local_query(p, "ep", "vec_id").select("ep", "q", "front", "back")


@register("query_transfer", f"WITH {ALONG}, l4 AS (SELECT *, {lags_sql('f', 'b', 'g')} FROM l3 WINDOW w AS (PARTITION BY ep, j ORDER BY q)) SELECT ep, q, {', '.join(s6(x, n) for n, x in PAIR.items())} FROM l4 GROUP BY ep, q")
def query_transfer(spark, d):
    return T.pair(along(spark, d), S, "front", "back").select("ep", "q", *[r6(n, n) for n in PAIR])


CHANNEL_STEPS = {"source_d1": "s1", "target_d1": "t1", "target_source_d1_log_ratio": lr("t1", "s1"), "source_acceleration": "s2", "target_acceleration": "t2", "target_source_acceleration_log_ratio": lr("t2", "s2"), "source_lag4": "s4", "target_lag4": "t4", "target_source_lag4_log_ratio": lr("t4", "s4")}
CHANNEL_STEPS |= {"recent_speed_correlation": "CASE WHEN count(s1) OVER w = 4 THEN coalesce(corr(s1, t1) OVER w, 0) END"}


@register("query_channel_transfer", f"WITH {ALONG}, l4 AS (SELECT *, {lags_sql('f', 'b')} FROM l3 WINDOW w AS (PARTITION BY ep, j ORDER BY q)), c AS (SELECT ep, q, {rooted('f - f1')} AS s1, {rooted('b - b1')} AS t1, {rooted('f - 2 * f1 + f2')} AS s2, {rooted('b - 2 * b1 + b2')} AS t2, {rooted('f - f4')} AS s4, {rooted('b - b4')} AS t4 FROM l4 GROUP BY ep, q) SELECT ep, q, {', '.join(s6(x, n) for n, x in CHANNEL_STEPS.items())} FROM c WINDOW w AS (PARTITION BY ep ORDER BY q ROWS 3 PRECEDING)")
def query_channel_transfer(spark, d):
    return T.channel_steps(along(spark, d), S, "front", "back").select("ep", "q", *[r6(n, n) for n in CHANNEL_STEPS])


SCALAR = {"d1": "abs(x - x1)", "acceleration": "abs(x - 2 * x1 + x2)", "jerk": "abs(x - 3 * x1 + 3 * x2 - x3)", "lag4": "abs(x - x4)", "return_advantage": "CASE WHEN x4 IS NOT NULL THEN abs(x - x1) - least(abs(x - x2), abs(x - x3), abs(x - x4)) END", "turn_instability": "1 - CASE WHEN abs((x - x1) * (x1 - x2)) > 1e-8 THEN sign((x - x1) * (x1 - x2)) WHEN x2 IS NOT NULL THEN 1 END"}


@register("query_scalar_transfer", f"WITH {ALONG}, c AS (SELECT ep, q, sqrt(sum(g * g)) AS x FROM l3 GROUP BY ep, q), l AS (SELECT *, {lags_sql('x')} FROM c WINDOW w AS (PARTITION BY ep ORDER BY q)) SELECT ep, q, {', '.join(s6(x, n) for n, x in SCALAR.items())} FROM l")
def query_scalar_transfer(spark, d):
    p = along(spark, d).select("ep", "q", V.euclidean("back", "front").alias("x"))
    return T.scalar_steps(p, S, "x").select("ep", "q", *[r6(n, n) for n in SCALAR])


# ---- the graph of a site: two tokens of 32 experts

EIGEN = "(tr + {s} * sqrt(greatest(tr * tr - 4 * de, 0))) / 2"
GRAPH = f"""s0 AS (SELECT vec_id, j // 32 AS u, j % 32 AS e, abs(embedding[j + 1]::DOUBLE) AS x FROM embeddings, range(64) t(j)),
s1 AS MATERIALIZED (SELECT vec_id, u, e, x / greatest(sum(x) OVER (PARTITION BY vec_id, u), 1e-12) AS p, row_number() OVER (PARTITION BY vec_id, u ORDER BY x DESC, e) AS k FROM s0),
tk AS (SELECT vec_id, u, -sum(p * ln(greatest(p, 1e-12))) AS h, max(p) AS t1, sum(p) FILTER (k <= 4) AS t4, sum(p) FILTER (k = 1) - sum(p) FILTER (k = 2) AS m FROM s1 GROUP BY ALL),
ta AS (SELECT vec_id, avg(h) / ln(32) AS h, avg(t1) AS t1, avg(t4) AS t4, avg(m) AS m FROM tk GROUP BY vec_id),
pr AS (SELECT a.vec_id, sum(least(a.p, b.p)) / greatest(sum(greatest(a.p, b.p)), 1e-12) AS wj, sqrt(least(greatest(1 - sum(sqrt(a.p * b.p)), 0), 1)) AS di, sum(a.p * a.p) + sum(b.p * b.p) AS tr, sum(a.p * a.p) * sum(b.p * b.p) - sum(a.p * b.p) * sum(a.p * b.p) AS de,
  -sum((a.p + b.p) / 2 * ln(greatest((a.p + b.p) / 2, 1e-12))) / ln(32) AS hm FROM s1 a JOIN s1 b ON a.vec_id = b.vec_id AND a.e = b.e AND a.u = 0 AND b.u = 1 GROUP BY a.vec_id),
sv AS (SELECT *, sqrt({EIGEN.format(s='1')}) AS v1, sqrt(greatest({EIGEN.format(s='-1')}, 0)) AS v2 FROM pr),
oc AS (SELECT vec_id, max(n) / 8.0 AS mo, -sum(n / 8.0 * ln(n / 8.0)) / ln(32) AS ho, count(*) / 32.0 AS un FROM (SELECT vec_id, e, count(*) AS n FROM s1 WHERE k <= 4 GROUP BY ALL) GROUP BY vec_id)"""
AXES = {
    "commitment": "1 - h", "entropy": "h", "top1_mass": "t1", "top4_mass": "t4", "top12_margin": "m", "consensus": "wj", "dispersion": "di", "effective_rank": "exp(-(v1 / (v1 + v2) * ln(greatest(v1 / (v1 + v2), 1e-12)) + v2 / (v1 + v2) * ln(greatest(v2 / (v1 + v2), 1e-12))))",
    "stable_rank": "(v1 * v1 + v2 * v2) / (v1 * v1)", "mutual_information": "hm - h", "top_occupancy": "mo", "occupancy_entropy": "ho", "support_union": "un",
}


@register("graph_block", f"WITH {GRAPH} SELECT vec_id, {', '.join(s6(x, n) for n, x in AXES.items())} FROM ta JOIN sv USING (vec_id) JOIN oc USING (vec_id)")
def graph_block(spark, d):
    """The 13 axes of each vector read as two tokens of 32 experts."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("site"))
    return R.graph_block(e, "vec_id", "site", 2, 32).select("vec_id", *[r6(n, n) for n in R.AXES])
