"""Queries of the models and of exact tests; those without SQL are tested against direct computations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import models as M
from ..operators import stats as A
from ..runtime import ship
from .common import BY, EV, embeddings, events, r6, table


@register("effective_rank")
def effective_rank(spark, d):
    r = M.group_ranks(embeddings(spark, d), "label", "v")
    return r.select("label", "n", r6("effective", "effective"), r6("stable", "stable"))


@register("mahalanobis_density")
def mahalanobis_density(spark, d):
    return M.mahalanobis(embeddings(spark, d), "vec_id", "v").select("vec_id", r6("distance", "distance"))


@register("pca_whitening")
def pca_whitening(spark, d):
    e = embeddings(spark, d)
    mean, w, _ = M.principal_components(e, "v")
    from ..functions import vectors as V

    parts = [r6(V.dot("v", F.array(*[F.lit(float(x)) for x in w[:, k]])) - float(mean @ w[:, k]), "c") for k in range(w.shape[1])]
    return e.select("vec_id", F.array(*parts).alias("components")).select("vec_id", F.col("components")[0].alias("first_component"), "components")


#: The three normal equations of a ridge on two lags, solved by determinants.
_N = {f"a{i}{j}": f"sum(c{i} * c{j}) + {20 if i == j and i else 0}" for i in range(3) for j in range(3)} | {f"y{i}": f"sum(c{i} * y)" for i in range(3)}
_DET = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
_SWAP = lambda k: [f"y{i}" if j == k else f"a{i}{j}" for i in range(3) for j in range(3)]
RIDGE = f"WITH {EV}, l AS (SELECT 1.0 AS c0, lag(x, 1) {BY} AS c1, lag(x, 2) {BY} AS c2, x AS y FROM ev), n AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _N.items())} FROM l WHERE c2 IS NOT NULL)"


@register("ridge_autoregression", RIDGE + " " + " UNION ALL ".join(f"SELECT {k} AS lag, round({_DET(_SWAP(k))} / {_DET(_SWAP(-1))}, 6) AS coefficient FROM n" for k in range(3)))
def ridge_autoregression(spark, d):
    c = M.ridge_var(events(spark, d), "ep", "q", "x", 2, 20.0)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(c)], "lag int, coefficient double")


@register("dtw_template_match")
def dtw_template_match(spark, d):
    return M.template_match(events(spark, d), "ep", "q", "x", [10.0, 20.0, 40.0, 80.0, 40.0, 20.0, 10.0]).select("ep", r6("distance", "distance"))


@register("hsmm_filter")
def hsmm_filter(spark, d):
    names = ["click", "error", "purchase", "signup", "view"]
    leave = np.vstack([np.linspace(0.1, 0.6, 12), np.linspace(0.4, 0.9, 12)])
    f = M.duration_filter(events(spark, d), "ep", "q", "k", names, [[0, 1], [1, 0]], [[0.3, 0.05, 0.15, 0.1, 0.4], [0.1, 0.6, 0.1, 0.1, 0.1]], leave)
    return f.select("ep", "state", r6("age", "age"), r6("evidence", "evidence"), "forecast")


@register("compressed_length")
def compressed_length(spark, d):
    return M.compressed_length(embeddings(spark, d), "vec_id", "p").select("vec_id", r6("ratio", "ratio"))


@register("kernel_ridge_loco")
def kernel_ridge_loco(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 4).alias("fold"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 7).alias("y"))
    return M.kernel_ridge_loco(c, "c_nationkey", "fold", "x", "y").select("c_nationkey", "fold", r6("x", "x"), "y", r6("predicted", "predicted"))


@register("clopper_pearson_interval")
def clopper_pearson_interval(spark, d):
    ship(spark)
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("ep")).agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count("*").alias("n"))

    @F.pandas_udf("struct<lo double, hi double>")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([A.clopper_pearson(int(a), int(b)) for a, b in zip(k, n)], columns=["lo", "hi"])

    return c.withColumn("i", interval("k", "n")).select("ep", r6("i.lo", "lo"), r6("i.hi", "hi"))


@register("fisher_exact")
def fisher_exact(spark, d):
    ship(spark)
    c = table(spark, d, "orders").groupBy("o_orderpriority").agg(*[F.count_if((F.col("o_orderstatus") == s) & ((F.col("o_totalprice") > 100000) == big)).alias(n) for n, s, big in (("a", "F", True), ("b", "F", False), ("c", "O", True), ("e", "O", False))])

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([A.fisher_exact(*map(int, t)) for t in zip(a, b, c, e)])

    return c.select("o_orderpriority", r6(p("a", "b", "c", "e"), "p"))
