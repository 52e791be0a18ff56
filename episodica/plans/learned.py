"""Queries of fitted models whose passes are aggregates: folds of logistic regressions and diagonal mixtures."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import logistic as L
from ..operators import mixture as X
from .common import r6, s6, table

# ---- logistic regression, one nation left out at a time

CUSTOMERS = """x AS (SELECT c_custkey, c_nationkey AS g, c_acctbal AS f1, count(o_orderkey)::DOUBLE AS f2, (coalesce(max(o_totalprice), 0) > 400000)::INTEGER AS y
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def customers(spark, d):
    """Balance and number of orders of each customer, and whether one of the orders was large."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("f1"), F.coalesce("n", F.lit(0)).cast("double").alias("f2"), (F.coalesce("most", F.lit(0.0)) > 400000).cast("int").alias("y"))


def newton_sql(steps: int, balanced: bool) -> str:
    """DuckDB SQL: unrolled Newton steps of every fold, three weights each."""
    cost = "CASE WHEN y = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END" if balanced else "1.0"
    rest = lambda c: f"(sum({c}) OVER () - {c})"
    parts = [
        CUSTOMERS,
        "gm AS (SELECT g, count(*) AS n, sum(y) AS p, sum(f1) AS s1, sum(f2) AS s2, sum(f1 * f1) AS q1, sum(f2 * f2) AS q2 FROM x GROUP BY g)",
        f"go AS (SELECT g, {', '.join(f'{rest(c)} AS {c}' for c in ('n', 'p', 's1', 's2', 'q1', 'q2'))} FROM gm)",
        "fo AS (SELECT g, n, p, s1 / n AS m1, s2 / n AS m2, sqrt(q1 / n - (s1 / n) * (s1 / n)) AS d1, sqrt(q2 / n - (s2 / n) * (s2 / n)) AS d2 FROM go)",
        f"tr AS MATERIALIZED (SELECT fo.g, 1.0 AS z0, (f1 - m1) / d1 AS z1, (f2 - m2) / d2 AS z2, y, {cost} AS c FROM fo JOIN x ON x.g <> fo.g)",
        "w0 AS (SELECT g, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM fo)",
    ]
    for t in range(steps):
        grad = ", ".join(f"sum(c * (r - y) * z{i}) + {'0' if i == 0 else f'any_value(b{i})'} AS e{i}" for i in range(3))
        bend = ", ".join(f"sum(c * r * (1 - r) * z{i} * z{j}) + {1 if i == j and i else 0} AS h{i}{j}" for i, j in product(range(3), repeat=2))
        det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
        full = [f"h{i}{j}" for i, j in product(range(3), repeat=2)]
        swap = lambda col: [f"e{i}" if j == col else f"h{i}{j}" for i, j in product(range(3), repeat=2)]
        parts.append(f"s{t} AS (SELECT g, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {grad}, {bend} FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS r FROM tr JOIN w{t} USING (g)) GROUP BY g)")
        parts.append(f"w{t + 1} AS MATERIALIZED (SELECT g, {', '.join(f'b{i} - {det(swap(i))} / {det(full)} AS b{i}' for i in range(3))} FROM s{t})")
    return f"WITH {', '.join(parts)} SELECT c_custkey, g, y, {s6('1 / (1 + exp(-(b0 + b1 * (f1 - m1) / d1 + b2 * (f2 - m2) / d2)))', 'probability')} FROM x JOIN fo USING (g) JOIN w{steps} USING (g)"


@register("logistic_out_of_fold", newton_sql(9, balanced=False))
def logistic_out_of_fold(spark, d):
    """Chance of a large order from a fit to all other nations."""
    return L.out_of_fold(customers(spark, d), "g", "y", ["f1", "f2"], single=0.5).select("c_custkey", "g", "y", r6("probability", "probability"))


@register("balanced_logistic_out_of_fold", newton_sql(9, balanced=True))
def balanced_logistic_out_of_fold(spark, d):
    """The same with classes weighted against their sizes."""
    return L.out_of_fold(customers(spark, d), "g", "y", ["f1", "f2"], balanced=True).select("c_custkey", "g", "y", r6("probability", "probability"))


# ---- diagonal mixtures

DIMS, WORDS, SEED, ROUNDS = 4, 3, 5, 6


def short_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.slice(F.transform("embedding", lambda x: x.cast("double") * 8), 1, DIMS).alias("v"))


def mixture_sql() -> str:
    """DuckDB SQL: hashed k-means++ draws, unrolled EM, and the words."""
    vs = [f"v{j}" for j in range(DIMS)]
    hexed = lambda h: " + ".join(f"(strpos('0123456789abcdef', substr({h}, {i + 1}, 1)) - 1) * {16 ** (7 - i)}.0" for i in range(8))
    parts = [f"x AS MATERIALIZED (SELECT vec_id, {', '.join(f'embedding[{j + 1}]::DOUBLE * 8 AS v{j}' for j in range(DIMS))} FROM embeddings)"]
    for k in range(WORDS):
        u = f"(({hexed(f'''md5('{SEED}:{k}:' || vec_id)''')}) + 0.5) / 4294967296.0"
        rate = ", ".join(f"(SELECT {' + '.join(f'(x.{v} - c.{v}) * (x.{v} - c.{v})' for v in vs)} FROM c{i} c)" for i in range(k))
        clock = f"-ln({u}) / nullif(least({rate}), 0)" if k else u
        parts.append(f"c{k} AS MATERIALIZED (SELECT {k} AS k, {', '.join(vs)} FROM (SELECT *, {clock} AS t FROM x) WHERE t IS NOT NULL ORDER BY t, vec_id LIMIT 1)")
    parts.append(f"al AS (SELECT {', '.join(f'avg({v} * {v}) - avg({v}) * avg({v}) + 1e-4 AS s{j}' for j, v in enumerate(vs))} FROM x)")
    parts.append(f"m0 AS MATERIALIZED (SELECT k, 1.0 / {WORDS} AS w, {', '.join(f'{v} AS u{j}, s{j}' for j, v in enumerate(vs))} FROM ({' UNION ALL '.join(f'SELECT * FROM c{k}' for k in range(WORDS))}), al)")

    def joint(t: int) -> str:
        own = " + ".join(f"(v{j} - u{j}) * (v{j} - u{j}) / s{j} + ln(s{j})" for j in range(DIMS))
        return f"j{t} AS MATERIALIZED (SELECT *, own + ln(greatest(w, 1e-300)) AS bo, max(own + ln(greatest(w, 1e-300))) OVER (PARTITION BY vec_id) AS top FROM (SELECT *, -0.5 * ({DIMS} * ln(2 * pi()) + {own}) AS own FROM x, m{t})), l{t} AS MATERIALIZED (SELECT *, top + ln(sum(exp(bo - top)) OVER (PARTITION BY vec_id)) AS lex FROM j{t})"

    for t in range(ROUNDS):
        parts.append(joint(t))
        mean = lambda j: f"sum(exp(bo - lex) * v{j}) / sum(exp(bo - lex))"
        parts.append(f"m{t + 1} AS MATERIALIZED (SELECT k, sum(exp(bo - lex)) / (SELECT count(*) FROM x) AS w, {', '.join(f'{mean(j)} AS u{j}, sum(exp(bo - lex) * v{j} * v{j}) / sum(exp(bo - lex)) - {mean(j)} * {mean(j)} + 1e-4 AS s{j}' for j in range(DIMS))} FROM l{t} GROUP BY k)")
    parts.append(joint(ROUNDS))
    parts.append(f"tk AS (SELECT vec_id, arg_max(k, bo)::INTEGER AS word, list(own ORDER BY k) AS component, max(lex) AS lexical FROM l{ROUNDS} GROUP BY vec_id)")
    return f"WITH {', '.join(parts)}"


def tokens(spark, d):
    v = short_vectors(spark, d)
    return X.tokenise(v, "vec_id", "v", X.fit(v, "vec_id", "v", DIMS, WORDS, SEED, rounds=ROUNDS, tolerance=0.0))


@register("mixture_tokens", f"{mixture_sql()} SELECT vec_id, word, [round(c + 1e-9, 6) + 0.0 FOR c IN component] AS component, {s6('lexical', 'lexical')} FROM tk")
def mixture_tokens(spark, d):
    return tokens(spark, d).select("vec_id", "word", F.transform("component", lambda c: F.round(c + F.lit(1e-9), 6) + F.lit(0.0)).alias("component"), r6("lexical", "lexical"))


@register("mixture_vocabulary", f"{mixture_sql()}, n AS (SELECT k::INTEGER AS word, count(tk.word) AS n FROM range({WORDS}) t(k) LEFT JOIN tk ON tk.word = k GROUP BY k), s AS (SELECT *, n / sum(n) OVER () AS share FROM n) SELECT word, n, {s6('share', 'share')}, {s6('(SELECT -avg(lexical) FROM tk)', 'mean_nll')}, {s6('(SELECT exp(-sum(CASE WHEN n > 0 THEN share * ln(share) ELSE 0 END)) FROM s)', 'effective_words')} FROM s")
def mixture_vocabulary(spark, d):
    return X.vocabulary_use(tokens(spark, d), WORDS).select("word", "n", r6("share", "share"), r6("mean_nll", "mean_nll"), r6("effective_words", "effective_words"))
