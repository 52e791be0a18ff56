"""Count models of word sequences: n-grams with back-off, positions, durations; folds over ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ngram_counts(df: DataFrame, ep: str, order: list[str], word: str, depth: int) -> DataFrame:
    """(order, context, target, n) for contexts of 0 to depth words; sequences begin with ^ and end with $."""
    w = Window.partitionBy(ep).orderBy(*order)
    last = F.row_number().over(Window.partitionBy(ep).orderBy(*[F.desc(o) for o in order])) == 1
    lags = [F.coalesce(F.lag(word, k).over(w), F.lit("^")) for k in range(1, depth + 1)]
    rows = df.select(ep, F.col(word).alias("target"), last.alias("_last"), *[x.alias(f"l{k}") for k, x in enumerate(lags, 1)])
    ends = rows.where("_last").select(ep, F.lit("$").alias("target"), F.lit(False).alias("_last"), F.col("target").alias("l1"), *[F.col(f"l{k - 1}").alias(f"l{k}") for k in range(2, depth + 1)])
    both = rows.unionByName(ends)
    contexts = F.array(*[F.struct(F.lit(d).alias("order"), F.concat_ws(" ", *[F.col(f"l{k}") for k in range(d, 0, -1)]).alias("context")) for d in range(depth + 1)])
    return both.select("target", F.explode(contexts).alias("c")).groupBy("c.order", "c.context", "target").agg(F.count("*").alias("n"))


def smoothed(counts: DataFrame, vocabulary: int, alpha: float = 0.5) -> DataFrame:
    """(c + alpha) / (n + alpha V) of each context's targets."""
    n = F.sum("n").over(Window.partitionBy("order", "context"))
    return counts.withColumn("support", n).withColumn("p", (F.col("n") + alpha) / (n + alpha * vocabulary))


def backed_off(probabilities: DataFrame, least: int) -> DataFrame:
    """Probabilities of contexts with enough support; a deeper context that lacks it is answered by its shorter one."""
    return probabilities.where((F.col("support") >= least) | (F.col("order") == 0))


def sequence_score(df: DataFrame, probabilities: DataFrame, ep: str, order: list[str], word: str, depth: int, floor: float) -> DataFrame:
    """(ep, words, log probability), each word under the deepest context that the table has."""
    w = Window.partitionBy(ep).orderBy(*order)
    rows = df.select(ep, F.col(word).alias("target"), *[F.coalesce(F.lag(word, k).over(w), F.lit("^")).alias(f"l{k}") for k in range(1, depth + 1)])
    for d in range(depth + 1):
        rows = rows.withColumn(f"c{d}", F.concat_ws(" ", *[F.col(f"l{k}") for k in range(d, 0, -1)]))
        t = probabilities.where(F.col("order") == d).select(F.col("context").alias(f"c{d}"), "target", F.col("p").alias(f"p{d}"))
        rows = rows.join(t, [f"c{d}", "target"], "left")
    p = F.coalesce(*[F.col(f"p{d}") for d in range(depth, -1, -1)], F.lit(floor))
    return rows.groupBy(ep).agg(F.count("*").alias("words"), F.sum(F.ln(p)).alias("log_p"))


def position_counts(df: DataFrame, q: str, word: str, most: int) -> DataFrame:
    """Share of each word at a step (steps from `most` on together)."""
    n = df.groupBy(F.least(F.col(q), F.lit(most)).alias("position"), F.col(word).alias("target")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("position")))


def durations(df: DataFrame, ep: str, q: str, word: str) -> DataFrame:
    """(word, length, runs, hazard): run lengths, and the share of runs that end of those that came so far."""
    by = Window.partitionBy(ep).orderBy(q)
    new = F.when(F.lag(word).over(by) == F.col(word), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(ep, "_run", word).agg(F.count("*").alias("length"))
    t = runs.groupBy(word, "length").agg(F.count("*").alias("runs"))
    reach = F.sum("runs").over(Window.partitionBy(word).orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("hazard", F.col("runs") / reach)


def forward_filter(observations: Column, prior: list[float], transition: list[list[float]], emission: list[dict[str, float]], floor: float = 1e-6) -> Column:
    """Belief over hidden states after an ordered array of words, and its log evidence, as one fold."""
    n = len(prior)
    emit = [F.create_map(*[y for k, v in e.items() for y in (F.lit(k), F.lit(v))]) for e in emission]
    start = F.struct(F.array(*map(F.lit, prior)).alias("belief"), F.lit(0.0).alias("evidence"), F.lit(0).alias("seen"))

    def step(acc: Column, w: Column) -> Column:
        ahead = [sum((acc["belief"][i] * transition[i][j] for i in range(1, n)), acc["belief"][0] * transition[0][j]) for j in range(n)]
        ahead = [F.when(acc["seen"] == 0, acc["belief"][j]).otherwise(a) for j, a in enumerate(ahead)]
        joint = F.array(*[a * F.coalesce(F.try_element_at(emit[j], w), F.lit(floor)) for j, a in enumerate(ahead)])
        z = F.aggregate(joint, F.lit(0.0), lambda s, x: s + x)
        return F.struct(F.transform(joint, lambda x: x / z).alias("belief"), (acc["evidence"] + F.ln(z)).alias("evidence"), (acc["seen"] + 1).alias("seen"))

    return F.aggregate(observations, start, step)


def decode_path(observations: Column, transition: list[list[float]], emission: list[dict[str, float]], floor: float = 1e-6) -> Column:
    """Log score of the best hidden path (max-product fold)."""
    import math

    n = len(transition)
    emit = [F.create_map(*[y for k, v in e.items() for y in (F.lit(k), F.lit(math.log(v)))]) for e in emission]
    low = math.log(floor)
    start = F.array(*[F.lit(0.0)] * n)

    def step(acc: Column, w: Column) -> Column:
        return F.array(*[F.greatest(*[acc[i] + math.log(max(transition[i][j], floor)) for i in range(n)]) + F.coalesce(F.try_element_at(emit[j], w), F.lit(low)) for j in range(n)])

    return F.array_max(F.aggregate(observations, start, step))
