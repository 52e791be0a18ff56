"""Inputs of the queries, and the SQL that builds the same inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.windows import Series, local_query

S = Series("ep", "q")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Event log as episodes: one user is one episode."""
    e = table(spark, d, "events").select(F.col("user_id").alias("ep"), "ts", "event_id", F.col("value").alias("x"), F.col("event_type").alias("k"))
    return local_query(e, "ep", "ts", "event_id").select("ep", "q", "x", "k", "event_id", "ts")


EV = "ev AS (SELECT user_id AS ep, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS q, value AS x, event_type AS k, event_id, ts FROM events)"


def over(n: int | None = None, end: str = "CURRENT ROW") -> str:
    """SQL frame over an episode: the last n rows, or all so far."""
    start = "UNBOUNDED PRECEDING" if n is None else f"{n - 1} PRECEDING"
    return f"OVER (PARTITION BY ep ORDER BY q ROWS BETWEEN {start} AND {end})"


BY = "OVER (PARTITION BY ep ORDER BY q)"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as vectors v (signed) and p (a distribution), with the four largest entries as stored support."""
    e = table(spark, d, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("v"))
    e = e.withColumn("p", V.normalised(F.transform("v", F.abs)))
    return e.withColumn("ids", V.top_ids("p", 4)).withColumn("w", F.transform("ids", lambda i: F.element_at("p", i + 1)))


#: Ids of a label that form one episode: so many at most, and episodes grow with the table.
RANGE = 250


def episodes(e: DataFrame) -> DataFrame:
    """Embeddings whose label is an episode's key: the label with the range of the id."""
    return e.withColumn("label", (F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / RANGE)).cast("long"))


def at_least(steps: DataFrame, q: int) -> DataFrame:
    """Steps of the episodes that have a step q; an episode has RANGE steps at most."""
    last = F.max("q").over(Window.partitionBy("ep"))
    return steps.withColumn("_last", last).where(F.col("_last") >= q).drop("_last")


#: Ids of a label that one task puts in order, where a whole label is one path.
BLOCK = 25_000


def in_order(e: DataFrame, x: str) -> DataFrame:
    """(vec_id, label, x, x1, x2, xn): a column with those of the one and two rows before and of the row after, in order of id in the whole label.

    Rows are ordered within blocks of ids. What lies beyond a block is found among the rows at the blocks' ends alone, in
    order of the label: three at either end, of which the first two and the last are read there.
    """
    place = lambda w: {"x1": F.lag("x", 1).over(w), "x2": F.lag("x", 2).over(w), "xn": F.lead("x", 1).over(w)}
    own = Window.partitionBy("label", "block").orderBy("vec_id")
    rows = e.select("vec_id", "label", F.floor(F.col("vec_id") / BLOCK).alias("block"), F.col(x).alias("x"))
    ends = {"r": F.row_number().over(own), "last": F.lead("vec_id", 1).over(own).isNull(), "tail": F.lead("vec_id", 3).over(own).isNull()}
    rows = rows.withColumns(ends | place(own))
    edges = rows.where("r <= 3 or tail").drop("x1", "x2", "xn").withColumns(place(Window.partitionBy("label").orderBy("vec_id")))
    columns = ("vec_id", "label", "x", "x1", "x2", "xn")
    return rows.where("r > 2 and not last").select(*columns).unionByName(edges.where("r <= 2 or last").select(*columns))


def numbered_in_label(e: DataFrame) -> DataFrame:
    """e with r, the number (from 1) of each row in order of id in its label: its number in its block and the rows of the blocks before."""
    rows = e.withColumn("block", F.floor(F.col("vec_id") / BLOCK))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # over a label's blocks
    starts = rows.groupBy("label", "block").agg(F.count("*").alias("n")).select("label", "block", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("label", "block").orderBy("vec_id"))
    return rows.withColumn("own", own).join(starts, ["label", "block"]).withColumn("r", F.col("start") + F.col("own")).drop("block", "own", "start")


EM = """e0 AS (SELECT vec_id, label, list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS v FROM embeddings),
e1 AS (SELECT *, list_transform(v, lambda t: abs(t)) AS a FROM e0),
em AS (SELECT vec_id, label, v, list_transform(a, lambda t: t / greatest(list_sum(a), 1e-12)) AS p FROM e1)"""
#: Embeddings by episode, as episodes() gives them.
EP = f"{EM}, ep AS (SELECT * REPLACE ((label * 1000000 + vec_id // {RANGE})::BIGINT AS label) FROM em)"
#: Pairs of neighbours by vec_id, with support ids (from 0) and their weights.
EM2 = (
    EM
    + """,
es AS (SELECT vec_id, label, v, p, list_transform(list_grade_up(list_transform(p, lambda t: -t))[1:4], lambda i: i - 1) AS ids FROM em),
pr AS (SELECT a.vec_id, a.p AS p, b.p AS q, a.v AS v, b.v AS u, a.ids AS ia, b.ids AS ib FROM es a JOIN es b ON b.vec_id = a.vec_id + 1)"""
)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding with the next one by id."""
    e = embeddings(spark, d)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"), F.col("v").alias("u"), F.col("ids").alias("ib"), F.col("w").alias("wb"))
    return e.join(b, "vec_id")


def r6(c: Column | str, name: str) -> Column:
    """Rounded to six places, as results of different summation orders are compared; the nudge takes exact ties apart."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c + F.lit(1e-9), 6) + F.lit(0.0)).alias(name)


def s6(expr: str, name: str) -> str:
    return f"round(({expr}) + 1e-9, 6) + 0.0 AS {name}"
