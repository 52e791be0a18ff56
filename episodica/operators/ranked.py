"""Order over a whole table, or over few large groups, without a single-task window: ranges, their totals, and sums within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, StringType, TimestampType

#: Ranges that an ordered pass over all rows is dealt into.
RANGES = 64


def measure(df: DataFrame, x: str) -> Column:
    """A number that rises with the column: the column itself, or the first seven bytes of a text."""
    kind = df.schema[x].dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(F.col(x).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, (DateType, TimestampType)):
        return F.col(x).cast("timestamp").cast("double")
    return F.col(x).cast("double")


def range_of(df: DataFrame, x: str, ranges: int = RANGES) -> Column:
    """Number of the value's range, NULLs in the first; the bounds (ranges - 1 literals) are approximate quantiles, read once."""
    at = measure(df, x)
    bounds = df.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], 2000)).first()[0] if ranges > 1 else None
    out = F.lit(0)
    for b in sorted(set(bounds or [])):
        out = out + F.when(at >= b, 1).otherwise(0)
    return out


def numbered(df: DataFrame, key: str, *ties: str, name: str = "row", parts: int = RANGES) -> DataFrame:
    """df with the number of each row (from 0) in the order of key and ties, which must tell rows apart."""
    rows = df.withColumn("_range", range_of(df, key, parts))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # over as many rows as ranges
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key, *ties))
    return rows.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_range", "_own", "_start")


def cumulated(df: DataFrame, x: str, *group: str, weight: Column | None = None, ranges: Column | None = None) -> DataFrame:
    """(group, x, _n, _upto, _all): for each value its weight (rows, or the sum of a column), that of it and all lower values, and the group's.

    Rows are counted by value first; each range of values adds its running sums to the totals of the ranges below it, so
    neither all rows nor a group's are one task's. ranges: what range_of gave for x, if it is known.
    """
    v = df.groupBy(*group, x).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    v = v.withColumn("_range", range_of(df, x) if ranges is None else ranges)
    totals = v.groupBy(*group, "_range").agg(F.sum("_n").alias("_t"))
    w = Window.partitionBy(*(group or [F.lit(0)]))  # a row for each group and range
    before = F.coalesce(F.sum("_t").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), before.alias("_before"), F.sum("_t").over(w).alias("_all"))
    own = F.sum("_n").over(Window.partitionBy(*group, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    match = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return v.withColumn("_own", own).join(totals, match).select(*group, x, "_n", (F.col("_own") + F.col("_before")).alias("_upto"), "_all")
