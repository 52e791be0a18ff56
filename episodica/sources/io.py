"""Sources and sinks: typed scans, discovery, integrity, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column: aggregates and ranks then skip or guard it."""
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV (also gzip) with a header and a fixed schema."""
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    without_nan(df).write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    without_nan(df).write.mode("errorifexists").json(path)


def write_cache(df: DataFrame, root: str, config: dict) -> str:
    """Write a table under a fingerprint of its configuration, once."""
    import hashlib
    import json

    path = f"{root}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()}"
    df.write.mode("ignore").parquet(path)
    return path


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files under a root with the parts of their path that a named pattern gives as columns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    import re

    names = re.findall(r"\(\?<(\w+)>", pattern)
    plain = re.sub(r"\(\?<\w+>", "(", pattern)
    return files.where(F.col("path").rlike(plain)).select("path", "length", *[F.regexp_extract("path", plain, i + 1).alias(n) for i, n in enumerate(names)])


def complete_runs(runs: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of status complete that have all the episodes they were designed for."""
    return runs.join(manifest.where("status = 'complete' and actual = designed"), keys, "left_semi")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def table_hash(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table's rows."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def reconciled(rows: DataFrame, episodes: DataFrame, ep: str, expected: str) -> DataFrame:
    """Rows of the episodes whose number of rows is the expected one."""
    good = rows.groupBy(ep).agg(F.count("*").alias("_n")).join(episodes.select(ep, expected), ep).where(F.col("_n") == F.col(expected))
    return rows.join(good, ep, "left_semi")


def guarded(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that features may see."""
    return df.select(*columns)


def locate(rows: DataFrame, ep: str, q: str, word: str, trace: DataFrame, pos: str, traced: str) -> DataFrame:
    """(ep, start) of the consecutive rows equal to a trace of (pos, word): matches align on a constant q - pos."""
    n = trace.agg(F.count("*").alias("_len"))  # one row
    hits = rows.join(trace, rows[word] == trace[traced]).groupBy(ep, (F.col(q) - F.col(pos)).alias("start")).agg(F.count("*").alias("_n"))
    return hits.crossJoin(F.broadcast(n)).where("_n = _len").select(ep, "start")


def append_once(batch: DataFrame, path: str, key: str) -> None:
    """Idempotent append for foreachBatch: rows whose key the table has already are left out."""
    spark = batch.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
        batch = batch.join(there, key, "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    batch.write.mode("append").parquet(path)
