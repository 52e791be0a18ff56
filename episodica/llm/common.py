"""Shared plumbing of the training-data operators: scans, shared storage, schemas."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: Words of the text contracts: everything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only; every other character stays as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Ready the session for Python on executors; rows: of an Arrow batch, which is held whole, and texts are long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="episodica-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/episodica/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition: str, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives lost executors.

    narrow: rows of a few numbers, which four waves of tasks hold in as many files; more would cost the store more than
    their rows do.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    schema = df.schema
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition) if partition else out).parquet(path)
    found = spark.read.schema(schema).parquet(path)
    found.written_to = path
    return found


def removed(*tables: DataFrame) -> None:
    """Delete tables that written made, which no result reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rid(docs: DataFrame, name: str) -> DataFrame:
    """docs, written once to the shared folder with a number for each row, so that every later scan gives the same numbers."""
    return written(docs.select("*", F.monotonically_increasing_id().alias(name)), "rows")


def crc_of(col: str) -> Column:
    """crc32 of the id's decimal text, as the held-out splits define it (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def replaced(batch, column: str, values: list):
    """The record batch with one column's values replaced."""
    import pyarrow as pa

    at = batch.schema.get_field_index(column)
    return batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))


def with_length(df: DataFrame, text_col: str, length_col: str = "n_chars") -> DataFrame:
    """Set the length column anew, where there is one, after the text has changed."""
    if length_col not in df.columns:
        return df
    return df.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
