import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def streamed(spark, tmp_path):
    """Rows, as text, that a stateful plan gives over steps that come in five micro-batches of unequal numbers of steps."""

    def run(df, plan):
        from pyspark.sql import functions as F

        for k, (low, high) in enumerate([(0, 1), (1, 4), (4, 11), (11, 12), (12, 10_000)]):
            df.where((F.col("q") >= low) & (F.col("q") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={k}"))
        seen, key = [], "spark.sql.streaming.stateStore.providerClass"
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            source = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = plan(source).writeStream.outputMode("update").foreachBatch(lambda rows, _: seen.extend(map(str, rows.collect())))
            query = out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            assert query.awaitTermination(300) and len(query.recentProgress) >= 5
        finally:
            spark.conf.unset(key)
        return sorted(seen)

    return run
