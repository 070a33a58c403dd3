"""Structured Streaming over dated posts: resumable daily work and event-aligned windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def aligned_windows(stream: DataFrame, ts: str, event: str, days: int = 7, late: str = "1 day", *keys: str, **aggs) -> DataFrame:
    """Tumbling windows of `days` days, one of which begins at the event; late rows are waited for."""
    offset = (date.fromisoformat(event) - date(1970, 1, 1)).days % days
    window = F.window(F.col(ts).cast("timestamp"), f"{days} days", startTime=f"{offset} days")
    out = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(window, *keys).agg(*(c.alias(k) for k, c in aggs.items()))
    return out.select(F.datediff(F.to_date("window.start"), F.lit(event).cast("date")).alias("_d"), *keys, *aggs).withColumn("bin", F.floor(F.col("_d") / days).cast("int")).drop("_d")


_STORE = "spark.sql.streaming.stateStore.providerClass"


def _known(spark: SparkSession, done: DataFrame, checkpoint: str, key: str) -> DataFrame:
    """The keys that others had done when this checkpoint began, read from the done table once and kept beside its state."""
    folder = f"{checkpoint.rstrip('/')}-known"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        done.select(key).distinct().write.mode("overwrite").parquet(folder)
    return spark.read.schema(done.select(key).schema).parquet(folder)


def run_available(stream: DataFrame, work: Callable[[DataFrame], DataFrame], done_path: str, out_path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Process everything available once, each key once: what repeats, in the same batch or later, goes by; of repeats one row is taken.

    The keys that a checkpoint has seen are the query's state, so a batch looks up its own keys only. The done table is what other
    checkpoints know: a new checkpoint takes it in once, as a table of its own that its batches are compared with, if there is any. Each batch
    writes its results and then its keys under its own name (the checkpoint's and its number), so a batch that runs again after
    a failure overwrites what it left instead of adding to it: keys of its own checkpoint do not come from the table.
    """
    spark, run = stream.sparkSession, hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    folder = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    done = spark.read.schema(f"{key} {stream.schema[key].dataType.simpleString()}, batch string").parquet(done_path)
    known = _known(spark, done.where(~F.col("batch").startswith(f"{run}-")), checkpoint, key)
    alone = known.isEmpty()

    def batch(df: DataFrame, number: int) -> None:
        name = f"batch={run}-{number}"
        fresh = (df if alone else df.join(known.withColumnRenamed(key, "_known"), F.col(key).eqNullSafe(F.col("_known")), "left_anti")).persist()
        try:
            work(fresh).write.mode("overwrite").parquet(f"{out_path}/{name}")
            fresh.select(key).write.mode("overwrite").parquet(f"{done_path}/{name}")
        finally:
            fresh.unpersist()

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # a query keeps the settings it starts with
    try:
        return stream.dropDuplicates([key]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
