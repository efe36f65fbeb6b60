"""Micro-batches with exactly-once keys, on Structured Streaming.

Resuming over files is a stream: here one of pair files is read with availableNow, and each
micro-batch is appended once, by key, however often it is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "source_index long, query string, positive string"


def once_by_key(batch: DataFrame, done: DataFrame, key: str = "source_index") -> DataFrame:
    """Rows whose key is not in done, one per key: the least as a whole."""
    rest = [c for c in batch.columns if c != key]
    one = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return one.join(done.select(key), key, "left_anti")


def ingest(spark: SparkSession, source: str, output: str, checkpoint: str, schema: str = PAIRS, max_files: int = 50) -> None:
    """Appends the new rows of the Parquet files under source to output, in micro-batches of max_files, then stops."""

    def write(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        at = own._jvm.org.apache.hadoop.fs.Path(output)
        there = at.getFileSystem(own._jsc.hadoopConfiguration()).exists(at)
        done = own.read.schema(schema).parquet(output) if there else own.createDataFrame([], schema)
        once_by_key(batch, done).write.mode("append").parquet(output)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
