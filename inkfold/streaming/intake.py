"""Incremental intake, and windowed streams over events.

The intake is what the batch engine needs when documents arrive one file at a
time: rules as one select, admission as a filter, an idempotent append per
micro-batch.  The event-time windows are an addition of this engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_parquet(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder, with the schema of a table at hand; nothing is inferred.

    One file that is no folder is streamed as the only file of its folder that has its name.
    """
    folder, name = path.rstrip("/"), None
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        folder, _, name = folder.rpartition("/")
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch)
    if name is not None:
        reader = reader.option("pathGlobFilter", "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in name))
    return reader.parquet(folder)


def admit(arrivals: DataFrame, rule: Column, target: str, checkpoint: str, key: str = "doc_id") -> None:
    """Append what passes the rule to ``target``, once for each key; runs until nothing is left.

    Each micro-batch writes its own folder, so one that is repeated after a failure
    replaces its own rows only.  Rows are dealt over ``bucket`` folders by a hash of
    their key: a batch reads the keys of its own buckets, and no other column.
    """
    buckets = 64

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where(rule).dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        root = spark._jvm.org.apache.hadoop.fs.Path(target)
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            old = spark.read.schema(f"{key} bigint, batch int, bucket int").option("basePath", target).parquet(f"{target}/batch=*")
            new = new.join(old.where(F.col("batch") != number).select(key, "bucket"), [key, "bucket"], "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")

    arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and window; works on streams and on tables."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
