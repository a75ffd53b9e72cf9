"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; in local mode without it, in a temporary folder."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own is None:
            holder = tempfile.TemporaryDirectory(prefix="inkfold-")
            atexit.register(holder.cleanup)
            _own = f"file://{holder.name}"
        base = _own
    return f"{base.rstrip('/')}/inkfold/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: lineage ends there, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    path, spark = getattr(df, "_stored_at", None), df.sparkSession
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A hint for a side whose rows are counted first; a larger side is left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
