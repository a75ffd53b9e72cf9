"""What several operators share: the shared folder, written tables, documents.

Conventions of every operator here
----------------------------------
* rows whose id is null are dropped: nothing can be reported about them;
* a null text counts as an empty text unless the operator says otherwise;
* a repeated row gives a repeated result row, with the same values;
* only the named columns are read, so further columns of any name are harmless.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, as in local tests, a temporary folder of this
    process takes its place.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        holder = tempfile.TemporaryDirectory(prefix="inkfold-")
        atexit.register(holder.cleanup)
        _own_dir = f"file://{holder.name}"
    return _own_dir


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs at most the tasks that had not been committed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkfold/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkfold_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_inkfold_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of an Arrow batch between Spark and a Python worker; Spark's own limit is eight times as much.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches be ``BATCH_BYTES`` at most, unless the session names a limit of its own.

    Texts are long: a batch of Spark's default size is held several times over by
    the executor and by its workers.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, BATCH_BYTES)


def keyed(df: DataFrame, id_col: str, text_col: str | None, *, null_text: str | None = "") -> DataFrame:
    """Columns ``id`` (bigint) and ``text`` only, without rows of null id."""
    small_batches(df.sparkSession)
    cols = [F.col(f"`{id_col}`").cast("bigint").alias("id")]
    if text_col is not None:
        text = F.col(f"`{text_col}`").cast("string")
        cols.append((text if null_text is None else F.coalesce(text, F.lit(null_text))).alias("text"))
    return df.select(*cols).where("id IS NOT NULL")


def mapped(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` over all columns, whatever characters their names have: batches come with names c0, c1, ...

    ``run`` yields batches whose columns stand in the order of ``schema``.
    """
    small_batches(df.sparkSession)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, [f"c{k}" for k in range(b.num_columns)])

    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(named, plain).toDF(*schema.names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are done with.

    Spark holds on to the last query it ran: a trivial one takes its place first.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


def trim(cycles: bool = True) -> None:
    """Give freed memory of a Python worker back to the system: workers are kept and used again.

    Without ``cycles`` only what is free already; that is quick enough for every group.
    """
    import ctypes

    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass
