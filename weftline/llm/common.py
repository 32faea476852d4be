"""Helpers shared by the training-data operators: shared tables, batch maps, distributed ranks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: ASCII white space that separates words: \x20 and \x09-\x0D, which is what bytes.split() uses.
WORD = r"[^\x20\x09-\x0D]+"
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
    return _LOCAL[0]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            delete(spark, path)
    except Exception:  # the session went away first; the shared folder's owner cleans up
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of plans that are done with: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Writes df in the shared folder and reads it back: lineage is cut, and lost executors take nothing with them."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_delete_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(dict of column lists) -> dict of column lists, over bounded slices of Arrow batches."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                cols = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def slices(batch, rows: int = 512, budget: int = 8 << 20):
    """Cuts a batch so that a slice has few rows or few bytes; a single row may be larger."""
    n = max(1, min(rows, int(batch.num_rows * budget / max(1, batch.nbytes))))
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)
    trim()


def trim() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_SINGLE: list[bool] = []


def one_blas_thread() -> None:
    """Keeps numpy's products in this worker on its own core: other tasks have the rest, and small products on several
    threads spend more time waiting for each other than in sums."""
    if _SINGLE:
        return
    _SINGLE.append(True)
    try:
        libraries = {line.split()[-1] for line in open("/proc/self/maps") if "openblas" in line}
    except OSError:  # another system: its own setting stays
        return
    for path in libraries:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


#: Rows of a text table in one Arrow batch, and its bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts can be long; batches of fewer rows and bytes keep workers' memory low."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def dealt_bucket(col: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def distributed_rank(df: DataFrame, keys: list[str], bucket: list[str], order: list, name: str) -> DataFrame:
    """Adds `name`, the 0-based rank within keys by (bucket, order), without one task per key.

    Rows are dealt by (keys, bucket); the buckets' counts are summed up to offsets, of which there are few.
    """
    counts = df.groupBy(*keys, *bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inner = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys, *bucket).orderBy(*order)))
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, *bucket)]
    keep = [F.col(f"a.{c}") for c in df.columns]
    return inner.alias("a").join(offsets.alias("b"), cond).select(*keep, (F.col("_off") + F.col("_r") - 1).cast("long").alias(name))


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def env_single_thread() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
