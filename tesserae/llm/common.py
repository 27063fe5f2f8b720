"""Shared pieces of the training-data operators: tables, scratch space, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows times their width as a hashed relation stay below this. That width is
#: RELATION times the bytes of the columns (measured: 170 bytes for rows of 44).
BROADCAST_BYTES, RELATION = 128 << 20, 4
#: Arrow batches hold at most so many rows, so that a batch of long texts stays small.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows of an Arrow batch for the session, as texts can be very long; it never raises the bound, for
    plans that were made earlier run under it too. Spark bounds a batch's bytes beside
    (``spark.sql.execution.arrow.maxBytesPerBatch``)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Gives memory that this Python process has freed back to the system; workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(spark: SparkSession) -> None:
    """Gives memory that earlier jobs no longer need back: the driver's Python and JVM heaps, and, as the JVM's
    collection lets Spark's cleaner go on, the shuffles and broadcasts of those jobs. For loops of many jobs."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``.

    Where that is unset, as in tests on one machine, a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tesserae-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back.

    Unlike a checkpoint of the plan it computes df once, and it outlives lost executors.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its row count (df must be cheap to count, e.g. materialized)
    proves that it is small; otherwise as it is, for a sort-merge join."""
    return F.broadcast(df) if df.count() * row_bytes * RELATION <= BROADCAST_BYTES else df


#: A key with more than one of HOT_PARTS of all rows is hot; so there are at most HOT_PARTS of them.
HOT_PARTS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, row_bytes: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with groups (one row per key, ``n`` of its rows; materialized), without meeting all
    rows of a hot key in one task: groups are broadcast if they are few; else the hot ones are, and the others'
    rows are shuffled."""
    few = sized(groups, row_bytes)
    if few is not groups:
        return rows.join(few, key, how)
    least = (groups.agg(F.sum(n)).first()[0] or 0) / HOT_PARTS
    hot = F.broadcast(groups.where(F.col(n) > least))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(n) <= least), key, how)
    return rows.join(hot, key).unionByName(rest)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
