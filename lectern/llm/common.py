"""Shared helpers of the training-data operators: scratch tables and words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def shared_root(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a local one where it is unset and there is one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.gettempdir() + "/lectern-shared"
    return root.rstrip("/")


#: Rows of a batch that goes to a Python worker while a scratch table is written: kernels cut batches further by bytes.
BATCH_ROWS = 4000


@contextmanager
def smaller_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Batches of at most `rows` rows for what runs inside, whatever the session's limit: both sides hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written once to the shared folder, so that a lost executor never costs recomputation and lineage stays short."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "snappy", rows: int = BATCH_ROWS) -> DataFrame:
        """Write df as Parquet and return a reader of it; rows: of a batch that goes to a Python worker meanwhile."""
        with smaller_batches(self.spark, rows):
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more (all of them, if none is named)."""
        jvm = self.spark._jvm
        for p in [self.path(n) for n in names] or [self.base]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, with its Python worker handing freed memory back when a task ends: idle workers live on beside the next stage."""

    @wraps(kernel)
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return run


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sums_before(rows: DataFrame, key: str, value: str, name: str, *by: str, block: int = 4096) -> DataFrame:
    """rows with the sum of value over smaller keys (whole numbers, one row each within by; no nulls in by but equal ones).

    In two steps, so that no task sorts all keys: over blocks of keys, then inside a block.
    """
    rows = rows.withColumn("_block", F.floor(F.col(key) / block))
    before = lambda order, *parts: Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_block", *by).agg(F.sum(value).alias("_sum"))
    blocks = blocks.select("_block", *by, F.coalesce(F.sum("_sum").over(before("_block", *by)), F.lit(0)).alias("_base"))
    blocks = blocks.select(*[F.col(c).alias(f"_of{c}") for c in ("_block", *by)], "_base")
    met = rows.join(blocks, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in ("_block", *by)])
    inside = F.coalesce(F.sum(value).over(before(key, "_block", *by)), F.lit(0))
    return met.withColumn(name, F.col("_base") + inside).drop("_base", "_block", *[f"_of{c}" for c in ("_block", *by)])
