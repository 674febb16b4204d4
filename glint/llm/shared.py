"""Tables between the steps of an operator, where every executor can read them again."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000

#: Rows that a Python worker gets at once, at most. Thousands of texts or sets would fill its memory and the JVM's.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within hands BATCH_ROWS rows to Python at once, or as few as the session is set to."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def trim() -> None:
    """Give memory that is free back to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a function of batches, but its memory is given back when it ends: Python workers live on, and what each keeps adds up."""

    @wraps(run)
    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return trimmed


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session on this machine alone, as in tests, may go without and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="glint")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


class Scratch:
    """Tables of one call of an operator: Parquet in the shared folder, which cuts the lineage and outlives executors.

    What is dropped is deleted at once; the rest, which a result may still read, when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/glint-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._path(self.root))

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of its own."""
        path = f"{self.root}/{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def sized(self, df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
        """``df``, rows of a few numbers, as a table, which is broadcast where it has ``most`` rows at most."""
        out = self.write(df)
        return F.broadcast(out) if out.limit(most + 1).count() <= most else out

    def release(self) -> None:
        """Let go of the shuffle files of tables that are written: Spark deletes them when the driver's JVM collects what refers to them."""
        gc.collect()
        for wait in (0.1, 0):  # what the first turn frees still holds the plans
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(wait)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more. What wasn't written here is left alone."""
        for t in tables:
            if id(t) in self._paths:
                self._files.delete(self._path(self._paths[id(t)][1]), True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that df doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
