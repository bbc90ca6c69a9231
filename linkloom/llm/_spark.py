"""Small Spark helpers: lineage cuts in shared storage, broadcasts behind a size check, and bounded batches for Python workers."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be sent to every executor.
BROADCAST_ROWS = 100_000
#: Bytes and rows of a batch that goes to a Python worker. A longer row is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Where none is set, a temporary one if all run on this machine, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and read from there from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a side for broadcast if its known row count is within the bound; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def from_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches within ``BATCH_BYTES`` and ``BATCH_ROWS``; smaller bounds that are set stay.

    A worker holds a batch and what is made of it, and the JVM the same batch off its heap, so this bounds both for any length of text.
    """
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D", "", spark.conf.get(name)) or 0)
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` that gives the memory that Arrow and the C library keep back to the machine at the end of a partition, since workers live on."""

    @functools.wraps(run)
    def held(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return held


def forget(spark: SparkSession) -> None:
    """Collects garbage on the driver, so that Spark removes the shuffle files of what has been checkpointed and is not referred to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    for pool in {pa.default_memory_pool().backend_name: pa.default_memory_pool(), "system": pa.system_memory_pool()}.values():
        pool.release_unused()
