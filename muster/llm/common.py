"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.session import checkpoint_dir

#: characters that end a word in the word definition of the shingle operators (fixed value)
SPACE_CLASS = r"[\x20\x09-\x0D]+"


BATCH_ROWS = 1_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unique folder name under the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs started inside hand rows to Python in batches of ``rows``: a batch of the default
    10,000 whole texts, held by the JVM and by Python at once, is too much for a small executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and lets later steps reread the rows
    instead of computing them again. The table belongs to the job; whoever owns the checkpoint
    folder expires it together with the checkpoints.
    """
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return to the system what a task has freed: workers live on beside the tasks of later stages, and what
    they hold is taken from an executor's memory all the while."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task over batches that gives its memory back in the end."""
    @functools.wraps(task)
    def run(*args, **named):
        try:
            yield from task(*args, **named)
        finally:
            give_back()
    return run


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
