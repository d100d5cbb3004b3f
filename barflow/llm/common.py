"""Helpers shared by the corpus operators: tables, staging, Arrow batches, bounded labelled samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.session import scratch_path, shared_dir, use_utc

# Rows that a function of an Arrow batch gets at a time.
ROWS_AT_ONCE = 256

# ASCII white space; a word is a run of anything else.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"

# What this Python worker remembers from task to task, and what its task has asked for.
_MEMORY: dict[tuple, Any] = {}
_ASKED: set[tuple] = set()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared scratch folder and read it back (cuts lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the written tables that ``df`` reads, those in the shared scratch folder only; nothing may read them afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    near = lambda p: p.toUri().getPath()
    scratch = near(path(shared_dir(spark))).rstrip("/") + "/"
    for table in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = path(table)
        if near(at).startswith(scratch):
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kind(df: DataFrame, column: str) -> str:
    """DDL type of a column."""
    return df.schema[column].dataType.simpleString()


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remembered(key: tuple, make: Callable[[], Any]) -> Any:
    """What this Python worker remembers under ``key``, made by ``make`` when first asked for.

    Workers outlive stages and several share an executor's memory, so a worker has one memory at a time.
    """
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = make()
    _ASKED.add(key)
    return _MEMORY[key]


def begin_task() -> None:
    _ASKED.clear()


def tidy() -> None:
    """Forget what this task has not asked for (another stage's memory), and free what Arrow holds for later batches."""
    gone = _MEMORY.keys() - _ASKED
    for key in gone:
        del _MEMORY[key]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if gone else None
    if trim:  # glibc keeps freed memory between what is in use
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """Apply a function of an Arrow batch to all rows of ``df``, ``rows`` at a time to bound the worker's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))
            if batch.num_rows:  # a task without rows asks for nothing, but another of its stage may follow
                tidy()

    return df.mapInArrow(run, schema)
