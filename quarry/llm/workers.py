"""Memory of Python workers, which outlive their tasks and stages."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

Batches = Iterator[pa.RecordBatch]


#: Rows that are sent to a worker at once where memory is short. A batch is held by the JVM and by the worker, several times over while it grows.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in a batch to BATCH_ROWS, unless it has fewer; no result depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Returns memory that the worker has freed to the system, which the allocators would hold on to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def values(column: pa.Array) -> Iterator:
    """A column's values one after another: all at once, texts take several times a batch's room."""
    return (x.as_py() for x in column)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function of batches that leaves an idle worker small when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
