"""What a task leaves behind in its Python worker.

Spark keeps workers for later tasks, of other stages and other operators, too. What one remembers, and memory that
its allocators don't give back, then adds up over the stages of a session beside the heap of the executor.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


def give_back() -> None:
    """Unused memory of Arrow's pool and of the C library goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None):
    """A function for ``mapInArrow`` after whose end the worker is as small as before; ``forget`` drops what it remembered."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    return tidied


def text_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let the session pass texts to Python in Arrow batches of ``most`` bytes, unless it has a setting of its own.

    Spark's default of 64 MB is meant for narrow rows. A batch is held by the executor and its worker at once, in
    several copies, outside the heap; one long text still is a batch of its own.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(key, most)
