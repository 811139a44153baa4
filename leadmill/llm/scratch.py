"""Intermediate tables in the folder that all executors share.

A table written there cuts the lineage of an iterative job and outlives lost executors. The folder is
``spark.checkpoint.dir``; only where it is unset, in a local session, a temporary folder takes its place.

Tables that a returned frame still reads belong to the caller: ``with temporary(spark):`` around an operator
and the writing of its result deletes them at the end. Without it they stay until the folder of the
application is deleted, since a frame may be read again at any time.
"""

from __future__ import annotations

import atexit
import contextvars
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: The folders made inside the innermost ``temporary``.
_OWNED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators leave behind; write their results inside."""
    token = _OWNED.set([])
    try:
        yield
    finally:
        for path in _OWNED.get():
            delete(spark, path)
        _OWNED.reset(token)


class Scratch:
    """Tables of one run of an operator; superseded ones are dropped as soon as a newer one is complete."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        if (owned := _OWNED.get()) is not None:
            owned.append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a Parquet table, read back: later plans start from its files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path  # keeps the path with the frame
        self.reclaim()
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            delete(self.spark, table._scratch_path)

    def reclaim(self) -> None:
        """Let Spark's cleaner remove shuffle files of finished plans, which it does after a collection."""
        gc.collect()
        self.spark._jvm.System.gc()
