"""Written intermediate tables in the folder that all executors share.

A table that is read more than once, or that ends an iteration, is written as
Parquet below ``spark.checkpoint.dir`` and read back: a lost executor then costs
a re-read, never a recomputation, and the planner sees a real size.
"""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class _Open(threading.local):
    """Paths written in each scope that this thread has open, the innermost last."""

    def __init__(self):
        self.scopes: list[list[str]] = []


_open = _Open()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gaugeframe-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table (schema given, so an empty table reads back too)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _open.scopes:
        _open.scopes[-1].append(path)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def materialize_observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """As ``materialize``, with aggregates of the rows taken while they are written, which saves a job that reads them again."""
    seen = Observation()
    written = materialize(df.observe(seen, *metrics), name)
    return written, seen.get


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    _delete(df.sparkSession, df.written_path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those given to the yielded ``keep``.

    What is handed out of the scope may read kept tables only.  A table kept belongs to the scope around, if there is one.
    """
    own: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.written_path)
        return df

    _open.scopes.append(own)
    try:
        yield keep
    finally:
        _open.scopes.pop()
    if _open.scopes:
        _open.scopes[-1].extend(kept)
    for path in own:
        if path not in kept:
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no live DataFrame needs: it does so when the driver's JVM collects its garbage, which a
    driver with memory to spare may not do before a long operator ends."""
    gc.collect()  # Python's references first
    spark._jvm.System.gc()


def written_side(df: DataFrame, name: str, max_values: int, values: Column | None = None) -> DataFrame:
    """Write one side of a join and mark it for broadcast when it holds at most ``max_values`` numbers.

    ``values`` counts the numbers of a row (its columns by default; give an
    expression for arrays or texts).  Beyond the bound the table is hinted to a
    sort-merge join, whose skewed partitions adaptive execution can split.
    """
    each = F.lit(len(df.columns)) if values is None else values
    written, seen = materialize_observed(df, name, F.sum(each.cast("long")).alias("values"))
    hinted = written.hint("broadcast" if (seen["values"] or 0) <= max_values else "merge")
    hinted.written_path = written.written_path
    return hinted

