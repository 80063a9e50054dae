"""Session helpers: the shared folder and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read and write.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting (tests, laptops) gets a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if configured:
        if current.isEmpty():
            context.setCheckpointDir(configured)
        return configured
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="textorbit-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """New path below the shared folder, for one run's tables or stream state."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this library in the shared folder, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what ``cut`` wrote inside; all readers must be done by then."""
    paths: list[str] = []
    token = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Used where two branches must see the very same rows and partition numbers,
    and between passes that would otherwise double the lineage.  A columnar
    table is read column by column, and Spark knows its size when it plans the
    joins with it.
    """
    path = fresh_dir(df.sparkSession, "cut")
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan of less than one full input split per core.

    A small file is one row group, hence one task, while tokenizing and hashing
    its rows costs far more than moving them.  Four pieces per core even out
    long texts.  Larger inputs stay as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(4 * cores) if size < cores * split else df

