"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from strata.sources.scratch import new_folder

_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stored(frame: DataFrame, purpose: str, stays: bool = False) -> DataFrame:
    """``frame`` written once as Parquet to a fresh shared folder and read back: a cut of the lineage that outlives executors.

    Inside :func:`passing` the table goes at the end of the block, unless it ``stays``.
    """
    path = new_folder(frame.sparkSession, purpose)
    if not stays and (folders := _passing.get()) is not None:
        folders.append(path)
    with small_batches(frame.sparkSession):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024, size: str = "8m") -> Iterator[None]:
    """Jobs inside the block hand rows to Python in batches of at most so many rows, so that workers hold little at a time."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are deleted when it ends, also after an error; only what ``stays`` may be read later."""
    folders: list[str] = []
    before = _passing.set(folders)
    try:
        yield
    finally:
        _passing.reset(before)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
