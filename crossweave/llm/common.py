"""Shared folder, written intermediate tables, and text helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.datasets import scratch_dir

_used: ContextVar[list[str] | None] = ContextVar("used", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for derived files of this application, below the shared folder the session names."""
    path = scratch_dir(spark, name)
    path = path if "://" in path or path.startswith("file:") else "file://" + path
    if (used := _used.get()) is not None:
        used.append(path)
    return path


@contextmanager
def folders_used() -> Iterator[list[str]]:
    """Collects the folders that ``shared_dir`` gives out inside the block, for ``remove_folders``."""
    token = _used.set([])
    try:
        yield _used.get()
    finally:
        _used.reset(token)


def remove_folders(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete derived folders; call it when no result still reads them."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps and retries see the same rows
    and never recompute the plan above it."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_row() -> Column:
    """What tells the rows of a written Parquet table apart, however alike: file and place in it. The same in every read."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def field_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
