"""Decoded tables written once to the folder that driver and executors share, so that rules start from files."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="playwatch-")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session may go without and gets a folder of its own: on a cluster that would
    lie on one machine's disk, so there a missing setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _own_folder()).rstrip("/")


#: The folder within the shared one that tables go to, where ``scratch`` names it.
_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all its files, in whatever store it lies; none is no error."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def touch(spark: SparkSession, path: str) -> None:
    """Makes an empty file, which is there whole or not at all."""
    files, where = _file_system(spark, path)
    files.create(where, True).close()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables stored within it go to a folder of their own in the shared one, which is deleted at its end."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        delete_folder(spark, path)


#: Stored tables of more rows meet others by shuffles.
MOST_BROADCAST_ROWS = 20_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: later plans are short, and survive the loss of any executor.

    Spark sizes what it reads by its files, and a few columns by their share of the row; compressed and of wide rows, that is far
    below what the driver would hold to broadcast them. So rows are counted, which reads footers alone.
    """
    path = f"{_scratch.get() or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    own = df.sparkSession.read.schema(df.schema).parquet(path)
    return shuffled(own) if own.count() > MOST_BROADCAST_ROWS else own


def shuffled(df: DataFrame) -> DataFrame:
    """df, which joins may not broadcast. That holds below a projection, filter or aggregate of it, not below a join or union."""
    return df.hint("merge")
