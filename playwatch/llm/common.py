"""Helpers that several operators share: the shared folder, tables that cut lineage, ranks over partitions."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that separates words in all contracts: space and U+0009 to U+000D.
BLANK = "[\\x20\\x09-\\x0D]"

#: Rows of a batch that a Python task turns into strings at a time, so that memory follows the text of a few rows.
SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir of the session.

    Only a local session, whose executor is the driver, may go without: it gets a folder of its own. On a cluster such a folder
    would lie on one machine's disk, so there a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="playwatch-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans start from the files, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building the filtered array: split leaves an empty string at blank ends only."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANK + "+")
    empty_end = (F.element_at(parts, -1) == "").cast("long")
    empty_start = ((F.size(parts) > 1) & (F.element_at(parts, 1) == "")).cast("long")
    return F.size(parts).cast("long") - empty_end - empty_start


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def ranked(keys: DataFrame, key: str, rank: str) -> DataFrame:
    """``keys`` with a dense row number from 0 in ascending order of ``key`` (null last), without a single sorting task.

    Range partitions number their own rows; how many rows the partitions before hold comes from a table of a row for each.
    """
    order = F.col(key).asc_nulls_last()
    dealt = keys.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranked")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    out = dealt.withColumn("__own", own).join(sizes.select("__part", before.alias("__before")), "__part")
    return out.withColumn(rank, (F.col("__own") - 1 + F.col("__before")).cast("long")).select(*(F.col(f"`{c}`") for c in keys.columns), rank)
