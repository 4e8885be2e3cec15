"""Test tables, stored intermediate tables and running totals over distributed rows."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Arrow batches of `size` bytes at most (one row at least), unless the session says otherwise; rows of long texts
    would else make batches of any size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back to the system when a task ends, as idle Python workers live on beside the next stage."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
                if trim:
                    trim(0)

    return task


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing (tests on one machine) a temporary folder is made and set once; a
    master other than local raises instead, as executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: later steps neither repeat its work nor need
    lost executors' files."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column `name` that differs on every row and is the same whenever the rows are read.

    It is made of the number of the row's file and its place in it; rows that come from no files are stored first.
    """
    try:
        files = docs.select(F.col("_metadata.file_path").alias("path")).distinct().collect()  # one row a file
    except AnalysisException:
        docs = stored(docs)
        files = docs.select(F.col("_metadata.file_path").alias("path")).distinct().collect()
    places = [(path, i) for i, path in enumerate(sorted(r["path"] for r in files))]
    table = docs.sparkSession.createDataFrame(places, "file_of_row string, number_of_file long")
    rows = docs.select("*", F.col("_metadata.file_path").alias("file_of_row"), F.col("_metadata.row_index").alias(name))
    rows = rows.join(F.broadcast(table), "file_of_row")
    return rows.select(*docs.columns, F.shiftleft("number_of_file", 40).bitwiseOR(F.col(name)).alias(name))


def running_totals(rows: DataFrame, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """rows with before_<value>: the sum of value over all earlier rows by `order` (nulls last).

    Rows are range-partitioned by `order` and stored, so no task holds all of them; only one total per
    partition meets in one task. Ties in `order` are taken in the stored order and share one partition.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(count, *keys).withColumn("range_part", F.spark_partition_id()))
    parts = placed.groupBy("range_part").agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
    ahead = Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("range_part", *[F.coalesce(F.sum(f"sum_{v}").over(ahead), F.lit(0)).alias(f"base_{v}") for v in values])
    within = Window.partitionBy("range_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"own_{v}") for v in values])
    out = out.join(F.broadcast(bases), "range_part")  # one row for each partition
    return out.select(*rows.columns, *[(F.col(f"own_{v}") + F.col(f"base_{v}")).alias(f"before_{v}") for v in values])


def text_of(column: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
