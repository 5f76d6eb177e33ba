"""Shared helpers of the training-data operators: scratch tables and text columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.session import ensure_checkpoint_dir, ship_package

#: The ASCII white space that separates words.
WHITE = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kinframe-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared Parquet table and read it back: cuts the lineage with a copy that
    survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters outside ``WHITE``."""
    spaced = F.translate(text, WHITE[1:], " " * (len(WHITE) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def n_partitions(spark: SparkSession, n_bytes: int, per_partition: int = 32 << 20) -> int:
    """Partitions for ``n_bytes`` of text: the session's number, or more where that would make them large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // per_partition))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that a batch of long texts stays small in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    ship_package(spark)
