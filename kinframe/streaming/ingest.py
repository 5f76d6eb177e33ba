"""Structured Streaming ingestion: new ids, secret split, de-duplication.

The reference iterates ids lazily and appends resumable chunks; here a file
stream is processed with ``trigger(availableNow=True)`` and a checkpoint, so a
restarted job resumes where it stopped. De-duplication and the anti join
against already stored ids run inside ``foreachBatch`` against the output
table (a bare streaming ``dropDuplicates`` would keep unbounded state).
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.functions.text import secret_flag

#: Buckets of an output by the hash of the key.
BUCKETS = 64


def stream_tables(spark: SparkSession, src_dir: str, schema: T.StructType, glob: str | None = None) -> DataFrame:
    """Streaming scan of a folder of parquet files; with ``glob`` of the tables in it by that name, each one file or a
    folder of part files (a filter on file names would pass over the latter)."""
    if glob and not any(c in glob for c in "*?[{"):
        glob = f"[{glob[0]}]{glob[1:]}"  # Spark takes a plain path for a folder, a pattern may match a file as well
    return spark.readStream.schema(schema).parquet(f"{src_dir}/{glob}" if glob else src_dir)


def stream_ids(spark: SparkSession, src_dir: str, schema: T.StructType, id_col: str,
               glob: str | None = None) -> DataFrame:
    """Streaming scan of a folder of parquet files, rows without id dropped."""
    return stream_tables(spark, src_dir, schema, glob).select(id_col).where(F.col(id_col).isNotNull())


def append_new(batch: DataFrame, epoch: int, out_dir: str, stream: str, key: str, buckets: int = BUCKETS) -> None:
    """Store the keys of a micro-batch that no other batch has stored.

    The rows of a batch lie in a folder of its own, ``batch=<stream>-<epoch>/bucket=<hash of the key>``, that a repeated
    run of the batch overwrites: replaying a batch, or starting again after a crash between the write and the commit,
    adds nothing. Only the buckets that the batch has are read for the comparison."""
    spark, own = batch.sparkSession, f"{stream}-{epoch}"
    fresh = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    met = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` rows
    schema = fresh.schema.add("batch", "string")
    try:
        stored = spark.read.schema(schema).parquet(out_dir).where(F.col("bucket").isin(met) & (F.col("batch") != own))
        fresh = fresh.join(stored.select("bucket", key), ["bucket", key], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # otherwise the first batch: nothing is stored yet
    fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{out_dir}/batch={own}")


def run_available(df: DataFrame, out_dir: str, checkpoint: str, key: str) -> None:
    """Store every new key of the stream once and stop when all available input is processed. The checkpoint's path
    names the stream: several streams can fill one output."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    query = (df.writeStream.foreachBatch(lambda batch, epoch: append_new(batch, epoch, out_dir, stream, key))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def stored_keys(spark: SparkSession, out_dir: str, schema: T.StructType) -> DataFrame:
    """The rows that ``run_available`` has stored."""
    return spark.read.schema(schema).parquet(out_dir).select(*schema.names)


def secret_split_stream(spark: SparkSession, src_dir: str, schema: T.StructType, text_col: str, kept_dir: str, excluded_dir: str,
                        checkpoint: str, patterns: list[str], glob: str | None = None) -> None:
    """Cards stream → kept table and exclusion log by the secret patterns; every batch has folders of its own, which a
    repeated run of it overwrites."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    df = stream_tables(spark, src_dir, schema, glob).withColumn("_secret", secret_flag(text_col, patterns))

    def write(batch: DataFrame, epoch: int) -> None:
        for out, part in ((kept_dir, ~F.col("_secret")), (excluded_dir, F.col("_secret"))):
            batch.where(part).drop("_secret").write.mode("overwrite").parquet(f"{out}/batch={stream}-{epoch}")

    (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
