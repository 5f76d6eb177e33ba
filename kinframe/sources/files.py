"""File sources and sinks: CSV/JSON/Parquet round trips with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.session import ensure_checkpoint_dir

CATALOG_CSV_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("model_id", T.StringType()),
    T.StructField("card", T.StringType())])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (cluster-visible)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/kinframe-out/{name}-{uuid.uuid4().hex[:12]}"


def write_catalog_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells may hold quotes and newlines (quoted, quote-escaped)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def scan_catalog_csv(spark: SparkSession, path: str, schema: T.StructType = CATALOG_CSV_SCHEMA) -> DataFrame:
    """Catalog CSV with multi-line quoted cells; malformed rows dropped."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", "DROPMALFORMED").csv(path))


def union_tree_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All CSV files under a folder as one scan, with the source file of each row; files that cannot be read are skipped."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
          .option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).csv(path))
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def scan_tree_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``{"models": [...]}`` documents → one row per model (``inline``).

    ``multi_line``: one pretty-printed document per file (the crawler's
    format); False reads one document per line."""
    schema = T.StructType([T.StructField("models", T.ArrayType(T.StructType([
        T.StructField("model_id", T.StringType()), T.StructField("depth", T.IntegerType()),
        T.StructField("children", T.ArrayType(T.StringType())), T.StructField("children_count", T.IntegerType())])))])
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return doc.select(F.inline("models"))
