"""Corpus pipeline: the training-data operators applied to ``documents`` one after the other.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that ``run`` writes as Parquet (in the
shared folder) and reads again as the next stage's ``docs``. All stages but the last return the columns
of ``documents``.

Defined cases: a null or empty text fails the quality rules and goes with its row; repeated rows and copies end as one
row of the least id (the SimHash stage), null ids last; a document that line dedup or decontamination leaves without a
word goes; ties of copies follow the id, then a hash of the text; extra columns, whatever their names, come through the
first four stages unchanged; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinframe.llm import decontamination, line_dedup, packing, quality, simhash
from kinframe.llm.common import scratch, ship
from kinframe.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest rule policy keeps."""
    return quality.filter_documents(docs)


def line_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier one has; those with no word left go."""
    ship(spark)
    return line_dedup.remove_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash component (4-word shingles, 4 bits)."""
    ship(spark)
    return simhash.keep_one(docs, 4)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; those with no word left go."""
    ship(spark)
    return decontamination.remove_hits(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"), 10)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row per piece of a document."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_blocks),
    ("simhash", near_duplicates),
    ("decontamination", benchmark_passages),
    ("best_fit_packing", packed_sequences),
]

#: SQL has no patience diff, no bounded-distance components and no tokenizer: the pipeline is tested
#: against brute-force versions of its stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
