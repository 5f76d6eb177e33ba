"""Token counts with a digest cache.

A text is known by the SHA-256 digest of its normalised content and a tokenizer by the digest of its
model file. Counts already stored under both digests are joined; only the distinct texts that are
missing are encoded (one representative document each), and their counts are appended to the cache, a
Parquet table ``digest, tokenizer, n_tokens``.

Normalisation must never change a count, so it is only: null reads as empty. Copies are found before any
text moves: the shuffle by digest carries 32 bytes a document. If few texts are missing (at most ``FEW``
digests, which are then broadcast), no text moves at all; otherwise the rows are exchanged by (id, digest) to
meet the representatives, which moves every text of the table once. Digests of many documents (at most 500)
meet their count by a broadcast, so copies are no hot group.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows and ids each get their row;
an empty table gives an empty result and leaves the cache as it was; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm.common import small_batches, stored, whole_text

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
_LOADED: dict[str, object] = {}
#: Missing digests up to which they are broadcast (32 bytes each and the id).
FEW = 10000
#: A digest of more than this part (1 / 500) of all documents is joined by a broadcast.
HOT = 500


def tokenizer_version(path: str) -> str:
    """Digest of the library and the model file."""
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f"sentencepiece {sentencepiece.__version__}\n".encode() + f.read()).hexdigest()


def _model(path: str):
    """The model, loaded once in a Python worker."""
    if path not in _LOADED:
        import sentencepiece

        _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


def _encoded(texts: DataFrame, path: str, version: str) -> DataFrame:
    """``digest, text`` to rows of the cache."""
    schema = pa.schema([("digest", pa.binary()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])

    def run(batches):
        seen: set[bytes] = set()  # rows that repeat both id and text meet in one task
        for b in batches:
            digests = b.column(0).to_pylist()
            new = [k for k, d in enumerate(digests) if d not in seen and not seen.add(d)]
            texts = b.column(1).take(pa.array(new, pa.int64())).to_pylist()
            ids = _model(path).encode(texts, num_threads=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[k] for k in new], pa.binary()), pa.array([version] * len(new), pa.string()),
                 pa.array(list(map(len, ids)), pa.int64())], schema=schema)

    return texts.mapInArrow(run, CACHE_SCHEMA)


def _cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer; a cache that does not exist yet is empty."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    # two runs may have appended the same text
    return rows.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` per input row; appends what was missing to the cache."""
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_version(model_path)
    text = whole_text(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    meta = stored(keyed.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")

    known = _cache(spark, cache_path, version)
    per_text = stored(meta.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("docs")), "distinct-texts")
    wanted = stored(per_text.join(known, "digest", "left_anti").select(F.col("digest").alias("d"), F.col("id").alias("i")), "missing-texts")
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted.hint("merge")
    texts = keyed.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")
    new = _encoded(texts.select("digest", "text"), model_path, version)
    new.groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache_path)

    counts = _cache(spark, cache_path, version)
    total = per_text.agg(F.sum("docs")).first()[0] or 0
    hot = per_text.filter(F.col("docs") * HOT > total).select("digest")  # fewer than HOT digests can have so large a part
    known_hot = F.broadcast(counts.join(F.broadcast(hot), "digest", "left_semi"))
    found = meta.join(known_hot, "digest").unionByName(meta.join(F.broadcast(hot), "digest", "left_anti").join(counts, "digest"))
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
