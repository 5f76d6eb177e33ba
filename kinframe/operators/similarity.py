"""Bag-of-words / TF-IDF in long form, and pairwise similarity on given pairs.

Vectors are never densified: documents are ``(doc, term, weight)`` rows, the
vocabulary is all terms unless the caller caps it (a capped one is broadcast),
and similarities are computed only for pairs the caller supplies
(lineage edges, sampled kin pairs) — there is no all-pairs product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinframe.operators.topk import top_k
from kinframe.session import ship_package, stored

#: Terms with more than this part (1 / 500) of all (document, term) rows are joined by a broadcast.
HOT = 500
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: str | Column) -> Column:
    """Lower-cased tokens of two or more word characters, in text order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def with_bigrams(toks: Column) -> Column:
    """Unigrams followed by space-joined consecutive bigrams."""
    pairs = F.arrays_zip(toks, F.slice(toks, 2, 1 << 30))
    bi = F.transform(F.filter(pairs, lambda p: p["1"].isNotNull()),
                     lambda p: F.concat_ws(" ", p["0"], p["1"]))
    return F.concat(toks, bi)


def term_counts(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, term, tf) long form. The texts are dealt by their id once, so that the terms of a document are counted where
    it lies; the (id, term) rows, several times the text, are not exchanged."""
    return (docs.repartition(id_col).select(F.col(id_col).alias("doc"), F.explode(terms).alias("term"))
            .groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary(tf: DataFrame, cap: int | None = None) -> DataFrame:
    """Terms with their corpus frequency; with ``cap`` only the most frequent ones (ties by term)."""
    corpus = tf.groupBy("term").agg(F.sum("tf").alias("corpus_tf"))
    return corpus if cap is None else top_k(corpus, [F.desc("corpus_tf"), F.asc("term")], cap)


def restrict(tf: DataFrame, cap: int | None = None) -> DataFrame:
    """The rows of the ``cap`` most frequent terms (at most ``cap`` rows are broadcast); all without a cap."""
    if cap is None:
        return tf
    return tf.join(F.broadcast(vocabulary(tf, cap).select("term")), "term", "left_semi")


def tfidf(tf: DataFrame, n_docs: DataFrame, only: DataFrame | None = None, store: bool = True) -> DataFrame:
    """tf · (ln((1 + N)/(1 + df)) + 1), L2-normalised per document.

    The counts are stored once (unless ``store`` is false, for counts that are stored already). Terms with more than 1/``HOT`` of all rows (fewer than ``HOT`` of them) meet their document
    frequency by a broadcast, so a word in every document is no hot join key; the norm is summed within a document.
    With ``only(doc)`` the weights of those documents alone; the frequencies are still those of all."""
    tf = stored(tf, "term-counts") if store else tf
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    many = F.col("df") * HOT > tf.count()
    hot = F.broadcast(df_.where(many))
    if only is not None:
        tf = tf.join(only.select("doc"), "doc", "left_semi")
    known = tf.join(hot, "term").unionByName(tf.join(hot.select("term"), "term", "left_anti").join(df_.where(~many), "term"))
    w = known.crossJoin(n_docs).withColumn(  # n_docs: one row
        "raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc")))
    return w.select("doc", "term", (F.col("raw") / norm).alias("weight"))


def cosine_sparse(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Cosine of (u, v) pairs from L2-normalised long-form weights: Σ w_u·w_v."""
    wu = weights.select(F.col("doc").alias("u"), "term", F.col("weight").alias("wu"))
    wv = weights.select(F.col("doc").alias("v"), "term", F.col("weight").alias("wv"))
    dots = (pairs.select("u", "v").join(wu, "u").join(wv, ["v", "term"])
            .groupBy("u", "v").agg(F.sum(F.col("wu") * F.col("wv")).alias("cosine")))
    return pairs.select("u", "v").join(dots, ["u", "v"], "left").select(
        "u", "v", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def cosine_dense(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of equal length (higher-order functions)."""
    a = a.cast("array<double>")
    b = b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, na * nb)


def edit_distance(a: str | None, b: str | None) -> int | None:
    """Levenshtein distance of code points. A column of the table of distances is held as two whole numbers, the bits
    where it rises and falls from one row to the next, so a step takes all rows of the longer text at once (Myers,
    Hyyrö). Common ends are left out."""
    if a is None or b is None:
        return None
    if len(a) < len(b):
        a, b = b, a
    if a.startswith(b) or a.endswith(b):
        return len(a) - len(b)
    start = end = 0
    while a[start] == b[start]:  # neither text is an end of the other, so both loops stop
        start += 1
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    points, m = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4"), len(a)
    at = {c: int.from_bytes(np.packbits(points == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    rows, one_more, two_more = (1 << m) - 1, (1 << m + 1) - 1, (1 << m + 2) - 1
    up, down = rows, 0
    for eq in map(at.__getitem__, b):  # bits from the m-th on are never read
        zero = (((eq & up) + up) ^ up) | eq | down
        left = zero & up
        right = ((down | ((zero | up) ^ one_more)) << 1) | 1
        up = ((left << 1) | ((zero | right) ^ two_more)) & rows
        down = right & zero
    return len(b) + up.bit_count() - (down & rows).bit_count()


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 − distance / max(len); 1 when both are empty, 0 when one is."""
    ship_package(SparkSession.active())
    la, lb = F.length(a), F.length(b)
    distance = F.udf(edit_distance, "int", useArrow=False)  # rows in small batches: texts are long
    return (F.when((la == 0) & (lb == 0), F.lit(1.0))
            .when((la == 0) | (lb == 0), F.lit(0.0))
            .otherwise(1 - distance(a, b) / F.greatest(la, lb)))
