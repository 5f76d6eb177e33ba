"""Comparisons between all documents of sparse unit vectors in long form (doc, term, weight), without all pairs.

* ``similarity_by_depth``: the sum of cosines between two depth levels is the dot product of their vector sums, so
  every pair counts and none is formed.
* ``top_pairs``: the most similar pairs, by a prefix-filtered join on an inverted index at a threshold that is known to
  be reached. Terms become numbers and documents rows before anything else is exchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.functions.common import wide
from kinframe.operators.sequence import dense_index, previous_in_group
from kinframe.operators.similarity import HOT, cosine_sparse
from kinframe.operators.topk import top_k, top_k_per_group
from kinframe.session import ensure_checkpoint_dir, ship_package, stored

#: Most terms (of ``SHORT`` characters at most) or documents that are broadcast.
FREQUENT, SHORT = 1 << 16, 64
#: Rarest terms by which pairs are chosen that give a threshold, and how many of them for each pair asked for.
HEAD, SEEDS = 16, 200
#: Bits of a term's count beside its number, documents turned into weights at once.
COUNT, DOCUMENTS = 28, 1024
#: Slack of sums of squares, and most rows that leave a Python function at once.
BLUR, PIECE = 1e-9, 1 << 17


def similarity_by_depth(weights: DataFrame, depths: DataFrame) -> DataFrame:
    """``depth_difference, pairs, mean_similarity`` over all unordered pairs of documents of ``depths (doc, depth)``.

    ``weights`` are of unit length per document; a document without terms is similar to none (0). Documents without a
    depth are left out. The levels are as many as the depths of the tree; a term meets each level once.
    """
    known = depths.where("depth IS NOT NULL").select(F.col("doc").alias("d"), "depth")
    w = weights.join(known, F.col("doc") == F.col("d"))
    sums = w.groupBy("depth", "term").agg(F.sum("weight").alias("s"))
    own = w.groupBy("depth").agg(F.sum(F.col("weight") * F.col("weight")).alias("own"))  # the pairs of a document with itself
    per_term = sums.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("depth", "s"))).alias("l"))
    later = lambda l, f: F.flatten(F.transform(l, lambda a, i: F.transform(F.slice(l, i + 1, F.size(l)), lambda b: f(a, b))))
    dots = per_term.select(F.explode(later(F.col("l"), lambda a, b: F.struct(
        a["depth"].alias("a"), b["depth"].alias("b"), (a["s"] * b["s"]).alias("p")))).alias("e")).groupBy("e.a", "e.b").agg(F.sum("e.p").alias("dot"))
    levels = known.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    counts = levels.agg(F.array_sort(F.collect_list(F.struct("depth", "n"))).alias("l")).select(F.explode(later(
        F.col("l"), lambda a, b: F.struct(a["depth"].alias("a"), b["depth"].alias("b"), F.when(
            a["depth"] == b["depth"], a["n"] * (a["n"] - 1) / 2).otherwise(a["n"] * b["n"]).cast("long").alias("n")))).alias("e")).select("e.*")
    same = F.when(F.col("a") == F.col("b"), (F.col("dot") - F.coalesce("own", F.lit(0.0))) / 2).otherwise(F.col("dot"))
    total = dots.join(own, F.col("a") == F.col("depth"), "left").select("a", "b", same.alias("total"))
    return (counts.join(total, ["a", "b"], "left").groupBy((F.col("b") - F.col("a")).alias("depth_difference"))
            .agg(F.sum("n").alias("pairs"), F.sum(F.coalesce("total", F.lit(0.0))).alias("t")).where("pairs > 0")
            .select("depth_difference", "pairs", (F.col("t") / F.col("pairs")).alias("mean_similarity")))


def _classes(signed: DataFrame, k: int) -> DataFrame:
    """``rep, n, members``: documents of the same signature ``s1, s2``, the least as representative, and the ``k + 1`` least of
    them, which hold the ``k`` first pairs."""
    sig = ["s1", "s2"]
    least = top_k_per_group(signed, sig, [F.asc("doc")], k + 1, ["doc"]).groupBy(*sig).agg(
        F.array_sort(F.collect_list("doc")).alias("members"))
    return signed.groupBy(*sig).agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).join(least, sig).select("rep", "n", "members")


def _numbers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, df, id`` of the terms of two documents and more, numbered from the rarest, and the most frequent of them:
    ``FREQUENT`` at most, short ones but for those with more than 1/``HOT`` of all rows."""
    ids = stored(dense_index(df.where("df > 1"), [], ["df", "term"], "id").select("term", "df", F.col("id").cast("long").alias("id")), "terms")
    rows = ids.agg(F.sum("df").alias("n")).first()["n"] or 0
    frequent = top_k(ids.where((F.length("term") <= SHORT) | (F.col("df") * HOT > rows)), [F.desc("df"), F.desc("id")], FREQUENT)
    return ids, frequent


def _as_rows(known: DataFrame) -> DataFrame:
    """``doc, id, x, square`` (``id`` null for a term of one document, ``square`` what it adds to the squared length) to a
    stored row per document: ``ids`` from the rarest, ``w`` at unit length, and a signature of its counts."""
    shared = lambda c: F.collect_list(F.when(F.col("id").isNotNull(), F.col(c)))
    rows = known.groupBy("doc").agg(shared("id").alias("ids"), shared("x").alias("x"), F.sum("square").alias("q"), F.count(F.lit(1)).alias("n"))
    rows = rows.where("size(ids) > 0").select("doc", "q", F.sort_array(F.arrays_zip("ids", "x")).alias("l"), F.when(
        F.col("n") > F.size("ids"), F.col("doc")).alias("alone"))
    rows = rows.select("doc", F.col("l.ids").alias("ids"), F.col("l.x").alias("x"), "q", "alone")
    return stored(rows.select("doc", "ids", F.transform("x", lambda x: x / F.sqrt("q")).alias("w"), *[
        F.xxhash64(F.lit(seed), "ids", "x", "alone").alias(f"s{seed}") for seed in (1, 2)]), "documents")


def tfidf_rows(tf: DataFrame, n_docs: int) -> DataFrame:
    """The rows (``_as_rows``) of TF-IDF weights as in ``similarity.tfidf`` of stored counts. Frequent terms meet their number by
    a broadcast of bounded size, so only the rows of rare ones are exchanged by term; then a whole number for each term and
    its count is exchanged by document, once, and stored. The weights follow from these where the rows are read."""
    ids, frequent = _numbers(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    found = tf.join(F.broadcast(frequent), "term", "left")
    rest = ids.join(F.broadcast(frequent.select("term")), "term", "left_anti")
    rare = found.where("id IS NULL").select("doc", "term", "tf").join(wide(rest), "term", "left")
    known = found.where("id IS NOT NULL").select("doc", "id", "df", "tf").unionByName(rare.select("doc", "id", "df", "tf"))
    alone = F.when(F.col("id").isNull(), F.col("tf"))
    rows = known.groupBy("doc").agg(F.collect_list(F.shiftleft("id", COUNT).bitwiseOR(F.col("tf"))).alias("l"), F.sum(
        alone.cast("double") * alone).alias("more"))
    alone = F.when(F.col("more").isNotNull(), F.col("doc"))
    rows = rows.where("size(l) > 0").select("doc", F.sort_array("l").alias("l"), F.coalesce("more", F.lit(0.0)).alias("more"), alone.alias("alone"))
    rows = stored(rows.select("doc", "l", "more", *[F.xxhash64(F.lit(seed), "l", "alone").alias(f"s{seed}") for seed in (1, 2)]), "documents")
    # numbers go by frequency: a row per distinct frequency, fewer than the root of twice the rows of terms and documents
    steps = sorted((r["id"], r["df"]) for r in ids.groupBy("df").agg(F.min("id").alias("id")).collect())
    sent = tf.sparkSession.sparkContext.broadcast((np.array([i for i, _ in steps], np.int64), np.array([d for _, d in steps], float)))
    weight = lambda df: np.log((1 + n_docs) / (1 + df)) + 1
    doc = rows.schema["doc"].dataType.simpleString()

    def run(batches):
        first, df = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(at, DOCUMENTS)
                packed, n = batch.column(1).flatten().to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
                ids, ends = packed >> COUNT, np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                x = (packed & (1 << COUNT) - 1) * weight(df)[np.searchsorted(first, ids, "right") - 1]
                square = np.add.reduceat(x * x, ends[:-1]) + batch.column(2).to_numpy() * weight(1) ** 2
                w = x / np.repeat(np.sqrt(square), n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (ids, w)], batch.column(3), batch.column(4)],
                    ["doc", "ids", "w", "s1", "s2"])

    ship_package(tf.sparkSession)
    return rows.mapInArrow(run, f"doc {doc}, ids array<long>, w array<double>, s1 long, s2 long")


def _prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """``doc, id, w, after``: the terms of each document from the rarest on, as long as the norm of those from there on is
    ``threshold`` at least, and the norm behind each."""
    doc = rows.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, w, n = batch.column(1).flatten(), batch.column(2).flatten().to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            ends, total = np.cumsum(n), np.concatenate([[0], np.cumsum(w * w)])
            row = np.repeat(np.arange(len(n)), n)
            rest = total[ends][row] - total[:-1]
            every = np.flatnonzero(rest >= threshold * threshold - BLUR)
            for start in range(0, len(every), PIECE):
                at = every[start:start + PIECE]
                after = np.sqrt(np.maximum(rest[at] - w[at] * w[at], 0) + BLUR)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), ids.take(pa.array(at)), pa.array(w[at]), pa.array(after)],
                                                 ["doc", "id", "w", "after"])

    ship_package(rows.sparkSession)
    return rows.select("doc", "ids", "w").mapInArrow(run, f"doc {doc}, id long, w double, after double")


def _cosines(pairs: DataFrame, rows: DataFrame, digits: int) -> DataFrame:
    """``u, v, s`` above 0 of stored pairs; only the documents in them are exchanged."""
    met = stored(pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct(), "met")
    met = F.broadcast(met) if met.count() <= FREQUENT else wide(met)
    w = rows.join(met, "doc", "left_semi").select("doc", F.explode(F.arrays_zip("ids", "w")).alias("e")).select(
        "doc", F.col("e.ids").alias("term"), F.col("e.w").alias("weight"))
    return cosine_sparse(pairs, w).select("u", "v", F.round("cosine", digits).alias("s")).where("s > 0")


def top_pairs(tf: DataFrame, weights: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """``top_pairs_of`` for weights in long form (doc, term, weight) of unit length, and the counts ``tf`` behind them."""
    ids, _ = _numbers(weights.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    known = weights.join(wide(ids), "term", "left").join(tf.select("doc", "term", "tf"), ["doc", "term"])
    # counts for the signature; their weights follow from the documents' own
    rows = _as_rows(known.select("doc", "id", F.col("tf").cast("double").alias("x"), F.lit(1.0).alias("square")))
    own = known.where("id IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "weight"))).alias("l"))
    return top_pairs_of(stored(rows.drop("w").join(wide(own), "doc").select("doc", "ids", F.col("l.weight").alias("w"), "s1", "s2"), "documents"), k, digits)


def top_pairs_of(rows: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """``u, v, similarity``: the ``k`` pairs (u < v) of greatest cosine above 0 at ``digits`` decimals, equal ones by u, v. ``rows``
    are cheap to read: ``doc``, its shared terms ``ids`` from the rarest, their weights ``w``, the signature ``s1, s2`` of its counts.

    Documents with the same term counts are one class: they are similar by 1 and to all others alike, so only
    representatives are compared. If there are fewer than ``k`` copies, neighbours in the postings of each document's rarest
    shared term that have most of their rarest terms in common give a similarity that the k-th best pair has at least. At that
    threshold a pair must share a term that lies, in both documents, before the point (terms by ascending document
    frequency) where the norm of the rest falls below the threshold: frequent terms only enter the index where a document has
    too little else. A shared prefix term makes a candidate only if its product and the norms behind it reach the threshold;
    candidates are then compared in full.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    classes = _classes(rows.select("doc", "s1", "s2"), k).checkpoint()
    copies = classes.agg(F.sum(F.least(F.col("n") - 1, F.lit(k)))).first()[0] or 0
    slack = 10.0 ** -digits
    if copies >= k:
        threshold = 1.0 - slack
    else:
        rarest = rows.join(wide(classes.select(F.col("rep").alias("doc"))), "doc", "left_semi").select(
            "doc", F.element_at("ids", 1).alias("term"), F.slice("ids", 1, HEAD).alias("head"))
        lists = previous_in_group(rarest, "term", ["doc"], ["doc", "head"], prefix="p_").where("p_doc IS NOT NULL")
        alike = top_k(lists.select(F.col("p_doc").alias("u"), F.col("doc").alias("v"), F.size(F.array_intersect("head", "p_head")).alias("c")),
                      [F.desc("c"), F.asc("u"), F.asc("v")], SEEDS * k).select("u", "v")
        best = sorted((r["s"] for r in _cosines(stored(alike, "seeds"), rows, digits).select("s").collect()), reverse=True)
        best = [1.0] * copies + best  # ``SEEDS`` times ``k`` at most
        threshold = max(best[k - 1] - slack, 0.0) if len(best) >= k else 0.0
    prefix = stored(_prefixes(rows, threshold).join(wide(classes.select(F.col("rep").alias("doc"))), "doc", "left_semi"), "prefixes")
    a = prefix.select("id", F.col("doc").alias("u"), F.col("w").alias("wu"), F.col("after").alias("ru"))
    b = prefix.select("id", F.col("doc").alias("v"), F.col("w").alias("wv"), F.col("after").alias("rv"))
    candidates = stored(a.join(wide(b), "id").where((F.col("u") < F.col("v")) & (
        F.col("wu") * F.col("wv") + F.col("ru") * F.col("rv") >= threshold - BLUR)).select("u", "v").distinct(), "candidates")
    found = _cosines(candidates, rows, digits)
    # pairs of classes by their first pair of documents; then the documents of the best k of them
    small = classes.select("rep", F.get("members", F.lit(1)).alias("second"), "members")
    within = small.where("second IS NOT NULL").select(F.lit(1.0).alias("s"), F.col("rep").alias("u"), F.col("second").alias("v"),
                                                      F.col("rep").alias("a"), F.col("rep").alias("b"))
    across = found.select("s", "u", "v", F.col("u").alias("a"), F.col("v").alias("b"))
    order = [F.desc("s"), F.asc("u"), F.asc("v")]
    top = top_k(within.unionByName(across), order, k).select("s", "a", "b")
    side = lambda c: small.select(F.col("rep").alias(c), F.col("members").alias(f"m{c}"))
    pairs = top.join(side("a"), "a").join(side("b"), "b").select("s", F.explode("ma").alias("x"), "mb").select(
        "s", "x", F.explode("mb").alias("y")).where("x <> y")
    pairs = pairs.select("s", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    return top_k(pairs, order, k).select("u", "v", F.col("s").alias("similarity"))
