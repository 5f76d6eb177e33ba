"""SimHash near-duplicates found by pigeonring filtering.

Documents become 64-bit fingerprints, and equal fingerprints one node. The 64 bits are a ring of 5
segments. If two fingerprints differ in at most ``max_bits`` = 4 bits, the pigeonring principle gives a
segment from which every chain of l consecutive segments differs in at most 4 l / 5 bits: 0, 1, 2, 3, 4
for l = 1 .. 5. The first two lengths are joined for (a node's chain of two segments meets another's
with no bit or one bit of the second segment flipped), the next two prune inside the join, and the last
is the full Hamming check. Links join nodes to components, whose least document id names them.

Nothing is collected, and no group of copies is expanded: copies share a node.

Defined cases: a null, empty or blank text has fingerprint 0, linked like any other; a null id never
names a component; repeated rows and ids each get their row; an empty table gives an empty result; other
columns are ignored by :func:`near_duplicates` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinframe.llm.common import small_batches, stored, whole_text
from kinframe.llm.components import connected_components

WIDTHS = (13, 13, 13, 13, 12)
SEED = 42


def fingerprint(text: str, shingle: int) -> int:
    """Bit majority of the hashes of the text's word shingles, as a signed 64-bit integer."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        hashes = np.array([hash64(line, SEED)], "<u8")
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.array([hash64(line[a:b], SEED) for a, b in
                           zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())], "<u8")
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, fp`` per row; the digest is a hash of the text."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())],
                                             names=["id", "digest", "fp"])

    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text")).mapInArrow(
        run, f"id {id_type}, digest long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _chain(first: int, length: int) -> int:
    """Mask of the bits of ``length`` segments of the ring from segment ``first``."""
    mask = 0
    for k in range(first, first + length):
        k %= len(WIDTHS)
        mask |= ((1 << WIDTHS[k]) - 1) << sum(WIDTHS[:k])
    return _signed(mask)


def _bits(k: int) -> list[int]:
    return [_signed(1 << (sum(WIDTHS[:k]) + j)) for j in range(WIDTHS[k])]


def links(nodes: DataFrame) -> DataFrame:
    """``u, v``: pairs of distinct fingerprints (column ``fp``) at 4 bits or fewer."""
    ring = range(len(WIDTHS))
    long = lambda x: F.lit(x).cast("long")

    def keys(pairs: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("i"), long(flip).alias("flip"), long(_chain(i, 2)).alias("mask"))
                         for i, flip in pairs])

    exact = [(i, 0) for i in ring]
    near = exact + [(i, bit) for i in ring for bit in _bits((i + 1) % len(WIDTHS))]

    def keyed(pairs, name):
        return nodes.select(F.col("fp").alias(name), F.explode(keys(pairs)).alias("k")).select(
            name, F.col("k.i").alias("i"), F.col(name).bitwiseXOR(F.col("k.flip")).bitwiseAND(F.col("k.mask")).alias("key"))

    differ = F.col("u").bitwiseXOR(F.col("v"))
    of_chain = lambda n: F.bit_count(differ.bitwiseAND(F.get(
        F.array(*[long(_chain(i, n)) for i in ring]), F.col("i"))))
    # the planner takes the exploded sides for as small as the nodes: without the hint it may broadcast them
    return (keyed(exact, "u").join(keyed(near, "v").hint("merge"), ["i", "key"])
            .filter((F.col("u") < F.col("v")) & (of_chain(3) <= 2) & (of_chain(4) <= 3) & (F.bit_count(differ) <= 4))
            .select("u", "v").distinct())


def _marked(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, fp, root, component_id`` per row; ``root`` is the least fingerprint of the component."""
    marked = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(links(nodes))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(placed.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp, component_id`` per row; the component's least id names it."""
    return _marked(docs, shingle, id_col, text_col).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the least id (null ids last; then the least hash of the text)."""
    marked = _marked(docs, shingle, id_col, text_col)
    firsts = marked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("_f"))
    firsts = firsts.select(F.col("_f.id").alias("_id"), F.col("_f.digest").alias("_digest"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    id_, digest = F.col("row")[id_col], F.xxhash64(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))
    kept = row.join(firsts, id_.eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left_semi")
    # rows that repeat both id and text
    nth = F.row_number().over(W.partitionBy(id_, digest).orderBy(F.lit(0)))
    return kept.select("row", nth.alias("nth")).filter("nth = 1").select("row.*")
