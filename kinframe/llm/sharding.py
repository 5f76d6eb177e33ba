"""Sharding by sampled splitters (built-in expressions only).

The key of a document is the hash of its text, so equal texts are neighbours. Size-weighted samples of
the keys give the quantile boundaries of many small ranges; the exact bytes of every range are then
known, and ranges that hold more than twice their share (one heavy key, or an unlucky sample) are
subdivided by a hash of the document id. Ranges laid end to end form one line of bytes, which is cut
into equal shards: the law is ``bytes``. A group of equal texts that lies in one range stays whole (its
middle decides); the group of an overfull range is cut where the line is cut.

Only (id, size, checksum, key) rows move; texts are read once and never shuffled. What reaches the
driver is bounded by the parameters ``sample`` and ``n_ranges``.

Defined cases: a null text has size 1 (its bytes count as none) and the checksum of no bytes; ids may be
null or repeat; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinframe.llm.common import stored, whole_text

LAW = "bytes"
_COARSE = 32


def _longs(values: list[int]) -> Column:
    """A constant array (folded to one literal by the optimiser)."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _sampled_bounds(meta: DataFrame, total: int, n_ranges: int, sample: int) -> list[int]:
    """Upper boundaries (exclusive) of ``n_ranges`` ranges of about equal bytes.

    A row is drawn with probability ``sample * size / total`` (at most 1) by a hash of its id, so a key's
    chance follows its bytes and a second run draws the same rows; about ``sample`` rows are collected.
    """
    share = F.least(F.lit(1.0), F.col("size") * F.lit(float(sample) / total))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "id", "key"), 1) / F.lit(float(1 << 63))
    drawn = meta.filter(draw < share).select("key", (F.col("size") / share).alias("w")).collect()
    rows = sorted((r["key"], r["w"]) for r in drawn)
    step, seen, bounds = sum(w for _, w in rows) / n_ranges, 0.0, []
    for key, w in rows:
        if seen >= step * (len(bounds) + 1):
            bounds += [key] * int(min(seen // step, n_ranges - 1) - len(bounds))
        seen += w
    return sorted(set(bounds))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at or below the key: among every 32nd first, then among the 32 after it."""
    if not bounds:
        return F.lit(0)
    coarse = F.size(F.filter(_longs(bounds[_COARSE - 1::_COARSE]), lambda b: b <= key))
    near = F.slice(_longs(bounds), coarse * _COARSE + 1, _COARSE)
    return coarse * _COARSE + F.size(F.filter(near, lambda b: b <= key))


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    n_ranges: int = 1024, sample: int = 16384) -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, shard, slot``.

    ``slot`` numbers the documents of a shard from 0 without gaps.
    """
    text = whole_text(text_col)
    meta = stored(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("crc"),
        F.xxhash64(F.col(text_col)).alias("key")), "shard-meta")
    total = meta.agg(F.sum("size")).first()[0] or 0
    if not total:
        return meta.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
                           F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranged = meta.withColumn("r", _range_of(F.col("key"), _sampled_bounds(meta, total, n_ranges, sample)))

    # at most n_ranges rows; the parts of overfull ranges sum to at most n_ranges more
    held = {r["r"]: r["b"] for r in ranged.groupBy("r").agg(F.sum("size").alias("b")).collect()}
    target = max(1, total // n_ranges)
    parts = [-(-held.get(r, 0) // target) if held.get(r, 0) > 2 * target else 1 for r in range(n_ranges)]
    first = [sum(parts[:r]) for r in range(n_ranges)]
    at = lambda values, i: F.get(_longs(values), i)
    fine = ranged.select(
        "id", "size", "crc", "key", (at(parts, F.col("r")) > 1).alias("cut"),
        (at(first, F.col("r")) + F.pmod(F.xxhash64(F.lit("part"), "id"), at(parts, F.col("r")))).alias("f"))
    size_of = {r["f"]: r["b"] for r in fine.groupBy("f").agg(F.sum("size").alias("b")).collect()}
    before, base = 0, []
    for f in range(sum(parts)):
        base.append(before)
        before += size_of.get(f, 0)

    line = W.partitionBy("f").orderBy("key", "id", "crc", "size")
    group = W.partitionBy("f", "key")
    ranked = fine.select("*", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    ranked = ranked.select(
        "*", F.min(F.col("upto") - F.col("size")).over(group).alias("g_from"),
        F.sum("size").over(group).alias("g_size"))
    twice_mid = F.when(F.col("cut"), 2 * F.col("upto") - F.col("size")).otherwise(2 * F.col("g_from") + F.col("g_size"))
    shard = F.least(F.lit(n_shards - 1), F.floor(
        (2 * at(base, F.col("f")) + twice_mid) * n_shards / F.lit(2.0 * total))).cast("int")
    placed = ranked.select("id", "size", "crc", "key", "f", shard.alias("shard"))

    # rows of a shard in earlier ranges: one row per (range, shard met there), at most parts + n_shards
    counts = placed.groupBy("f", "shard").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("f", "shard", F.coalesce(F.sum("n").over(
        W.partitionBy("shard").orderBy("f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    rank = F.row_number().over(W.partitionBy("f", "shard").orderBy("key", "id", "crc", "size"))
    return (placed.withColumn("rank", rank).join(F.broadcast(offsets), ["f", "shard"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("o") + F.col("rank") - 1).cast("long").alias("slot")))


def write_shards(docs: DataFrame, assignment: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole documents as Parquet folders ``shard=0 ..`` (ids must be unique for this)."""
    docs.join(assignment.select(id_col, "shard"), id_col).write.partitionBy("shard").parquet(path)
