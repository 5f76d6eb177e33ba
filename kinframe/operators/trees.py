"""Nested tree documents to flat nodes and edges, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.session import ensure_checkpoint_dir


def _id(v: Column) -> Column:
    """The id without the address of a site in front."""
    return F.regexp_replace(F.try_variant_get(v, "$.model_id", "string"), r"^https?://[^/]+/", "")


def flatten_trees(docs: DataFrame, tree: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(tree, id, downloads, likes, depth, level)`` and edges ``(tree, src, dst)`` of JSON documents whose
    models hold their children as documents again, to any depth.

    A document is read without a schema (VARIANT); one round per level explodes the children, so nothing recurses and a
    deep tree costs rounds, not memory. Missing numbers and depths are 0. An id that occurs several times in a document
    is one node with the attributes of its last occurrence (in reading order, children after their parent) and its
    least level; an edge that occurs several times is one. Models without id, and texts that are no JSON, give nothing.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    level, n, models = docs.select(F.col(tree).alias("tree"), F.try_parse_json(text).alias("v"), F.lit(None).cast("string").alias("parent"),
                                   F.array().cast("array<int>").alias("path")).where("v IS NOT NULL"), 0, None
    while True:
        v = F.col("v")
        number = lambda p: F.coalesce(F.try_variant_get(v, p, "bigint"), F.lit(0)).alias(p.split(".")[-1])
        seen = level.select("tree", "path", "parent", _id(v).alias("id"), number("$.metadata.downloads"), number("$.metadata.likes"),
                            number("$.depth"), F.lit(n).alias("level"), F.try_variant_get(v, "$.children", "array<variant>").alias("kids")).checkpoint()
        models = seen.drop("kids") if models is None else models.unionByName(seen.drop("kids"))
        level = seen.where(F.size("kids") > 0).select("tree", F.col("id").alias("parent"), "path", F.posexplode("kids").alias("at", "v")).select(
            "tree", "v", "parent", F.concat("path", F.array("at")).alias("path"))
        if level.isEmpty():
            break
        n += 1
    known = models.where("id IS NOT NULL")
    last = F.max_by(F.struct("downloads", "likes", "depth"), F.col("path")).alias("a")
    nodes = known.groupBy("tree", "id").agg(last, F.min("level").alias("level")).select(
        "tree", "id", "a.downloads", "a.likes", F.col("a.depth").cast("int").alias("depth"), "level")
    edges = known.where("parent IS NOT NULL").select("tree", F.col("parent").alias("src"), F.col("id").alias("dst")).distinct()
    return nodes, edges
