"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.functions.common import wide
from kinframe.session import ensure_checkpoint_dir


def components(links: DataFrame) -> DataFrame:
    """``u, v`` links in any direction to ``node, root``, the root being the least node of the component. Nodes that
    only link to themselves are their own root. Each round is checkpointed; only a count and a checksum reach the
    driver; minima are pre-aggregated, so a node with many links is no hot group."""
    ensure_checkpoint_dir(links.sparkSession)
    alone = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    state = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(wide(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(wide(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    return alone.join(wide(state.select(F.col("u").alias("node"), F.col("v").alias("root"))), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
