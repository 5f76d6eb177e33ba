"""Connected components by alternating large-star and small-star (Kiveris et al., 2014) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``u, v`` links (longs, any direction) to ``node, root``: root is the least node of the component, and
    nodes without links don't occur. Every round is a stored table; minima are pre-aggregated, so a node
    with many links is no hot group, and nothing but a count and a checksum reaches the driver."""
    stars = stored(_oriented(links), "links")
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == state:
            break
        seen = state
        stars = stored(_small_star(_large_star(stars)), "stars")
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links from the greater to the lesser node."""
    return links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Greater neighbours of a node link to the least node around it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Lesser neighbours of a node, and the node, link to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
