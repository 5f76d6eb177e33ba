"""Trait mutation along lineage edges: counters, transition graph, direction.

Inputs are plain DataFrames:
  * node traits ``(id, traits array<string>)`` (array form of any trait; a
    single-valued trait is a one-element array),
  * edges ``(src, dst)`` or edges that already carry ``src_traits``/``dst_traits``.
All aggregations are over trait *values* (a small domain), so partial
aggregation collapses them map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.operators.sequence import dense_index
from kinframe.operators.topk import top_k

# Trait placeholders dropped from top-trait rankings.
PLACEHOLDER_TRAITS = ["other", "unknown", "None", "", "[]"]


def as_trait_array(c: Column) -> Column:
    """Scalar trait → one-element array; null/empty string → empty array."""
    return F.when(c.isNull() | (c.cast("string") == ""), F.array().cast("array<string>")) \
            .otherwise(F.array(c.cast("string")))


def attach_traits(edges: DataFrame, node_traits: DataFrame, trait_col: str = "traits") -> DataFrame:
    """Join parent and child trait arrays onto edges (two equi joins on id).

    Edges whose ends have no trait row are dropped (the reference skips edges
    whose endpoint lacks the attribute).
    """
    p = node_traits.select(F.col("id").alias("src"), F.col(trait_col).alias("src_traits"))
    c = node_traits.select(F.col("id").alias("dst"), F.col(trait_col).alias("dst_traits"))
    return edges.join(p, "src").join(c, "dst")


def trait_counter(node_traits_long: DataFrame, trait_col: str = "trait") -> DataFrame:
    """(trait, appearances): occurrences over all nodes; empty values ignored."""
    return (node_traits_long.where(F.col(trait_col).isNotNull())
            .groupBy(F.col(trait_col).alias("trait"))
            .agg(F.count(F.lit(1)).alias("appearances")))


def trait_transitions(edges_with_traits: DataFrame) -> DataFrame:
    """Trait transition graph ``(from_trait, to_trait, added_transitions,
    removed_transitions, transitions)``.

    Per edge: every added trait a (child minus parent) yields p→a for each
    parent trait p; every removed trait r (parent minus child) yields r→c for
    each child trait c. A substitution therefore counts once as added and once
    as removed.
    """
    src, dst = F.col("src_traits"), F.col("dst_traits")

    def flows(one, other, turn) -> Column:
        return F.flatten(F.transform(one, lambda x: F.transform(other, lambda y: turn(x, y))))

    added = flows(F.array_except(dst, src), src, lambda x, p: F.struct(
        p.alias("from_trait"), x.alias("to_trait"), F.lit(1).alias("a"), F.lit(0).alias("r")))
    removed = flows(F.array_except(src, dst), dst, lambda x, c: F.struct(
        x.alias("from_trait"), c.alias("to_trait"), F.lit(0).alias("a"), F.lit(1).alias("r")))
    none = F.array().cast("array<struct<from_trait:string,to_trait:string,a:int,r:int>>")
    one_pass = F.concat(F.coalesce(added, none), F.coalesce(removed, none))
    return (edges_with_traits.select(F.explode(one_pass).alias("f")).select("f.*")
            .groupBy("from_trait", "to_trait")
            .agg(F.sum("a").cast("bigint").alias("added_transitions"),
                 F.sum("r").cast("bigint").alias("removed_transitions"),
                 F.count(F.lit(1)).alias("transitions")))


def trait_appearances(transitions: DataFrame, counter: DataFrame) -> DataFrame:
    """Trait nodes of the transition graph with their total appearances (0 if absent)."""
    nodes = (transitions.select(F.col("from_trait").alias("trait"))
             .union(transitions.select(F.col("to_trait").alias("trait"))).distinct())
    return (nodes.join(counter, "trait", "left")
            .select("trait", F.coalesce("appearances", F.lit(0)).cast("bigint").alias("total_appearances")))


def _canonical(transitions: DataFrame) -> DataFrame:
    a = F.least("from_trait", "to_trait")
    b = F.greatest("from_trait", "to_trait")
    fwd = F.when(F.col("from_trait") == a, F.col("transitions")).otherwise(F.lit(0))
    rev = F.when(F.col("from_trait") == a, F.lit(0)).otherwise(F.col("transitions"))
    return (transitions.where(F.col("from_trait") != F.col("to_trait"))
            .groupBy(a.alias("trait_a"), b.alias("trait_b"))
            .agg(F.sum(fwd).cast("bigint").alias("n_ab"), F.sum(rev).cast("bigint").alias("n_ba")))


def trait_ratios(transitions: DataFrame) -> DataFrame:
    """Per unordered pair (trait_a < trait_b) with traffic: n(a→b)/(n(a→b)+n(b→a))."""
    c = _canonical(transitions)
    return c.where((F.col("n_ab") + F.col("n_ba")) > 0).select(
        "trait_a", "trait_b", "n_ab", "n_ba",
        (F.col("n_ab") / (F.col("n_ab") + F.col("n_ba"))).alias("ratio"))


def oriented_traits(transitions: DataFrame) -> DataFrame:
    """One edge per unordered pair in the direction of the larger flow:
    ``(from_trait, to_trait, traffic = |net|, total_n = gross)``; ties dropped."""
    c = _canonical(transitions)
    net = F.col("n_ab") - F.col("n_ba")
    return c.where(net != 0).select(
        F.when(net > 0, F.col("trait_a")).otherwise(F.col("trait_b")).alias("from_trait"),
        F.when(net > 0, F.col("trait_b")).otherwise(F.col("trait_a")).alias("to_trait"),
        F.abs(net).alias("traffic"),
        (F.col("n_ab") + F.col("n_ba")).alias("total_n"))


def oriented_totals(oriented: DataFrame) -> DataFrame:
    return oriented.agg(F.coalesce(F.sum("traffic"), F.lit(0)).cast("bigint").alias("total_traffic"),
                        F.coalesce(F.sum("total_n"), F.lit(0)).cast("bigint").alias("total_n"),
                        F.count(F.lit(1)).alias("edge_count"))


def top_traits(appearances: DataFrame, n: int, placeholders=PLACEHOLDER_TRAITS) -> DataFrame:
    """Top (n+5) traits by appearances, placeholders dropped, first n kept: at most n + 5 rows are ranked."""
    first = top_k(appearances, [F.desc("total_appearances"), F.asc("trait")], n + 5)
    kept = first.where(~F.col("trait").isin(placeholders) & F.col("trait").isNotNull())
    w = Window.orderBy(F.desc("total_appearances"), F.asc("trait"))
    return (kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("trait", "total_appearances", "rank"))


def net_flow_order(transitions: DataFrame) -> DataFrame:
    """Order traits by net outflow (outgoing − incoming transitions), ties by name.

    A scalable stand-in for the exact maximum-compatibility ordering: traits
    that mostly flow into others come first. Returns (trait, net_flow, position).
    """
    ends = F.explode(F.array(F.struct(F.col("from_trait").alias("trait"), F.col("transitions").alias("f")),
                             F.struct(F.col("to_trait").alias("trait"), (-F.col("transitions")).alias("f"))))
    net = transitions.select(ends.alias("e")).select("e.*").groupBy("trait").agg(F.sum("f").cast("bigint").alias("net_flow"))
    placed = dense_index(net.withColumn("_least", -F.col("net_flow")), [], ["_least", "trait"], "_at")
    return placed.select("trait", "net_flow", (F.col("_at") + 1).cast("int").alias("position"))


def _positioned(transitions: DataFrame, order: DataFrame) -> DataFrame:
    """Transitions with the positions of both ends (Spark broadcasts the order only if it is small)."""
    pf = order.select(F.col("trait").alias("from_trait"), F.col("position").alias("from_pos"))
    pt = order.select(F.col("trait").alias("to_trait"), F.col("position").alias("to_pos"))
    return transitions.join(pf, "from_trait").join(pt, "to_trait")


def order_score(transitions: DataFrame, order: DataFrame) -> DataFrame:
    """Traffic compatible with a total order, total traffic among ordered traits, share."""
    p = _positioned(transitions, order).where(F.col("from_pos") != F.col("to_pos"))
    comp = F.sum(F.when(F.col("from_pos") < F.col("to_pos"), F.col("transitions")).otherwise(0))
    tot = F.sum("transitions")
    return p.agg(F.coalesce(comp, F.lit(0)).cast("bigint").alias("compatible_traffic"),
                 F.coalesce(tot, F.lit(0)).cast("bigint").alias("total_traffic")) \
            .withColumn("compatible_share",
                        F.when(F.col("total_traffic") > 0,
                               F.col("compatible_traffic") / F.col("total_traffic")))


def order_violations(transitions: DataFrame, order: DataFrame) -> DataFrame:
    """Transition edges that go from a later to an earlier trait of the order."""
    return (_positioned(transitions, order).where(F.col("from_pos") > F.col("to_pos"))
            .select("from_trait", "to_trait", "transitions", "from_pos", "to_pos"))


def mutation_rate(edges_with_traits: DataFrame) -> DataFrame:
    """Σ Jaccard distance of trait sets over edges with traits on both ends,
    the number of such edges and their ratio."""
    e = edges_with_traits.where((F.size("src_traits") > 0) & (F.size("dst_traits") > 0))
    u = F.size(F.array_union("src_traits", "dst_traits"))
    i = F.size(F.array_intersect("src_traits", "dst_traits"))
    return (e.agg(F.coalesce(F.sum((u - i) / u), F.lit(0.0)).alias("mutations"),
                  F.count(F.lit(1)).alias("traffic"))
            .withColumn("mutation_rate", F.when(F.col("traffic") > 0, F.col("mutations") / F.col("traffic"))))
