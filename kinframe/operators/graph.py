"""Lineage graph as two DataFrames: ``nodes(id, ...)`` and ``edges(src, dst, ...)``.

Traversals are frontier loops: each round joins only the new frontier with
the edge table (pre-partitioned on ``src`` once), removes visited nodes with a
``left_anti`` join and checkpoints the state into the session's shared
checkpoint folder, so lineage stays short and a lost executor recomputes one
round, not the whole history. The only driver action per round is the
emptiness test that ends the loop; frontiers, levels and edges are joined by
shuffles (``wide``), so no part of the graph is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.common import wide
from kinframe.operators.sequence import dense_index
from kinframe.session import ensure_checkpoint_dir

# Relation kinds in the order the edge-type list is built; the
# single edge type is the last kind present (merge wins).
RELATION_ORDER = ["finetune", "quantized", "adapter", "merge"]


def build_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per (parent, child) from long-form relations ``(dst, src, rel)``.

    Parents unknown as nodes are dropped (left-semi join). ``edge_types`` lists
    the typed relations present in RELATION_ORDER; ``edge_type`` is the last of
    them, null when the pair is only a generic relation.
    """
    known = relations.join(wide(nodes.select(F.col("id").alias("src"))), "src", "left_semi")
    flags = [F.max(F.when(F.col("rel") == k, 1).otherwise(0)).alias(f"has_{k}") for k in RELATION_ORDER]
    g = known.groupBy("src", "dst").agg(*flags)
    types = F.array_compact(F.array(*[F.when(F.col(f"has_{k}") == 1, F.lit(k)) for k in RELATION_ORDER]))
    last: Column = F.lit(None).cast("string")
    for k in RELATION_ORDER:
        last = F.when(F.col(f"has_{k}") == 1, F.lit(k)).otherwise(last)
    return wide(g.select("src", "dst", last.alias("edge_type"), types.alias("edge_types")))


def edges_known_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(wide(nodes.select(F.col("id").alias("src"))), "src", "left_semi")


def edge_deltas(edges: DataFrame, nodes: DataFrame, likes="likes", downloads="downloads",
                created="created_at") -> DataFrame:
    """Child − parent changes of likes/downloads (absolute and relative) and of
    creation time in whole days (floor)."""
    p = nodes.select(F.col("id").alias("src"), F.col(likes).alias("_pl"),
                     F.col(downloads).alias("_pd"), F.col(created).alias("_pc"))
    c = nodes.select(F.col("id").alias("dst"), F.col(likes).alias("_cl"),
                     F.col(downloads).alias("_cd"), F.col(created).alias("_cc"))
    j = edges.join(wide(p), "src").join(wide(c), "dst")
    day_us = 86400 * 1000000
    secs = F.floor((F.unix_micros(F.col("_cc").cast("timestamp"))
                    - F.unix_micros(F.col("_pc").cast("timestamp"))) / day_us)
    return j.select(
        *edges.columns,
        (F.col("_cl") - F.col("_pl")).cast("bigint").alias("change_in_likes"),
        F.when(F.col("_pl") != 0, (F.col("_cl") - F.col("_pl")) / F.col("_pl")).alias("percentage_change_in_likes"),
        (F.col("_cd") - F.col("_pd")).cast("bigint").alias("change_in_downloads"),
        F.when(F.col("_pd") != 0, (F.col("_cd") - F.col("_pd")) / F.col("_pd")).alias("percentage_change_in_downloads"),
        secs.cast("int").alias("change_in_createdAt_days"))


def finetune_subgraph(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_type") == "finetune")


def nomerge_subgraph(edges: DataFrame) -> DataFrame:
    """All edges except merges; edges without a type are kept (null-safe test)."""
    return edges.where(~F.col("edge_type").eqNullSafe("merge"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    outd = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    ind = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (nodes.select("id").join(wide(ind), "id", "left").join(wide(outd), "id", "left")
            .select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
                    F.coalesce("out_degree", F.lit(0)).alias("out_degree")))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a parent edge."""
    return wide(nodes.select("id").join(wide(edges.select(F.col("dst").alias("id"))), "id", "left_anti"))


def successors(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Direct children of the nodes in ``of(id)``."""
    return edges.join(wide(of.select(F.col("id").alias("src"))), "src", "left_semi").select("src", "dst")


def _edge_index(edges: DataFrame, key: str) -> DataFrame:
    """Edge table hash-partitioned on the join key and checkpointed once, so
    each traversal round shuffles only its frontier."""
    ensure_checkpoint_dir(edges.sparkSession)
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.select("src", "dst").repartition(n, key).checkpoint(eager=True)


def _known(levels: list[DataFrame]) -> DataFrame:
    """All rows of the levels; every 16th level they become one checkpoint, so the plan stays short."""
    if len(levels) > 16:
        levels[:] = [reduce(DataFrame.unionByName, levels).checkpoint(eager=True)]
    return reduce(DataFrame.unionByName, levels)


def bfs_depths(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every node reachable from ``start(id)`` once, at its minimal depth
    (≤ ``max_depth`` if given): ``(id, depth)``. Each level is checkpointed once."""
    idx = _edge_index(edges, "src")
    frontier = start.select("id").distinct().withColumn("depth", F.lit(0)).checkpoint(eager=True)
    levels, d = [frontier], 0
    while max_depth is None or d < max_depth:
        d += 1
        nxt = (frontier.select("id").join(wide(idx), F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
               .distinct().join(wide(_known(levels).select("id")), "id", "left_anti"))
        frontier = nxt.withColumn("depth", F.lit(d)).checkpoint(eager=True)
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return wide(reduce(DataFrame.unionByName, levels))


def closure_pairs(edges: DataFrame, max_len: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """Transitive closure ``(ancestor, descendant, distance)`` with the minimal distance, of all nodes or of those in
    ``start(id)``. Each length is checkpointed once."""
    idx = _edge_index(edges, "src")
    first = edges if start is None else edges.join(wide(start.select(F.col("id").alias("src"))), "src", "left_semi")
    frontier = first.select(F.col("src").alias("ancestor"), F.col("dst").alias("descendant")).distinct().withColumn(
        "distance", F.lit(1)).checkpoint(eager=True)
    levels, d = [frontier], 1
    while max_len is None or d < max_len:
        d += 1
        nxt = (frontier.join(wide(idx), F.col("descendant") == F.col("src")).select("ancestor", F.col("dst").alias("descendant")).distinct()
               .join(wide(_known(levels).select("ancestor", "descendant")), ["ancestor", "descendant"], "left_anti"))
        frontier = nxt.withColumn("distance", F.lit(d)).checkpoint(eager=True)
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return wide(reduce(DataFrame.unionByName, levels))


def descendant_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, n_descendants)``: the size of every node's reachable set.

    A node is *shared* if it has several parents, or reaches one that has, or lies on or below a cycle. Where nothing
    below a node is shared its descendants form a tree, and counts are added up level by level from the leaves. Only the
    shared nodes need sets: their closure among themselves, plus the trees that hang on each of them.
    """
    links = edges.select("src", "dst").distinct().checkpoint(eager=True)
    several = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    up = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    above = bfs_depths(up, several).select("id").checkpoint(eager=True)
    plain = links.join(wide(above.select(F.col("id").alias("dst"))), "dst", "left_anti")  # edges into nodes with a tree below
    tops = (nodes.select("id").union(links.select("src")).union(links.select("dst")).distinct().join(wide(above), "id", "left_anti")
            .join(wide(plain.join(wide(above.select(F.col("id").alias("src"))), "src", "left_anti").select(F.col("dst").alias("id"))), "id", "left_anti"))
    forest = bfs_depths(plain, tops).checkpoint(eager=True)
    parent = wide(plain.select(F.col("dst").alias("id"), F.col("src").alias("parent")))
    top = forest.agg(F.max("depth")).first()[0]
    counts, below = [], None
    for d in range(top if top is not None else -1, -1, -1):
        level = forest.where(F.col("depth") == d).select("id")
        if below is not None:
            level = level.join(wide(below), "id", "left")
        level = level.select("id", (F.coalesce("n", F.lit(0)) if below is not None else F.lit(0).cast("long")).alias("n")).checkpoint(eager=True)
        counts.append(level)
        below = level.join(parent, "id").groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("n") + 1).alias("n"))
    trees = reduce(DataFrame.unionByName, counts) if counts else forest.select("id", F.lit(0).cast("long").alias("n"))
    trees = trees.checkpoint(eager=True)
    shared = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(wide(trees), "id", "left_anti").checkpoint(eager=True)
    hang = (trees.join(parent, "id").join(wide(shared.select(F.col("id").alias("parent"))), "parent", "left_semi")
            .groupBy(F.col("parent").alias("h")).agg(F.sum(F.col("n") + 1).alias("hang")))
    core = links.join(wide(shared.select(F.col("id").alias("src"))), "src", "left_semi").join(
        wide(shared.select(F.col("id").alias("dst"))), "dst", "left_semi")
    reach = closure_pairs(core).select(F.col("ancestor").alias("id"), "descendant", F.lit(1).alias("one"))
    # a node's own trees count once: for itself, unless a cycle has it among its descendants already
    own = shared.join(wide(reach.where("id = descendant").select("id")), "id", "left_anti").select(
        "id", F.col("id").alias("descendant"), F.lit(0).alias("one"))
    sets = reach.unionByName(own).join(wide(hang), F.col("descendant") == F.col("h"), "left").groupBy("id").agg(
        F.sum(F.col("one") + F.coalesce("hang", F.lit(0))).alias("n"))
    counted = wide(trees.unionByName(sets))
    return wide(nodes.select("id").join(counted, "id", "left")).select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_descendants"))


def single_parent_tree(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """child → one parent: of the known parents (``dst, src, pos``) the last listed one wins."""
    known = relations.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return known.groupBy(F.col("dst").alias("id")).agg(F.max_by("src", "pos").alias("parent"))


def layout_positions(depths: DataFrame, desc_counts: DataFrame) -> DataFrame:
    """Per depth level: rank by descendant count (desc, id asc);
    x = rank − (n + 1) / 2, y = −depth / 2."""
    j = depths.join(wide(desc_counts), "id").withColumn("_least", -F.col("n_descendants"))
    placed = dense_index(j, ["depth"], ["_least", "id"], "_at")  # a level can hold most of the nodes
    sizes = placed.groupBy(F.col("depth").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, F.col("depth") == F.col("_d")).select(
        "id", "depth", "n_descendants", (F.col("_at") + 1 - (F.col("_n") + 1) / 2.0).alias("x"), (-F.col("depth") / 2.0).alias("y"))


def motif_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Population of each kinship motif from degree aggregates (no enumeration).

    random pairs N(N−1); edges E; siblings Σ C(k,2); chain3 Σ_(u,v) outdeg(v);
    siblings3 Σ C(k,3); fork_below Σ_(u,v) C(outdeg(v),2);
    uncle Σ_(u,v) outdeg(v)(outdeg(u)−1); chain4 Σ_(u,v) indeg(u)·outdeg(v).
    """
    deg = degrees(nodes, edges)
    dsrc = deg.select(F.col("id").alias("src"), F.col("out_degree").alias("ou"), F.col("in_degree").alias("iu"))
    ddst = deg.select(F.col("id").alias("dst"), F.col("out_degree").alias("ov"))
    e = edges.select("src", "dst").join(wide(dsrc), "src").join(wide(ddst), "dst")
    k = F.col("out_degree").cast("double")
    node_aggs = deg.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(k * (k - 1) / 2).alias("siblings2"),
        F.sum(k * (k - 1) * (k - 2) / 6).alias("siblings3"))
    ov = F.col("ov").cast("double")
    edge_aggs = e.agg(
        F.count(F.lit(1)).cast("double").alias("edges"),
        F.sum(ov).alias("chain3"),
        F.sum(ov * (ov - 1) / 2).alias("fork_below"),
        F.sum(ov * (F.col("ou") - 1)).alias("uncle"),
        F.sum(F.col("iu") * ov).alias("chain4"))
    both = node_aggs.crossJoin(edge_aggs)  # two one-row aggregates
    rows = [("random_pairs", F.col("n") * (F.col("n") - 1)), ("edges", F.col("edges")),
            ("siblings2", F.col("siblings2")), ("chain3", F.col("chain3")),
            ("siblings3", F.col("siblings3")), ("fork_below", F.col("fork_below")),
            ("uncle", F.col("uncle")), ("chain4", F.col("chain4"))]
    return both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("motif"),
                                                    F.coalesce(v, F.lit(0.0)).cast("bigint").alias("population"))
                                           for m, v in rows])).alias("m")).select("m.*")
