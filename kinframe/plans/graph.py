"""Lineage graph keys (§2.7, parts of §2.3/§2.4/§2.6) over the catalog binding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinframe.functions.common import r6, wide
from kinframe.operators import graph as g
from kinframe.operators.sequence import dense_index
from kinframe.operators.topk import top_k_per_group
from kinframe.plans.registry import query
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables


def nodes(t: Tables):
    return b.cat(t)


def edges(t: Tables):
    return g.build_edges(b.lin_rel(t), t.part.select(F.col("p_partkey").alias("id")))  # the ids of the catalog


def depths(t: Tables, max_depth=None):
    e = edges(t)
    return g.bfs_depths(e, g.roots(t.part.select(F.col("p_partkey").alias("id")), e), max_depth=max_depth)


def flat(df):
    """Array columns → comma-joined text for comparison with the oracle."""
    return df.withColumn("edge_types", F.array_join("edge_types", ",")) if "edge_types" in df.columns else df


# ------------------------------------------------------------------- SQL CTEs
EDGES = """edges AS (
SELECT src, dst,
  CASE WHEN max(CASE WHEN rel = 'merge' THEN 1 ELSE 0 END) = 1 THEN 'merge'
       WHEN max(CASE WHEN rel = 'adapter' THEN 1 ELSE 0 END) = 1 THEN 'adapter'
       WHEN max(CASE WHEN rel = 'quantized' THEN 1 ELSE 0 END) = 1 THEN 'quantized'
       WHEN max(CASE WHEN rel = 'finetune' THEN 1 ELSE 0 END) = 1 THEN 'finetune' END AS edge_type,
  concat_ws(',', CASE WHEN max(CASE WHEN rel = 'finetune' THEN 1 ELSE 0 END) = 1 THEN 'finetune' END,
                 CASE WHEN max(CASE WHEN rel = 'quantized' THEN 1 ELSE 0 END) = 1 THEN 'quantized' END,
                 CASE WHEN max(CASE WHEN rel = 'adapter' THEN 1 ELSE 0 END) = 1 THEN 'adapter' END,
                 CASE WHEN max(CASE WHEN rel = 'merge' THEN 1 ELSE 0 END) = 1 THEN 'merge' END) AS edge_types
FROM lin_rel WHERE src IN (SELECT id FROM cat) GROUP BY src, dst)"""
ROOTS = "roots AS (SELECT id FROM cat WHERE id NOT IN (SELECT dst FROM edges))"
DEPTH = """walk(id, depth) AS (SELECT id, 0 FROM roots UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id),
dep AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""
CLOSURE = """clos(ancestor, descendant, distance) AS (SELECT src, dst, 1 FROM edges UNION SELECT c.ancestor, e.dst, c.distance + 1 FROM clos c JOIN edges e ON e.src = c.descendant),
cl AS (SELECT ancestor, descendant, min(distance) AS distance FROM clos GROUP BY ancestor, descendant),
dc AS (SELECT n.id, CAST(count(cl.descendant) AS BIGINT) AS n_descendants FROM cat n LEFT JOIN cl ON cl.ancestor = n.id GROUP BY n.id)"""
DEG = """deg AS (SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM cat n
  LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) i ON i.dst = n.id
  LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = n.id)"""


def gsql(body: str, *ctes: str, recursive: bool = False) -> str:
    return b.with_views(body, "cat", "lin_rel", ctes=(EDGES,) + ctes, recursive=recursive)


# ----------------------------------------------------------------------- keys
@query("build_edges", sql=gsql("SELECT * FROM edges"))
def q_build_edges(t: Tables):
    return flat(edges(t))


@query("edges_known_parents", sql=gsql(
    "SELECT e.src, e.dst, e.edge_type FROM edges e WHERE e.src IN (SELECT id FROM cat)"))
def q_edges_known_parents(t: Tables):
    return g.edges_known_parents(edges(t), nodes(t)).select("src", "dst", "edge_type")


@query("edge_deltas", sql=gsql(
    """SELECT e.src, e.dst, e.edge_type, e.edge_types, CAST(c.likes - p.likes AS BIGINT) AS change_in_likes,
  round(CASE WHEN p.likes <> 0 THEN (c.likes - p.likes) / p.likes END, 6) AS percentage_change_in_likes,
  CAST(c.downloads - p.downloads AS BIGINT) AS change_in_downloads,
  round(CASE WHEN p.downloads <> 0 THEN (c.downloads - p.downloads) / p.downloads END, 6) AS percentage_change_in_downloads,
  CAST(floor((epoch_us(c.created_at) - epoch_us(p.created_at)) / 86400000000) AS INTEGER) AS change_in_createdAt_days
FROM edges e JOIN cat p ON p.id = e.src JOIN cat c ON c.id = e.dst"""))
def q_edge_deltas(t: Tables):
    d = g.edge_deltas(edges(t), nodes(t))
    return flat(d.withColumn("percentage_change_in_likes", r6("percentage_change_in_likes"))
                 .withColumn("percentage_change_in_downloads", r6("percentage_change_in_downloads")))


@query("finetune_subgraph", sql=gsql("SELECT * FROM edges WHERE edge_type = 'finetune'"))
def q_finetune_subgraph(t: Tables):
    return flat(g.finetune_subgraph(edges(t)))


@query("nomerge_subgraph", sql=gsql("SELECT * FROM edges WHERE edge_type IS DISTINCT FROM 'merge'"))
def q_nomerge_subgraph(t: Tables):
    return flat(g.nomerge_subgraph(edges(t)))


@query("degrees", sql=gsql("SELECT * FROM deg", DEG))
def q_degrees(t: Tables):
    return g.degrees(nodes(t), edges(t))


@query("roots", sql=gsql(
    """SELECT r.id, dc.n_descendants, CAST(row_number() OVER (ORDER BY dc.n_descendants DESC, r.id) AS INTEGER) AS rank
FROM roots r JOIN dc ON dc.id = r.id""", ROOTS, CLOSURE, recursive=True))
def q_roots(t: Tables):
    e = edges(t)
    n = nodes(t)
    r = g.roots(n, e).join(g.descendant_counts(n, e), "id").withColumn("least", -F.col("n_descendants"))
    return dense_index(r, [], ["least", "id"], "at").select("id", "n_descendants", (F.col("at") + 1).cast("int").alias("rank"))


@query("successors", sql=gsql("SELECT src, dst FROM edges WHERE src IN (SELECT id FROM roots)", ROOTS))
def q_successors(t: Tables):
    e = edges(t)
    return g.successors(e, g.roots(nodes(t), e))


@query("bfs_descendants", sql=gsql(
    """SELECT d.id, d.depth, CAST(coalesce(o.c, 0) AS BIGINT) AS children_count FROM dep d
LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = d.id WHERE d.depth <= 3""",
    ROOTS, DEPTH, recursive=True))
def q_bfs_descendants(t: Tables):
    e = edges(t)
    d = g.bfs_depths(e, g.roots(nodes(t), e), max_depth=3)
    kids = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    return d.join(wide(kids), "id", "left").select("id", "depth", F.coalesce("c", F.lit(0)).alias("children_count"))


@query("depth_limit", sql=gsql("SELECT id, depth FROM dep WHERE depth <= 2", ROOTS, DEPTH, recursive=True))
def q_depth_limit(t: Tables):
    return depths(t, max_depth=2)


@query("full_descendants", sql=gsql(
    """SELECT r.id AS root, cl.descendant, cl.distance FROM roots r JOIN cl ON cl.ancestor = r.id""",
    ROOTS, CLOSURE, recursive=True))
def q_full_descendants(t: Tables):
    e = edges(t)
    return g.closure_pairs(e, start=g.roots(nodes(t), e)).select(F.col("ancestor").alias("root"), "descendant", "distance")


@query("ancestors", sql=gsql(
    "SELECT descendant AS id, ancestor, distance FROM cl", ROOTS, CLOSURE, recursive=True))
def q_ancestors(t: Tables):
    rev = edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    cl = g.closure_pairs(rev)
    return cl.select(F.col("ancestor").alias("id"), F.col("descendant").alias("ancestor"), "distance")


@query("descendant_counts", sql=gsql("SELECT * FROM dc", ROOTS, CLOSURE, recursive=True))
def q_descendant_counts(t: Tables):
    return g.descendant_counts(nodes(t), edges(t))


@query("single_parent_tree", sql="""WITH listed AS (
  SELECT p_partkey AS dst, CAST(floor(p_partkey / 8) AS BIGINT) AS src, 1 AS pos FROM part WHERE p_partkey >= 8
  UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 16) AS BIGINT), 2 FROM part WHERE p_partkey >= 16 AND p_partkey % 10 = 3
  UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 8) AS BIGINT), 3 FROM part WHERE p_partkey >= 8 AND (p_partkey % 9 = 0 OR p_partkey % 25 = 2)
  UNION ALL SELECT p_partkey, 1000000 + p_partkey, 4 FROM part WHERE p_partkey % 50 = 7
  UNION ALL SELECT p_partkey, p_partkey - 5, 5 FROM part WHERE p_partkey >= 8 AND p_partkey % 40 = 6)
SELECT dst AS id, arg_max(src, pos) AS parent FROM listed WHERE src IN (SELECT p_partkey FROM part) GROUP BY dst""")
def q_single_parent_tree(t: Tables):
    return g.single_parent_tree(b.lin_rel_listed(t), nodes(t))


@query("layout_positions", sql=gsql(
    """SELECT d.id, d.depth, dc.n_descendants,
  row_number() OVER (PARTITION BY d.depth ORDER BY dc.n_descendants DESC, d.id) - (count(*) OVER (PARTITION BY d.depth) + 1) / 2.0 AS x,
  -d.depth / 2.0 AS y
FROM dep d JOIN dc ON dc.id = d.id""", ROOTS, DEPTH, CLOSURE, recursive=True))
def q_layout_positions(t: Tables):
    e = edges(t)
    n = nodes(t)
    return g.layout_positions(g.bfs_depths(e, g.roots(n, e)), g.descendant_counts(n, e))


@query("motif_counts", sql=gsql(
    """SELECT motif, CAST(population AS BIGINT) AS population FROM (
  SELECT 'random_pairs' AS motif, (SELECT count(*) * (count(*) - 1) FROM cat) AS population
  UNION ALL SELECT 'edges', (SELECT count(*) FROM edges)
  UNION ALL SELECT 'siblings2', (SELECT sum(out_degree * (out_degree - 1) / 2) FROM deg)
  UNION ALL SELECT 'siblings3', (SELECT sum(out_degree * (out_degree - 1) * (out_degree - 2) / 6) FROM deg)
  UNION ALL SELECT 'chain3', (SELECT sum(v.out_degree) FROM edges e JOIN deg v ON v.id = e.dst)
  UNION ALL SELECT 'fork_below', (SELECT sum(v.out_degree * (v.out_degree - 1) / 2) FROM edges e JOIN deg v ON v.id = e.dst)
  UNION ALL SELECT 'uncle', (SELECT sum(v.out_degree * (u.out_degree - 1)) FROM edges e JOIN deg v ON v.id = e.dst JOIN deg u ON u.id = e.src)
  UNION ALL SELECT 'chain4', (SELECT sum(u.in_degree * v.out_degree) FROM edges e JOIN deg v ON v.id = e.dst JOIN deg u ON u.id = e.src)) x""",
    DEG))
def q_motif_counts(t: Tables):
    return g.motif_counts(nodes(t), edges(t))


@query("distinct_union_parents", sql=b.with_views(
    """SELECT dst AS id, string_agg(DISTINCT CAST(src AS VARCHAR), ',' ORDER BY CAST(src AS VARCHAR)) AS parents,
  CAST(count(DISTINCT src) AS INTEGER) AS n_parents FROM lin_rel GROUP BY dst""", "lin_rel"))
def q_distinct_union_parents(t: Tables):
    r = b.lin_rel(t)
    per_kind = r.groupBy("dst").pivot("rel", ["generic", "finetune", "quantized", "adapter", "merge"]) \
                .agg(F.collect_list(F.col("src").cast("string")))
    lists = [F.coalesce(F.col(k), F.array().cast("array<string>"))
             for k in ["generic", "finetune", "quantized", "adapter", "merge"]]
    u = F.array_sort(F.array_distinct(F.concat(*lists)))
    return per_kind.select(F.col("dst").alias("id"), F.array_join(u, ",").alias("parents"),
                           F.size(u).alias("n_parents"))


@query("attach_node_attributes", sql=gsql(
    """SELECT n.id, n.model_id, n.likes, d.n_chars AS card_chars, d.lang AS card_lang
FROM cat n LEFT JOIN documents d ON d.doc_id = n.id WHERE n.id IN (SELECT src FROM edges WHERE edge_type = 'finetune' UNION SELECT dst FROM edges WHERE edge_type = 'finetune')"""))
def q_attach_node_attributes(t: Tables):
    e = g.finetune_subgraph(edges(t))
    members = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    n = nodes(t).join(members, "id", "left_semi").select("id", "model_id", "likes")
    cards = t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("card_chars"),
                               F.col("lang").alias("card_lang"))
    return n.join(wide(cards), "id", "left")


@query("dedup_lineage", sql=b.with_views(
    """SELECT dst AS model_id, src AS parent_model_id, rel AS parent_relationship FROM (
  SELECT *, row_number() OVER (PARTITION BY dst, src ORDER BY CASE rel WHEN 'generic' THEN 0 WHEN 'finetune' THEN 1 WHEN 'quantized' THEN 2 WHEN 'adapter' THEN 3 ELSE 4 END) AS rn FROM lin_rel) x WHERE rn = 1""",
    "lin_rel"))
def q_dedup_lineage(t: Tables):
    """First relation row per (model, parent) in a fixed relation order."""
    order = (F.when(F.col("rel") == "generic", 0).when(F.col("rel") == "finetune", 1)
             .when(F.col("rel") == "quantized", 2).when(F.col("rel") == "adapter", 3).otherwise(4))
    r = b.lin_rel(t).withColumn("_o", order)
    first = r.groupBy("dst", "src").agg(F.min_by("rel", "_o").alias("rel"))
    return first.select(F.col("dst").alias("model_id"), F.col("src").alias("parent_model_id"),
                        F.col("rel").alias("parent_relationship"))


@query("roots_filter", sql=gsql(
    "SELECT n.id, n.model_id, n.model_id AS base_model FROM cat n JOIN dep d ON d.id = n.id WHERE d.depth = 0",
    ROOTS, DEPTH, recursive=True))
def q_roots_filter(t: Tables):
    """Models without a known parent (depth 0): an anti join, no traversal."""
    children = edges(t).select(F.col("dst").alias("id"))
    return (nodes(t).join(children, "id", "left_anti")
            .select("id", "model_id", F.col("model_id").alias("base_model")))


@query("sorted_by_depth", sql=gsql(
    "SELECT d.depth, n.id, n.model_id FROM dep d JOIN cat n ON n.id = d.id", ROOTS, DEPTH, recursive=True))
def q_sorted_by_depth(t: Tables):
    return depths(t).join(nodes(t), "id").select("depth", "id", "model_id").orderBy("depth", "id")


LISTED = 100


@query("top_children_by_downloads", sql=gsql(
    f"""SELECT src, edge_type, CAST(count(*) FILTER (WHERE rn <= {LISTED}) AS BIGINT) AS n_children, count(*) > {LISTED} AS truncated,
  string_agg(model_id, ',' ORDER BY downloads DESC, model_id) FILTER (WHERE rn <= {LISTED}) AS children FROM (
  SELECT e.src, e.edge_type, c.model_id, c.downloads,
         row_number() OVER (PARTITION BY e.src, e.edge_type ORDER BY c.downloads DESC, c.model_id) AS rn
  FROM edges e JOIN cat c ON c.id = e.dst WHERE e.edge_type IS NOT NULL) x GROUP BY src, edge_type"""))
def q_top_children_by_downloads(t: Tables):
    """Up to 100 children per parent and relation by downloads; ``truncated`` says whether there are more."""
    e = edges(t).where(F.col("edge_type").isNotNull())
    c = nodes(t).select(F.col("id").alias("dst"), "model_id", "downloads")
    j = e.join(c, "dst").select("src", "edge_type", "model_id", "downloads")
    top = top_k_per_group(j, ["src", "edge_type"], [F.desc("downloads"), F.asc("model_id")], LISTED + 1,
                          salt_cols=["model_id"])
    agg = top.groupBy("src", "edge_type").agg(F.sort_array(F.collect_list(F.struct("rank", "model_id"))).alias("_l"))
    first = F.slice("_l", 1, LISTED)
    return agg.select("src", "edge_type", F.size(first).cast("long").alias("n_children"), (F.size("_l") > LISTED).alias("truncated"),
                      F.array_join(F.transform(first, lambda s: s["model_id"]), ",").alias("children"))


@query("capped_children", sql="""SELECT o_custkey, o_orderpriority, CAST(count(*) AS BIGINT) AS n_children,
  array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 3), ',') AS children, CAST(least(count(*), 3) AS BIGINT) AS kept, count(*) > 3 AS truncated,
  bool_or(count(*) > 3) OVER (PARTITION BY o_custkey) AS model_truncated
FROM orders GROUP BY o_custkey, o_orderpriority""")
def q_capped_children(t: Tables):
    """Children listings capped at K=3 per (parent, relation), first ids first; the flags mark a hit cap."""
    k, per = 3, ["o_custkey", "o_orderpriority"]
    first = top_k_per_group(t.orders.select(*per, "o_orderkey"), per, [F.asc("o_orderkey")], k, salt_cols=["o_orderkey"])
    lists = first.groupBy(*per).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("children"))
    o = t.orders.groupBy(*per).agg(F.count(F.lit(1)).alias("n_children"))
    return o.join(lists, per).select(
        *per, "n_children", "children", F.least("n_children", F.lit(k)).cast("bigint").alias("kept"),
        (F.col("n_children") > k).alias("truncated"),
        F.bool_or(F.col("n_children") > k).over(Window.partitionBy("o_custkey")).alias("model_truncated"))
