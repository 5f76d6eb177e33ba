"""Keys over all vectors or all documents that need no pair of rows: neighbours, clusters, most similar pairs, depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions.common import r6
from kinframe.operators import graph as g
from kinframe.operators import pairs as P
from kinframe.operators import vectors as V
from kinframe.plans import similarity as ps
from kinframe.plans.registry import query
from kinframe.session import stored
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables

#: Radius and least rows of the registered density clusters.
EPS, MIN_ROWS = 1.1, 3

VEC_SQL = """e AS (SELECT DISTINCT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
un AS (SELECT id, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) AS x FROM e)"""


@query("top_k_neighbors", sql=f"""WITH {VEC_SQL},
s AS (SELECT q.id, n.id AS neighbour, round(list_dot_product(q.x, n.x), 6) AS similarity FROM un q JOIN un n ON n.id <> q.id)
SELECT id, neighbour, similarity, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rk FROM s) z WHERE rk <= 5""")
def q_top_k_neighbors(t: Tables):
    """The five most similar vectors of every vector, among all vectors."""
    found, _ = V.nearest(t.embeddings, 5, F.lit(True))
    return found


@query("silhouette", sql=f"""WITH {VEC_SQL},
d AS (SELECT a.id, a.label, b.label AS other, sum(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x)) AS s, count(*) AS n
  FROM e a JOIN e b ON a.id <> b.id GROUP BY a.id, a.label, b.label),
v AS (SELECT id, max(s / n) FILTER (WHERE label = other) AS a, min(s / n) FILTER (WHERE label <> other) AS b FROM d GROUP BY id)
SELECT count(*) AS items, (SELECT count(DISTINCT label) FROM e) AS clusters, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM v""")
def q_silhouette(t: Tables):
    """Silhouette of the vectors' labels, squared-Euclidean."""
    return V.silhouette(t.embeddings, "vec_id", "label", "embedding").withColumn("silhouette", r6("silhouette"))


@query("density_clusters", sql=f"""WITH RECURSIVE {VEC_SQL},
near AS (SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON list_distance(a.x, b.x) <= {EPS}),
core AS (SELECT u AS id FROM near GROUP BY u HAVING count(*) >= {MIN_ROWS}),
link AS (SELECT u, v FROM near WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core)),
reach AS (SELECT id AS root, id FROM core UNION SELECT r.root, l.v FROM reach r JOIN link l ON l.u = r.id WHERE r.root < l.v),
named AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
border AS (SELECT u AS id, min(cluster) AS cluster FROM near JOIN named ON named.id = near.v WHERE u NOT IN (SELECT id FROM core) GROUP BY u)
SELECT e.id, coalesce(n.cluster, b.cluster, -1) AS cluster, n.id IS NOT NULL AS core FROM e LEFT JOIN named n ON n.id = e.id LEFT JOIN border b ON b.id = e.id""")
def q_density_clusters(t: Tables):
    """Density clusters (DBSCAN) of the vectors; noise is -1."""
    return V.density_clusters(t.embeddings, EPS, MIN_ROWS)


def doc_depths(t: Tables):
    """Depth of every document in the document tree."""
    docs = t.documents.select(F.col("doc_id").alias("id")).distinct()
    edges = b.doc_edge(t).distinct()
    return g.bfs_depths(edges, g.roots(docs, edges)).select(F.col("id").alias("doc"), "depth")


DEPTH_SQL = "dd AS (SELECT doc_id AS doc, (length(bin(doc_id)) - 1) // 2 AS depth FROM documents)"


@query("similarity_vs_depth", sql=f"""WITH {ps.TF_SQL}, {ps.tfidf_sql()}, {DEPTH_SQL},
dots AS (SELECT a.doc AS u, b.doc AS v, sum(a.weight * b.weight) AS s FROM tw a JOIN tw b ON a.term = b.term AND a.doc < b.doc GROUP BY a.doc, b.doc),
p AS (SELECT abs(a.depth - b.depth) AS depth_difference, coalesce(s, 0) AS s FROM dd a JOIN dd b ON a.doc < b.doc LEFT JOIN dots ON u = a.doc AND v = b.doc)
SELECT CAST(depth_difference AS INTEGER) AS depth_difference, count(*) AS pairs, round(avg(s), 6) AS mean_similarity FROM p GROUP BY depth_difference""")
def q_similarity_vs_depth(t: Tables):
    """Mean TF-IDF cosine of all document pairs by their difference in depth."""
    out = P.similarity_by_depth(ps.tfidf_table(t), doc_depths(t))
    return out.select(F.col("depth_difference").cast("int").alias("depth_difference"), "pairs", r6("mean_similarity").alias("mean_similarity"))


@query("top_similar_pairs", sql=f"""WITH {ps.TF_SQL}, {ps.tfidf_sql()},
s AS (SELECT a.doc AS u, b.doc AS v, round(sum(a.weight * b.weight), 6) AS similarity FROM tw a JOIN tw b ON a.term = b.term AND a.doc < b.doc GROUP BY a.doc, b.doc)
SELECT u, v, similarity FROM s ORDER BY similarity DESC, u, v LIMIT 5""")
def q_top_similar_pairs(t: Tables):
    """The five most similar pairs of documents by TF-IDF cosine."""
    tf = stored(ps.unigram_tf(t), "term-counts")
    return P.top_pairs_of(P.tfidf_rows(tf, t.documents.count()), 5).withColumn("similarity", r6("similarity"))
