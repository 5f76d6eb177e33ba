"""Source / sink / ingestion keys (§2.1, §2.9): round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.functions.common import wide
from kinframe.functions.text import secret_flag
from kinframe.operators import graph as g
from kinframe.operators.sequence import running_sum
from kinframe.operators.trees import flatten_trees
from kinframe.plans import graph as pg
from kinframe.plans.catalog import TAGS_SQL, tags
from kinframe.plans.registry import query
from kinframe.plans.sqlfn import q
from kinframe.plans.text import SECRETS
from kinframe.sources import bindings as b
from kinframe.sources import files as fs
from kinframe.sources.tables import Tables
from kinframe.streaming import ingest

CHUNK = 500


def catalog_with_cards(t: Tables):
    c = b.cat(t).select("id", "model_id")
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("card"))
    return c.join(d, "id", "left")


@query("scan_catalog_csv", sql=b.with_views(
    "SELECT c.id, c.model_id, d.text AS card FROM cat c LEFT JOIN documents d ON d.doc_id = c.id", "cat"))
def q_scan_catalog_csv(t: Tables):
    """Catalog with multi-line card text written as CSV and read back."""
    path = fs.scratch_path(t.spark, "catalog-csv")
    fs.write_catalog_csv(catalog_with_cards(t), path)
    return fs.scan_catalog_csv(t.spark, path)


@query("union_tree_files", sql=b.with_views(
    "SELECT library_name AS tree, id, model_id, 'tree=' || library_name AS source_folder FROM cat", "cat"))
def q_union_tree_files(t: Tables):
    """One CSV folder per tree (brand); the folder scan recovers every row and the folder of its source file."""
    path = fs.scratch_path(t.spark, "trees")
    c = b.cat(t).select("id", "model_id", F.col("library_name").alias("tree"))
    c.write.mode("overwrite").partitionBy("tree").option("header", True).option("escape", '"').csv(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("model_id", T.StringType())])
    u = fs.union_tree_files(t.spark, path, schema)  # partition discovery restores `tree`
    folder = F.regexp_extract("source_file", r"(tree=[^/]*)/[^/]*$", 1)
    return u.select("tree", "id", "model_id", F.url_decode(F.url_decode(folder)).alias("source_folder"))  # names and paths are escaped


@query("scan_tree_json", sql=pg.gsql(
    """SELECT n.model_id, CAST(d.depth AS INTEGER) AS depth, CAST(coalesce(o.c, 0) AS INTEGER) AS children_count
FROM dep d JOIN cat n ON n.id = d.id LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = d.id""",
    pg.ROOTS, pg.DEPTH, recursive=True))
def q_scan_tree_json(t: Tables):
    """Tree documents ``{"models": [...]}`` (one file per model row group) read back."""
    e = pg.edges(t)
    n = b.cat(t)
    d = g.bfs_depths(e, g.roots(n, e))
    names = n.select(F.col("id").alias("dst"), F.col("model_id").alias("child"))
    kids = e.join(names, "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("child")).alias("children"))
    rows = (d.join(n.select("id", "model_id"), "id").join(wide(kids), "id", "left")
            .select("model_id", F.col("depth").cast("int").alias("depth"),
                    F.coalesce("children", F.array().cast("array<string>")).alias("children"))
            .withColumn("children_count", F.size("children")))
    # a document holds about 500 models of a depth, however many there are
    sizes = rows.groupBy(F.col("depth").alias("_d")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n"))
    docs = rows.join(sizes, F.col("depth") == F.col("_d")).groupBy("depth", F.pmod(F.xxhash64("model_id"), F.col("_n")).alias("_g")).agg(
        F.collect_list(F.struct("model_id", "depth", "children", "children_count")).alias("models"))
    path = fs.scratch_path(t.spark, "trees-json")
    docs.select(F.to_json(F.struct("models")).alias("value")).write.mode("overwrite").text(path)
    return fs.scan_tree_json(t.spark, path, multi_line=False).select("model_id", "depth", "children_count")


@query("sink_columnar", sql=b.with_views("SELECT id, model_id, likes, downloads FROM cat", "cat"))
def q_sink_columnar(t: Tables):
    """Overwrite with the first half, append the second half, read the table back."""
    c = b.cat(t).select("id", "model_id", "likes", "downloads")
    path = fs.scratch_path(t.spark, "columnar")
    c.where(F.col("id") % 2 == 0).write.mode("overwrite").parquet(path)
    c.where(F.col("id") % 2 == 1).write.mode("append").parquet(path)
    c.write.mode("overwrite").option("header", True).csv(path + "-csv")
    return t.spark.read.parquet(path)


@query("sink_list_flattened", sql=b.with_views(
    "SELECT id, array_to_string(tags, ', ') AS tags FROM tags", "cat", "lin_rel",
    ctes=(TAGS_SQL,)))
def q_sink_list_flattened(t: Tables):
    return tags(t).select("id", F.array_join("tags", ", ").alias("tags"))


@query("sink_stats_json")
def q_sink_stats_json(t: Tables):
    """Nested statistics document (one row, JSON text) written and read back."""
    from kinframe.plans.stats import q_gap_share
    s = q_gap_share(t)
    doc = s.select(F.to_json(F.struct(F.struct("models_below_gap", "models_in_gap", "models_above_gap",
                                                "gap_percentage").alias("gap_analysis"))).alias("value"))
    path = fs.scratch_path(t.spark, "stats-json")
    doc.coalesce(1).write.mode("overwrite").text(path)  # a one-row document
    return t.spark.read.text(path)


@query("sink_markdown_rows", sql="""SELECT '| ' || lang || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS line FROM documents GROUP BY lang""")
def q_sink_markdown_rows(t: Tables):
    x = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    lines = x.select(F.format_string("| %s | %d |", "lang", "n").alias("line"))
    path = fs.scratch_path(t.spark, "markdown")
    lines.write.mode("overwrite").text(path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_graph_tables", sql=pg.gsql("SELECT src, dst, edge_type FROM edges"))
def q_sink_graph_tables(t: Tables):
    """Nodes and edges persisted as Parquet, edges partitioned by type; edges read back."""
    path = fs.scratch_path(t.spark, "graph")
    e = pg.edges(t).select("src", "dst", F.coalesce("edge_type", F.lit("generic")).alias("edge_part"), "edge_type")
    b.cat(t).write.mode("overwrite").parquet(path + "/nodes")
    e.write.mode("overwrite").partitionBy("edge_part").parquet(path + "/edges")
    return t.spark.read.parquet(path + "/edges").select("src", "dst", "edge_type")


@query("stream_new_ids", sql="SELECT DISTINCT event_id FROM events WHERE event_id IS NOT NULL")
def q_stream_new_ids(t: Tables):
    """Structured Streaming over the events folder: ids appended once each."""
    schema = t.events.schema
    out = fs.scratch_path(t.spark, "stream-ids")
    ids = ingest.stream_ids(t.spark, t.root, schema, "event_id", glob="events.parquet")
    ingest.run_available(ids, out, out + "-ckpt", "event_id")
    return ingest.stored_keys(t.spark, out, ids.schema)


NESTED_SQL = """WITH m AS (
  SELECT o_orderkey AS tree, 'order/' || o_orderkey AS id, NULL AS parent, 0 AS depth, CAST(floor(o_totalprice) AS BIGINT) AS downloads, CAST(0 AS BIGINT) AS likes FROM orders
  UNION ALL SELECT l_orderkey, 'line/' || l_orderkey || '-' || l_linenumber, 'order/' || l_orderkey, 1, CAST(floor(l_quantity) AS BIGINT), l_linenumber
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT l_orderkey, 'part/' || l_partkey, 'line/' || l_orderkey || '-' || l_linenumber, 2, CAST(floor(p_retailprice) AS BIGINT), p_size
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT 'node' AS kind, tree, CAST(NULL AS VARCHAR) AS src, id AS dst, max(downloads) AS downloads, max(likes) AS likes, max(depth) AS depth, min(depth) AS level FROM m GROUP BY tree, id
UNION ALL SELECT DISTINCT 'edge', tree, parent, id, NULL, NULL, NULL, NULL FROM m WHERE parent IS NOT NULL"""


def nested_documents(t: Tables):
    """``tree, text``: every order with its lines, and every line with its part, as one nested JSON document."""
    def model(kind: str, key, downloads, likes, depth: int, kids=None):
        fields = [F.concat(F.lit(f"https://hub.example/{kind}/"), key).alias("model_id"),
                  F.struct(F.floor(downloads).cast("long").alias("downloads"), likes.cast("long").alias("likes")).alias("metadata"),
                  F.lit(depth).alias("depth")]
        return F.struct(*fields, *([] if kids is None else [kids.alias("children")]))

    c = F.col
    part = model("part", c("l_partkey").cast("string"), c("p_retailprice"), c("p_size"), 2)
    lines = t.lineitem.join(t.part.select(c("p_partkey").alias("l_partkey"), "p_retailprice", "p_size"), "l_partkey", "left").select("l_orderkey", "l_linenumber", model(
        "line", F.concat(c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string")), c("l_quantity"), c("l_linenumber"), 1,
        F.filter(F.array(F.when(c("p_size").isNotNull(), part)), lambda p: p.isNotNull())).alias("m"))
    kids = lines.groupBy(c("l_orderkey").alias("o_orderkey")).agg(  # a handful of lines an order
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "m"))), lambda s: s["m"]).alias("kids"))
    tree = t.orders.join(kids, "o_orderkey", "left")
    return tree.select(c("o_orderkey").alias("tree"), F.to_json(model("order", c("o_orderkey").cast("string"), c("o_totalprice"), F.lit(0), 0, c("kids"))).alias("text"))


@query("flatten_nested_tree", sql=NESTED_SQL)
def q_flatten_nested_tree(t: Tables):
    """Stored nested documents (order, lines, parts) as node and edge rows."""
    path = fs.scratch_path(t.spark, "nested")
    docs = nested_documents(t)
    docs.write.parquet(path)
    nodes, edges = flatten_trees(t.spark.read.schema(docs.schema).parquet(path), "tree", "text")
    none = lambda kind: F.lit(None).cast(kind)
    return nodes.select(F.lit("node").alias("kind"), "tree", none("string").alias("src"), F.col("id").alias("dst"), "downloads", "likes", "depth", "level").unionByName(
        edges.select(F.lit("edge").alias("kind"), "tree", "src", "dst", none("long").alias("downloads"), none("long").alias("likes"),
                     none("int").alias("depth"), none("int").alias("level")))


@query("secret_split", sql=f"""SELECT doc_id, CASE WHEN coalesce(regexp_matches(text, {q('|'.join(f'(?:{p})' for p in SECRETS))}), false) THEN 'excluded' ELSE 'kept' END AS part FROM documents""")
def q_secret_split(t: Tables):
    """Cards streamed into the kept table and the exclusion log, and both read back."""
    out = fs.scratch_path(t.spark, "secret-split")
    schema = t.documents.schema
    ingest.secret_split_stream(t.spark, t.root, schema, "text", f"{out}/kept", f"{out}/excluded", f"{out}-ckpt", SECRETS, glob="documents.parquet")
    parts = [ingest.stored_keys(t.spark, f"{out}/{p}", schema).select("doc_id", F.lit(p).alias("part")) for p in ("kept", "excluded")]
    return parts[0].unionByName(parts[1])


def indexed(df, order_col):
    """Dense 0-based position in ``order_col`` order (running count, no global window)."""
    return running_sum(df.withColumn("_one", F.lit(1)), [], [order_col], "_one", "_pos", inclusive=False).drop("_one")


@query("assign_chunks", sql="""SELECT id, 'chunk_' || CAST(c * 500 AS VARCHAR) || '_' || CAST(least(c * 500 + 499, n - 1) AS VARCHAR) AS chunk FROM (
  SELECT doc_id AS id, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS c, count(*) OVER () AS n FROM documents) x""")
def q_assign_chunks(t: Tables):
    d = indexed(t.documents.select(F.col("doc_id").alias("id")), "id")
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    c = F.floor(F.col("_pos") / CHUNK)
    return d.crossJoin(n).select("id", F.concat(F.lit("chunk_"), (c * CHUNK).cast("string"), F.lit("_"),
                                                F.least(c * CHUNK + CHUNK - 1, F.col("n") - 1).cast("string")).alias("chunk"))


@query("chunk_coverage", sql=f"""SELECT c AS chunk_no, count(*) AS rows_in, count(*) FILTER (WHERE NOT s) AS rows_kept, count(*) FILTER (WHERE NOT s) = 0 AS empty_chunk FROM (
  SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS c, coalesce(regexp_matches(text, {q('|'.join(f'(?:{p})' for p in SECRETS))}), false) AS s FROM documents) x GROUP BY c""")
def q_chunk_coverage(t: Tables):
    d = indexed(t.documents.select(F.col("doc_id").alias("id"), secret_flag("text", SECRETS).alias("s")), "id")
    return d.groupBy(F.floor(F.col("_pos") / CHUNK).alias("chunk_no")).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(~F.col("s")).alias("rows_kept"),
        (F.count_if(~F.col("s")) == 0).alias("empty_chunk"))
