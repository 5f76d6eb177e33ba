"""Driver tables → the shapes the analyses work on (catalog, lineage, ...).

Each binding exists twice: as a DataFrame builder (what the Spark jobs use)
and as a SQL common-table expression (what the independent DuckDB oracle
uses). The SQL texts are the binding definitions; the DataFrame builders are
written independently against the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.functions.common import wide
from kinframe.operators.sequence import previous_in_group
from kinframe.sources.tables import Tables

# ---------------------------------------------------------------- DataFrames

def cat(t: Tables) -> DataFrame:
    """Catalog nodes: one row per part (model)."""
    first_ship = (t.lineitem.groupBy("l_partkey")
                  .agg(F.min("l_shipdate").alias("created_at")))
    p = t.part
    return wide(p.join(wide(first_ship), p.p_partkey == first_ship.l_partkey, "left")
            .select(F.col("p_partkey").alias("id"),
                    F.concat(F.col("p_brand"), F.lit("/"), F.regexp_replace("p_name", " ", "-"),
                             F.lit("-"), F.col("p_partkey").cast("string")).alias("model_id"),
                    F.col("p_size").alias("likes"),
                    F.floor("p_retailprice").cast("bigint").alias("downloads"),
                    F.col("p_type").alias("pipeline_tag"),
                    F.col("p_brand").alias("library_name"),
                    F.when(F.col("p_partkey") % 11 == 0, "auto")
                     .when(F.col("p_partkey") % 11 == 1, "manual").otherwise("False").alias("gated"),
                    F.coalesce(F.col("created_at"),
                               F.lit("1992-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at")))


def cat_trait(t: Tables) -> DataFrame:
    """Multi-valued trait in long form: (id, pos, trait)."""
    p = t.part.select("p_partkey", "p_name")
    w1 = p.select(F.col("p_partkey").alias("id"), F.lit(1).alias("pos"),
                  F.split_part("p_name", F.lit(" "), F.lit(1)).alias("trait"))
    w2 = (p.select(F.col("p_partkey").alias("id"), F.lit(2).alias("pos"),
                   F.split_part("p_name", F.lit(" "), F.lit(2)).alias("trait"))
          .where(F.col("trait") != ""))
    return w1.unionByName(w2)


def cat_traits_array(t: Tables) -> DataFrame:
    """(id, traits array<string>) in position order — array form of cat_trait."""
    p = t.part.select("p_partkey", "p_name")
    parts = F.split(F.col("p_name"), " ")
    return p.select(F.col("p_partkey").alias("id"),
                    F.filter(F.slice(parts, 1, 2), lambda x: x != "").alias("traits"))


def lin_rel(t: Tables) -> DataFrame:
    """Raw typed parent relations (dst, src, rel), including unknown parents."""
    return lin_rel_listed(t).drop("pos")


def lin_rel_listed(t: Tables) -> DataFrame:
    """The relations with their position in the part's list of parents."""
    k = F.col("p_partkey")
    parent8 = F.floor(k / 8).cast("bigint")

    def row(when, src, rel):
        return F.when(when, F.struct(src.cast("bigint").alias("src"), rel.alias("rel")))

    kind = F.when(k % 4 == 0, "quantized").when(k % 4 == 1, "adapter").otherwise("finetune")
    # one scan: every part lists its relations
    rels = F.array(
        row(k >= 8, parent8, kind),
        row((k >= 16) & (k % 10 == 3), F.floor(k / 16), F.lit("merge")),
        row((k >= 8) & (k % 9 == 0), parent8, F.lit("generic")),
        row((k >= 8) & (k % 25 == 2), parent8, F.lit("merge")),
        row(k % 50 == 7, F.lit(1000000) + k, F.lit("finetune")),
        row((k >= 8) & (k % 40 == 6), k - 5, F.lit("generic")))
    listed = t.part.select(k.alias("dst"), F.posexplode(rels).alias("pos", "r"))
    return listed.where("r IS NOT NULL").select("dst", "r.src", "r.rel", "pos")


def evt_edge(t: Tables) -> DataFrame:
    """Consecutive events of a user as parent→child edges with traits/values."""
    e = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    lagged = previous_in_group(e, "user_id", ["ts", "event_id"],
                               ["event_id", "event_type", "value"], prefix="p_")
    return (lagged.where(F.col("p_event_id").isNotNull())
            .select(F.col("p_event_id").alias("src"), F.col("event_id").alias("dst"),
                    F.col("p_event_type").alias("src_trait"), F.col("event_type").alias("dst_trait"),
                    F.col("p_value").alias("src_value"), F.col("value").alias("dst_value")))


def doc_edge(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id")
    return d.where(F.col("doc_id") >= 4).select(
        F.floor(F.col("doc_id") / 4).cast("bigint").alias("src"), F.col("doc_id").alias("dst"))


def emb_edge(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id")
    return v.where(F.col("vec_id") >= 4).select(
        F.floor(F.col("vec_id") / 4).cast("bigint").alias("src"), F.col("vec_id").alias("dst"))


def par(t: Tables) -> DataFrame:
    """Parameter texts with mixed sources (id, model_id, card, metadata)."""
    k = F.col("p_partkey")
    size = F.col("p_size")
    return t.part.select(
        k.alias("id"),
        F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), size.cast("string"),
                 F.when(k % 3 == 0, "b").when(k % 3 == 1, "m").otherwise("")).alias("model_id"),
        F.when(k % 5 == 0, F.concat(F.lit("Params: "), size.cast("string"), F.lit("K")))
         .when(k % 5 == 1, F.lit("N/A")).alias("card"),
        F.when(k % 7 == 0, F.concat(F.lit('{"safetensors": {"parameters": {"F32": '),
                                    (size * 1000).cast("string"), F.lit(', "BF16": '),
                                    (size * 500).cast("string"), F.lit("}}}")))
         .when(k % 7 == 1, F.concat(F.lit('{"num_parameters": "'), size.cast("string"), F.lit('M"}')))
         .when(k % 7 == 2, F.lit("not json"))
         .when(k % 7 == 3, F.concat(F.lit('{"id": {"rev": "a1"}, "config": {"num_parameters": "'), size.cast("string"), F.lit('M"}}')))
         .when(k % 7 == 4, F.concat(F.lit('{"size": "n/a", "card": {"data": {"note": "x", "model_size": "'), size.cast("string"),
                                    F.lit('K"}}}'))).alias("metadata"))


# ----------------------------------------------------------------- SQL CTEs

SQL = {
    "cat": """SELECT p.p_partkey AS id, p.p_brand || '/' || replace(p.p_name, ' ', '-') || '-' || CAST(p.p_partkey AS STRING) AS model_id, p.p_size AS likes, CAST(floor(p.p_retailprice) AS BIGINT) AS downloads, p.p_type AS pipeline_tag, p.p_brand AS library_name, CASE p.p_partkey % 11 WHEN 0 THEN 'auto' WHEN 1 THEN 'manual' ELSE 'False' END AS gated, coalesce(l.created_at, TIMESTAMP '1992-01-01 00:00:00') AS created_at FROM part p
LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey""",
    "cat_trait": """SELECT p_partkey AS id, 1 AS pos, split_part(p_name, ' ', 1) AS trait FROM part
UNION ALL SELECT p_partkey, 2, split_part(p_name, ' ', 2) FROM part WHERE split_part(p_name, ' ', 2) <> ''""",
    "lin_rel": """SELECT p_partkey AS dst, CAST(floor(p_partkey / 8) AS BIGINT) AS src, CASE p_partkey % 4 WHEN 0 THEN 'quantized' WHEN 1 THEN 'adapter' ELSE 'finetune' END AS rel FROM part WHERE p_partkey >= 8
UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 16) AS BIGINT), 'merge' FROM part WHERE p_partkey >= 16 AND p_partkey % 10 = 3
UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 8) AS BIGINT), 'generic' FROM part WHERE p_partkey >= 8 AND p_partkey % 9 = 0
UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 8) AS BIGINT), 'merge' FROM part WHERE p_partkey >= 8 AND p_partkey % 25 = 2
UNION ALL SELECT p_partkey, 1000000 + p_partkey, 'finetune' FROM part WHERE p_partkey % 50 = 7
UNION ALL SELECT p_partkey, p_partkey - 5, 'generic' FROM part WHERE p_partkey >= 8 AND p_partkey % 40 = 6""",
    "evt_edge": """SELECT *
FROM (SELECT lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_id AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src_trait, event_type AS dst_trait, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src_value, value AS dst_value FROM events) t
WHERE src IS NOT NULL""",
    "doc_edge": "SELECT CAST(floor(doc_id / 4) AS BIGINT) AS src, doc_id AS dst FROM documents WHERE doc_id >= 4",
    "emb_edge": "SELECT CAST(floor(vec_id / 4) AS BIGINT) AS src, vec_id AS dst FROM embeddings WHERE vec_id >= 4",
    "par": """SELECT p_partkey AS id, replace(p_name, ' ', '-') || '-' || CAST(p_size AS STRING) || CASE p_partkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'm' ELSE '' END AS model_id, CASE WHEN p_partkey % 5 = 0 THEN 'Params: ' || CAST(p_size AS STRING) || 'K' WHEN p_partkey % 5 = 1 THEN 'N/A' END AS card, CASE WHEN p_partkey % 7 = 0 THEN '{"safetensors": {"parameters": {"F32": ' || CAST(p_size * 1000 AS STRING) || ', "BF16": ' || CAST(p_size * 500 AS STRING) || '}}}' WHEN p_partkey % 7 = 1 THEN '{"num_parameters": "' || CAST(p_size AS STRING) || 'M"}' WHEN p_partkey % 7 = 2 THEN 'not json'
  WHEN p_partkey % 7 = 3 THEN '{"id": {"rev": "a1"}, "config": {"num_parameters": "' || CAST(p_size AS STRING) || 'M"}}'
  WHEN p_partkey % 7 = 4 THEN '{"size": "n/a", "card": {"data": {"note": "x", "model_size": "' || CAST(p_size AS STRING) || 'K"}}}' END AS metadata FROM part""",
}


def with_views(body: str, *names: str, ctes: tuple[str, ...] | list[str] = (),
               recursive: bool = False) -> str:
    """``WITH name AS (...), ..., <ctes> body`` for the named binding views
    followed by extra ``name AS (...)`` texts."""
    parts = [f"{n} AS (\n{SQL[n]}\n)" for n in names] + list(ctes)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body
