"""Catalog keys: tags, parents, ids, projections, buckets (§2.2, §2.6 parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions import ids as I
from kinframe.functions.common import r6
from kinframe.functions.dictionaries import LANGUAGES
from kinframe.operators import graph as g
from kinframe.plans.graph import EDGES
from kinframe.plans.registry import query
from kinframe.plans.sqlfn import q
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables

LANG_SQL = "dim_language(code, name) AS (VALUES " + ", ".join(f"({q(c)}, {q(n)})" for c, n in LANGUAGES.items()) + ")"


def tags(t: Tables):
    """(id, tags array<string>) — relation tags, license/region tags, language codes; sorted."""
    r = b.lin_rel(t)
    rel_tags = r.select(F.col("dst").alias("id"),
                        F.when(F.col("rel") == "generic", F.concat(F.lit("base_model:"), F.col("src").cast("string")))
                        .otherwise(F.concat(F.lit("base_model:"), F.col("rel"), F.lit(":"), F.col("src").cast("string")))
                        .alias("tag"))
    c = b.cat(t)
    lic = c.select("id", F.concat(F.lit("license:"), F.col("pipeline_tag")).alias("tag"))
    reg = c.select("id", F.concat(F.lit("region:"), F.col("library_name")).alias("tag"))
    lang = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("tag"))
    allt = rel_tags.unionByName(lic).unionByName(reg).unionByName(lang)
    per = allt.groupBy("id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return c.select("id", "model_id").join(per, "id", "left").select(
        "id", "model_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


TAGS_SQL = """tg AS (
  SELECT dst AS id, CASE WHEN rel = 'generic' THEN 'base_model:' || CAST(src AS VARCHAR) ELSE 'base_model:' || rel || ':' || CAST(src AS VARCHAR) END AS tag FROM lin_rel
  UNION ALL SELECT id, 'license:' || pipeline_tag FROM cat
  UNION ALL SELECT id, 'region:' || library_name FROM cat
  UNION ALL SELECT doc_id, lang FROM documents),
tags AS (SELECT c.id, c.model_id, coalesce(x.tags, []) AS tags FROM cat c LEFT JOIN (SELECT id, list_sort(list(tag)) AS tags FROM tg GROUP BY id) x ON x.id = c.id)"""


def csql(body, *ctes):
    return b.with_views(body, "cat", "lin_rel", ctes=(TAGS_SQL,) + ctes)


def j(c):
    return F.array_join(c, ",")


def pref_sql(p):
    return f"array_to_string(list_transform(list_filter(tags, lambda x: starts_with(x, '{p}')), lambda x: replace(x, '{p}', '')), ',')"


@query("tags_by_prefix", sql=csql(
    "SELECT id, " + ", ".join(f"{pref_sql(p)} AS {n}" for n, p in I.TAG_PREFIXES.items()) + " FROM tags"))
def q_tags_by_prefix(t: Tables):
    x = tags(t)
    return x.select("id", *[j(I.with_prefix("tags", p)).alias(n) for n, p in I.TAG_PREFIXES.items()])


def _typed_sql(p):
    return f"array_to_string(list_transform(list_filter(tags, lambda x: starts_with(x, '{p}')), lambda x: substr(x, {len(p) + 1})), ',')"


@query("parents_by_relation", sql=csql(
    "SELECT id, array_to_string(list_transform(list_filter(tags, lambda x: starts_with(x, 'base_model:') AND length(x) - length(replace(x, ':', '')) = 1), lambda x: substr(x, 12)), ',') AS parent_model, "
    + ", ".join(f"{_typed_sql(p)} AS {n}" for n, p in I.PARENT_PREFIXES.items()) + " FROM tags"))
def q_parents_by_relation(t: Tables):
    x = tags(t)
    return x.select("id", j(I.generic_parents("tags")).alias("parent_model"),
                    *[j(I.typed_parents("tags", p)).alias(n) for n, p in I.PARENT_PREFIXES.items()])


@query("languages_from_tags", sql=csql(
    f"""SELECT id, array_to_string(list_transform(list_filter(tags, lambda x: length(x) = 2 AND x IN ({', '.join(q(c) for c in LANGUAGES)})),
  lambda x: CASE x {' '.join(f'WHEN {q(c)} THEN {q(n)}' for c, n in LANGUAGES.items())} END), ',') AS languages FROM tags"""))
def q_languages_from_tags(t: Tables):
    x = tags(t)
    two = F.filter("tags", lambda s: F.length(s) == 2)
    return x.select("id", j(I.lookup_list(two, LANGUAGES)).alias("languages"))


@query("api_projection", sql=csql(
    """SELECT c.model_id, split_part(c.model_id, '/', 1) AS author, coalesce(c.downloads, 0) AS downloads, coalesce(c.likes, 0) AS likes,
  coalesce(c.library_name, '') AS library_name, coalesce(c.pipeline_tag, '') AS pipeline_tag, array_to_string(t.tags, ', ') AS tags,
  strftime(c.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, false AS private, CAST(len(t.tags) AS INTEGER) AS siblings
FROM cat c JOIN tags t ON t.id = c.id"""))
def q_api_projection(t: Tables):
    c = b.cat(t)
    x = tags(t).select("id", "tags")
    return c.join(x, "id").select(
        "model_id", F.split_part("model_id", F.lit("/"), F.lit(1)).alias("author"),
        F.coalesce("downloads", F.lit(0)).alias("downloads"), F.coalesce("likes", F.lit(0)).alias("likes"),
        F.coalesce("library_name", F.lit("")).alias("library_name"),
        F.coalesce("pipeline_tag", F.lit("")).alias("pipeline_tag"),
        F.array_join("tags", ", ").alias("tags"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.lit(False).alias("private"), F.size("tags").alias("siblings"))


@query("resolve_parents", sql=csql(
    """SELECT id, array_to_string(CASE WHEN len(bm) > 0 THEN bm ELSE ty END, ',') AS parents FROM (
  SELECT t.id,
    list_filter(coalesce((SELECT list(p.model_id ORDER BY p.model_id) FROM lin_rel r JOIN cat p ON p.id = r.src WHERE r.dst = t.id AND r.rel = 'generic'), []), lambda x: x <> '') AS bm,
    list_filter(coalesce((SELECT list(p.model_id ORDER BY p.model_id) FROM lin_rel r JOIN cat p ON p.id = r.src WHERE r.dst = t.id AND r.rel <> 'generic'), []), lambda x: x <> '' AND contains(x, '/')) AS ty
  FROM tags t) x"""))
def q_resolve_parents(t: Tables):
    """Parent list by precedence: declared base models, else parent-like tags
    (those containing '/'); empties removed."""
    r = b.lin_rel(t)
    names = b.cat(t).select(F.col("id").alias("src"), F.col("model_id").alias("pname"))
    rp = r.join(names, "src")
    per = rp.groupBy(F.col("dst").alias("id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("rel") == "generic", F.col("pname")))).alias("bm"),
        F.array_sort(F.collect_list(F.when(F.col("rel") != "generic", F.col("pname")))).alias("ty"))
    x = b.cat(t).select("id").join(per, "id", "left")
    bm = F.filter(F.coalesce("bm", F.array().cast("array<string>")), lambda s: s != "")
    ty = F.filter(F.coalesce("ty", F.array().cast("array<string>")), lambda s: (s != "") & s.contains("/"))
    return x.select("id", j(F.when(F.size(bm) > 0, bm).otherwise(ty)).alias("parents"))


@query("normalize_names", sql=b.with_views(
    """SELECT id, translate(lower(trim(model_id)), '-/_', '') AS normalized, split_part(model_id, '/', 1) AS org,
  split_part(model_id, '/', 2) AS model FROM cat""", "cat"))
def q_normalize_names(t: Tables):
    c = b.cat(t)
    return c.select("id", I.normalize_name("model_id").alias("normalized"),
                    F.split_part("model_id", F.lit("/"), F.lit(1)).alias("org"),
                    F.split_part("model_id", F.lit("/"), F.lit(2)).alias("model"))


@query("model_type_token", sql=b.with_views(
    "SELECT id, string_split(string_split(model_id, '/')[-1], '-')[1] AS model_type FROM cat", "cat"))
def q_model_type_token(t: Tables):
    return b.cat(t).select("id", I.model_type_token("model_id").alias("model_type"))


LISTTXT_SQL = """lt AS (SELECT p_partkey AS id, CASE p_partkey % 5
  WHEN 0 THEN '["' || split_part(p_name, ' ', 1) || '", "' || split_part(p_name, ' ', 2) || '"]'
  WHEN 1 THEN '[''' || split_part(p_name, ' ', 1) || ''', ''' || split_part(p_name, ' ', 2) || ''']'
  WHEN 2 THEN split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2)
  WHEN 3 THEN split_part(p_name, ' ', 1)
  ELSE CASE WHEN p_partkey % 2 = 0 THEN '[]' END END AS txt FROM part)"""


def list_text(t: Tables):
    p = t.part.select("p_partkey", "p_name")
    a = F.split_part("p_name", F.lit(" "), F.lit(1))
    c2 = F.split_part("p_name", F.lit(" "), F.lit(2))
    k = F.col("p_partkey") % 5
    txt = (F.when(k == 0, F.concat(F.lit('["'), a, F.lit('", "'), c2, F.lit('"]')))
           .when(k == 1, F.concat(F.lit("['"), a, F.lit("', '"), c2, F.lit("']")))
           .when(k == 2, F.concat(a, F.lit(", "), c2))
           .when(k == 3, a)
           .otherwise(F.when(F.col("p_partkey") % 2 == 0, F.lit("[]"))))
    return p.select(F.col("p_partkey").alias("id"), txt.alias("txt"))


@query("parse_list_column", sql=b.with_views(
    r"""SELECT id, txt, array_to_string(CASE WHEN txt IS NULL OR trim(txt) = '' OR trim(txt) = '[]' THEN [] ELSE list_filter(
  CASE WHEN starts_with(trim(txt), '[') AND ends_with(trim(txt), ']')
       THEN list_transform(string_split(regexp_replace(trim(txt), '^\[|\]$', '', 'g'), ','), lambda x: regexp_replace(trim(x), '^[''"]|[''"]$', '', 'g'))
       ELSE list_transform(string_split(trim(txt), ','), lambda x: trim(x)) END, lambda x: x <> '') END, '|') AS items FROM lt""",
    ctes=(LISTTXT_SQL,)))
def q_parse_list_column(t: Tables):
    x = list_text(t)
    return x.select("id", "txt", F.array_join(I.parse_list_text("txt"), "|").alias("items"))


@query("coerce_numeric_columns", sql=b.with_views(
    """SELECT id, coalesce(CAST(trunc(TRY_CAST(likes_txt AS DOUBLE)) AS INTEGER), 0) AS likes,
  coalesce(CAST(trunc(TRY_CAST(depth_txt AS DOUBLE)) AS INTEGER), 0) AS depth, 0 AS spaces_count FROM (
  SELECT id, CASE WHEN id % 13 = 0 THEN 'n/a' WHEN id % 13 = 1 THEN NULL ELSE CAST(likes AS VARCHAR) END AS likes_txt,
         CASE WHEN id % 7 = 0 THEN CAST(id % 4 AS VARCHAR) || '.5' ELSE CAST(id % 4 AS VARCHAR) END AS depth_txt FROM cat) x""", "cat"))
def q_coerce_numeric_columns(t: Tables):
    """Count/depth text columns → int, bad or missing → 0; a missing column is created as 0."""
    c = b.cat(t).select("id", F.when(F.col("id") % 13 == 0, F.lit("n/a"))
                        .when(F.col("id") % 13 == 1, F.lit(None)).otherwise(F.col("likes").cast("string")).alias("likes_txt"),
                        F.when(F.col("id") % 7 == 0, F.concat((F.col("id") % 4).cast("string"), F.lit(".5")))
                        .otherwise((F.col("id") % 4).cast("string")).alias("depth_txt"))

    def to_int(x):
        return F.coalesce(x.try_cast("double").cast("int"), F.lit(0))
    out = c.select("id", to_int(F.col("likes_txt")).alias("likes"), to_int(F.col("depth_txt")).alias("depth"))
    if "spaces_count" not in out.columns:
        out = out.withColumn("spaces_count", F.lit(0))
    return out


FAMILY = [("ring", "Ring", "high"), ("widget", "Widget", "high"), ("bolt", "Bolt", "medium"),
          ("gear", "Gear", "medium"), ("valve", "Valve", "medium")]


@query("family_from_id", sql=b.with_views(
    """SELECT c.id, coalesce(m.family, CASE WHEN contains(c.model_id, '/') THEN upper(substr(split_part(c.model_id, '/', 1), 1, 1)) || lower(substr(split_part(c.model_id, '/', 1), 2)) ELSE 'Other' END) AS family,
  coalesce(m.confidence, CASE WHEN contains(c.model_id, '/') THEN 'low' ELSE 'none' END) AS confidence
FROM cat c LEFT JOIN (SELECT c.id, arg_min(f.family, f.ord) AS family, arg_min(f.confidence, f.ord) AS confidence
  FROM cat c JOIN dim_family f ON contains(lower(c.model_id), f.pattern) GROUP BY c.id) m ON m.id = c.id""", "cat",
    ctes=("dim_family(pattern, family, confidence, ord) AS (VALUES " + ", ".join(
        f"('{p}', '{f}', '{cf}', {i})" for i, (p, f, cf) in enumerate(FAMILY)) + ")",)))
def q_family_from_id(t: Tables):
    """Family by the first matching pattern of a small fixed dimension (kept as
    a literal array: a per-row scan, no join); else the organisation name
    title-cased with low confidence; else 'Other'."""
    c = b.cat(t)
    dim = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(f).alias("family"), F.lit(cf).alias("confidence"))
                    for p, f, cf in FAMILY])
    hit = F.try_element_at(F.filter(dim, lambda d: F.lower(F.col("model_id")).contains(d["pattern"])), F.lit(1))
    org = F.split_part("model_id", F.lit("/"), F.lit(1))
    has_org = F.col("model_id").contains("/")
    title = F.concat(F.upper(F.substring(org, 1, 1)), F.lower(F.substring(org, 2, 1 << 30)))
    return c.select("id", F.coalesce(hit["family"], F.when(has_org, title).otherwise(F.lit("Other"))).alias("family"),
                    F.coalesce(hit["confidence"], F.when(has_org, F.lit("low")).otherwise(F.lit("none"))).alias("confidence"))


@query("derivative_metrics", sql=b.with_views(
    """SELECT n.id, coalesce(children_count, 0) AS children_count, coalesce(adapters_count, 0) AS adapters_count,
  coalesce(quantized_count, 0) AS quantized_count, coalesce(merges_count, 0) AS merges_count,
  coalesce(children_count, 0) + coalesce(adapters_count, 0) + coalesce(quantized_count, 0) + coalesce(merges_count, 0) AS total_derivatives,
  coalesce(children_count, 0) + coalesce(adapters_count, 0) + coalesce(quantized_count, 0) + coalesce(merges_count, 0) > 0 AS has_derivatives,
  CAST((coalesce(children_count, 0) > 0)::INT + (coalesce(adapters_count, 0) > 0)::INT + (coalesce(quantized_count, 0) > 0)::INT + (coalesce(merges_count, 0) > 0)::INT AS INTEGER) AS derivative_diversity
FROM cat n LEFT JOIN (SELECT src,
  count(*) FILTER (WHERE edge_type = 'finetune') AS children_count, count(*) FILTER (WHERE edge_type = 'adapter') AS adapters_count,
  count(*) FILTER (WHERE edge_type = 'quantized') AS quantized_count, count(*) FILTER (WHERE edge_type = 'merge') AS merges_count
  FROM edges GROUP BY src) d ON d.src = n.id""", "cat", "lin_rel", ctes=(EDGES,)))
def q_derivative_metrics(t: Tables):
    return crawl(t).select("id", "children_count", "adapters_count", "quantized_count", "merges_count",
                           "total_derivatives", "has_derivatives", "derivative_diversity")


def crawl(t: Tables):
    """Crawl-catalog view of the lineage: derivative counts by kind and their summaries."""
    from kinframe.plans.graph import edges
    e = edges(t)
    cnt = e.groupBy(F.col("src").alias("id")).agg(
        *[F.count(F.when(F.col("edge_type") == k, 1)).alias(n)
          for k, n in [("finetune", "children_count"), ("adapter", "adapters_count"),
                       ("quantized", "quantized_count"), ("merge", "merges_count")]])
    kinds = ["children_count", "adapters_count", "quantized_count", "merges_count"]
    x = b.cat(t).select("id").join(cnt, "id", "left").select(
        "id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    div = sum(((F.col(k) > 0).cast("int") for k in kinds[1:]), (F.col(kinds[0]) > 0).cast("int"))
    return x.select("*", total.alias("total_derivatives"), (total > 0).alias("has_derivatives"),
                    div.alias("derivative_diversity"))
