"""Bucketing, scaling, top-N and catalog set operations (§2.2, §2.4, §2.6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions.common import r6, wide
from kinframe.operators.names import contained_names
from kinframe.operators.topk import top_k
from kinframe.plans.bins import (CATEGORY_BINS, CATEGORY_LABELS, HALF_OPEN, PARAM_BINS, PARAM_LABELS, POPULARITY, RANGE_BINS,
                                 RANGE_LABELS, right_closed, right_closed_sql)
from kinframe.plans.params import PARAMS_SQL, params_table
from kinframe.plans.registry import query
from kinframe.sources import bindings as b
from kinframe.sources.files import scratch_path
from kinframe.sources.tables import Tables

#: Name, edges, labels and whether 0 belongs to the first bin.
BIN_SETS = [("bins", PARAM_BINS, PARAM_LABELS, False), ("categories", CATEGORY_BINS, CATEGORY_LABELS, True), ("ranges", RANGE_BINS, RANGE_LABELS, False)]


@query("bucket_parameters", sql=b.with_views(
    " UNION ALL ".join(
        f"SELECT '{name}' AS bin_set, bin, count(*) AS n FROM (SELECT CASE WHEN {str(low).lower()} AND parameters = 0 THEN '{labels[0]}' ELSE {right_closed_sql('parameters', edges, labels)} END AS bin FROM pc WHERE parameters IS NOT NULL) x GROUP BY bin"
        for name, edges, labels, low in BIN_SETS), "par", ctes=(PARAMS_SQL,)))
def q_bucket_parameters(t: Tables):
    """Parameter counts in the three sets of bins, from one pass."""
    x = F.col("parameters")
    sets = F.array(*[F.struct(F.lit(name).alias("bin_set"), F.when(F.lit(low) & (x == 0), labels[0]).otherwise(right_closed(x, edges, labels)).alias("bin"))
                     for name, edges, labels, low in BIN_SETS])
    p = params_table(t).where(x.isNotNull()).select(F.explode(sets).alias("s"))
    return p.groupBy("s.bin_set", "s.bin").agg(F.count(F.lit(1)).alias("n"))


def half_open(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for lab, lo, hi in reversed(HALF_OPEN):
        out = F.when((x >= lo) & (x < hi), F.lit(lab)).otherwise(out)
    return out


HALF_SQL = "CASE " + " ".join(
    f"WHEN parameters >= {lo!r} AND {'parameters < ' + repr(hi) if hi != float('inf') else 'true'} THEN '{lab}'"
    for lab, lo, hi in HALF_OPEN) + " END"


@query("bucket_half_open", sql=b.with_views(
    f"SELECT bin, count(*) AS n FROM (SELECT {HALF_SQL} AS bin FROM pc WHERE parameters IS NOT NULL AND parameters > 0) x GROUP BY bin",
    "par", ctes=(PARAMS_SQL,)))
def q_bucket_half_open(t: Tables):
    p = params_table(t).where(F.col("parameters").isNotNull() & (F.col("parameters") > 0))
    return p.select(half_open(F.col("parameters")).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def popularity(x: Column) -> Column:
    out = F.lit("Niche (<10)")
    for th, lab in reversed(POPULARITY):
        out = F.when(x >= th, F.lit(lab)).otherwise(out)
    return out


@query("bucket_popularity", sql=b.with_views(
    "SELECT library_name, n, CASE " + " ".join(f"WHEN n >= {th} THEN '{lab}'" for th, lab in POPULARITY)
    + " ELSE 'Niche (<10)' END AS popularity FROM (SELECT library_name, count(*) AS n FROM cat GROUP BY 1) x", "cat"))
def q_bucket_popularity(t: Tables):
    c = b.cat(t).groupBy("library_name").agg(F.count(F.lit(1)).alias("n"))
    return c.select("library_name", "n", popularity(F.col("n")).alias("popularity"))


@query("log_minmax_scale", sql=b.with_views(
    """SELECT library_name, n, round(ln(1 + n), 6) AS log_count,
  round((10 + (ln(1 + n) - min(ln(1 + n)) OVER ()) / nullif(max(ln(1 + n)) OVER () - min(ln(1 + n)) OVER (), 0) * 90) * 5, 6) AS point_size
FROM (SELECT library_name, count(*) AS n FROM cat GROUP BY 1) x""", "cat"))
def q_log_minmax_scale(t: Tables):
    """log1p(count) min-max scaled to [10, 100], times 5 (global min/max as a
    one-row aggregate crossed in)."""
    c = b.cat(t).groupBy("library_name").agg(F.count(F.lit(1)).alias("n")).withColumn("lc", F.log1p("n"))
    mm = c.agg(F.min("lc").alias("lo"), F.max("lc").alias("hi"))
    j = c.crossJoin(mm)
    scaled = (10 + F.try_divide(F.col("lc") - F.col("lo"), F.col("hi") - F.col("lo")) * 90) * 5
    return j.select("library_name", "n", r6("lc").alias("log_count"), r6(scaled).alias("point_size"))


@query("size_by_share_of_max", sql=b.with_views(
    """SELECT id, downloads, round(greatest(1000, downloads / max(downloads) OVER () * 5000), 6) AS node_size,
  CASE WHEN downloads >= 1000000 THEN printf('%.1fM', downloads / 1000000) WHEN downloads >= 1000 THEN printf('%.1fK', downloads / 1000)
  ELSE CAST(downloads AS VARCHAR) END AS downloads_label FROM cat""", "cat"))
def q_size_by_share_of_max(t: Tables):
    c = b.cat(t).select("id", "downloads")
    mx = c.agg(F.max("downloads").alias("mx"))
    j = c.crossJoin(mx)  # one-row aggregate
    size = F.greatest(F.lit(1000.0), F.col("downloads") / F.col("mx") * 5000)
    lab = (F.when(F.col("downloads") >= 1000000, F.concat(F.format_string("%.1f", F.col("downloads") / 1e6), F.lit("M")))
           .when(F.col("downloads") >= 1000, F.concat(F.format_string("%.1f", F.col("downloads") / 1e3), F.lit("K")))
           .otherwise(F.col("downloads").cast("string")))
    return j.select("id", "downloads", r6(size).alias("node_size"), lab.alias("downloads_label"))


@query("top_n_else_other", sql=b.with_views(
    """SELECT c.id, coalesce(t.pipeline_tag, 'Other') AS category FROM cat c LEFT JOIN (
  SELECT pipeline_tag FROM cat GROUP BY 1 ORDER BY count(*) DESC, pipeline_tag LIMIT 10) t ON t.pipeline_tag = c.pipeline_tag""", "cat"))
def q_top_n_else_other(t: Tables):
    c = b.cat(t).select("id", "pipeline_tag")
    top = top_k(c.groupBy("pipeline_tag").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("pipeline_tag")], 10)
    # at most N rows: a bounded broadcast
    j = c.join(F.broadcast(top.select(F.col("pipeline_tag").alias("keep"))), F.col("pipeline_tag") == F.col("keep"), "left")
    return j.select("id", F.coalesce("keep", F.lit("Other")).alias("category"))


@query("top_by_downloads", sql=b.with_views(
    "SELECT model_id, downloads, likes FROM cat ORDER BY downloads DESC, model_id LIMIT 50", "cat"))
def q_top_by_downloads(t: Tables):
    return top_k(b.cat(t).select("model_id", "downloads", "likes"), [F.desc("downloads"), F.asc("model_id")], 50)


@query("top_libraries", sql=b.with_views(
    "SELECT library_name, n FROM (SELECT library_name, count(*) AS n FROM cat GROUP BY 1) x ORDER BY n DESC, library_name LIMIT 20", "cat"))
def q_top_libraries(t: Tables):
    c = b.cat(t).groupBy("library_name").agg(F.count(F.lit(1)).alias("n"))
    return top_k(c, [F.desc("n"), F.asc("library_name")], 20)


@query("compare_catalogs", sql="""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), c AS (SELECT DISTINCT c_custkey AS id FROM customer)
SELECT 'common' AS part, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM c) x
UNION ALL SELECT 'only_left', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM c) y
UNION ALL SELECT 'only_right', count(*) FROM (SELECT id FROM c EXCEPT SELECT id FROM a) z""")
def q_compare_catalogs(t: Tables):
    a = t.orders.select(F.col("o_custkey").alias("id")).distinct()
    c = t.customer.select(F.col("c_custkey").alias("id")).distinct()
    parts = [("common", a.intersect(c)), ("only_left", a.subtract(c)), ("only_right", c.subtract(a))]
    out = None
    for name, df in parts:
        x = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@query("incremental_remaining", sql=b.with_views(
    "SELECT id, model_id FROM cat WHERE id NOT IN (SELECT doc_id FROM documents)", "cat"))
def q_incremental_remaining(t: Tables):
    """Catalog ids not yet present in the output set (documents = already processed)."""
    done = t.documents.select(F.col("doc_id").alias("id"))
    return b.cat(t).select("id", "model_id").join(done, "id", "left_anti")


COVERAGE = (
    "f AS (SELECT DISTINCT translate(lower(trim(split_part(replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '_finetunes_20250529.csv' ELSE '.csv' END, '_finetunes_', 1))), '-/_', '') AS fname"
    " FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40))",
    "ids AS (SELECT id, translate(lower(trim(split_part(model_id, '/', 2))), '-/_', '') AS name FROM cat)",
    "cov AS (SELECT id, CASE WHEN name IN (SELECT fname FROM f) THEN 'exact' WHEN EXISTS (SELECT 1 FROM f WHERE contains(fname, name)) THEN 'contained' ELSE 'missing' END AS status FROM ids)")


def stored_files(t: Tables):
    """Names of the tree files collected so far (stand-in: parts that were returned in large lots), as a stored table."""
    sold = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).select(F.col("l_partkey").alias("p_partkey")).distinct()
    names = t.part.join(wide(sold), "p_partkey", "left_semi").select(F.concat(
        F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_partkey").cast("string"),
        F.when(F.col("p_partkey") % 2 == 0, "_finetunes_20250529.csv").otherwise(".csv")).alias("file"))
    path = scratch_path(t.spark, "tree-files")
    names.write.parquet(path)
    return t.spark.read.schema(names.schema).parquet(path)


def coverage(ids: DataFrame, files: DataFrame) -> DataFrame:
    """``id, status`` of every id with a name: ``exact`` (equal to a file's normalised base name), ``contained`` in one,
    or ``missing``. The base name is what stands before ``_finetunes_`` (the file name if nothing does)."""
    norm = lambda x: F.translate(F.lower(F.trim(x)), "-/_", "")
    base = F.split_part("file", F.lit("_finetunes_"), F.lit(1))
    texts = files.select(norm(F.when(base != "", base).otherwise(F.col("file"))).alias("text")).distinct()
    parts = F.split("model_id", "/")
    named = ids.where(F.trim("model_id") != "").select("id", norm(F.when(F.size(parts) == 2, parts[1]).otherwise(F.col("model_id"))).alias("name"))
    exact = texts.select(F.col("text").alias("name"), F.lit("exact").alias("e"))
    inside = contained_names(named.join(wide(exact), "name", "left_anti"), texts).withColumn("c", F.lit("contained"))
    return named.join(wide(exact), "name", "left").join(wide(inside), "name", "left").select("id", F.coalesce("e", "c", F.lit("missing")).alias("status"))


@query("coverage_found_missing", sql=b.with_views("SELECT id, status FROM cov", "cat", ctes=COVERAGE))
def q_coverage_found_missing(t: Tables):
    """Catalog ids found among the stored tree files by name or as part of one, or missing."""
    return coverage(b.cat(t).select("id", "model_id"), stored_files(t))


@query("coverage_summary", sql=b.with_views(
    "SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM cov GROUP BY status", "cat", ctes=COVERAGE))
def q_coverage_summary(t: Tables):
    """Number and percentage of the catalog ids per way of being found."""
    n = coverage(b.cat(t).select("id", "model_id"), stored_files(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return n.select("status", "n", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))  # three rows
