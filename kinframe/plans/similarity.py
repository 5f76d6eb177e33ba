"""Text / vector similarity keys (§2.5 words, §2.6 top terms, §2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions.common import r6, wide
from kinframe.functions.dictionaries import STOP_WORDS
from kinframe.operators import similarity as S
from kinframe.operators.topk import top_k, top_k_per_group
from kinframe.plans.registry import query
from kinframe.plans.sqlfn import q
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables

NONWORD = r"[^\p{L}\p{N}_]+"
TOK_SQL = f"regexp_extract_all(lower(text), {q(S.TOKEN)})"


def _docs(t: Tables):
    return t.documents.select("doc_id", "text", "lang")


def _split_tokens(c):
    t = F.regexp_replace(F.lower(c), NONWORD, " ")
    return F.filter(F.split(F.trim(t), " "), lambda x: x != "")


SPLIT_SQL = f"list_filter(string_split(trim(regexp_replace(lower(text), {q(NONWORD)}, ' ', 'g')), ' '), lambda x: x <> '')"
STOP_SQL = "[" + ", ".join(q(w) for w in STOP_WORDS) + "]"


@query("clean_tokens", sql=f"""SELECT doc_id, array_to_string(list_filter({SPLIT_SQL}, lambda x: NOT list_contains({STOP_SQL}, x) AND length(x) > 1), ' ') AS clean FROM documents""")
def q_clean_tokens(t: Tables):
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    toks = F.filter(_split_tokens(F.col("text")), lambda x: ~F.array_contains(stops, x) & (F.length(x) > 1))
    return _docs(t).select("doc_id", F.array_join(toks, " ").alias("clean"))


@query("token_frequencies", sql=f"SELECT token, count(*) AS n FROM (SELECT unnest({SPLIT_SQL}) AS token FROM documents) x GROUP BY token")
def q_token_frequencies(t: Tables):
    return (_docs(t).select(F.explode(_split_tokens(F.col("text"))).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def unigram_tf(t: Tables):
    return S.term_counts(_docs(t), "doc_id", S.tokens("text"))


TF_SQL = f"""tok AS (SELECT doc_id AS doc, unnest({TOK_SQL}) AS term FROM documents),
tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY doc, term)"""


def vocab_sql(cap=None):
    if cap is None:
        return "vocab AS (SELECT term, sum(tf) AS corpus_tf FROM tf GROUP BY term)"
    return f"vocab AS (SELECT term, corpus_tf FROM (SELECT term, sum(tf) AS corpus_tf FROM tf GROUP BY term) v ORDER BY corpus_tf DESC, term LIMIT {cap})"


def tfidf_sql(cap=None):
    return f"""{vocab_sql(cap)},
t2 AS (SELECT * FROM tf WHERE term IN (SELECT term FROM vocab)),
dfs AS (SELECT term, count(*) AS df FROM t2 GROUP BY term),
nd AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM t2 JOIN dfs USING (term), nd),
tw AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS weight FROM w)"""


def tfidf_table(t: Tables, cap: int | None = None, only=None):
    tf = unigram_tf(t)
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    return S.tfidf(S.restrict(tf, cap), n, only)


@query("top_words", sql=f"""WITH {TF_SQL}, {vocab_sql()}
SELECT term, CAST(corpus_tf AS BIGINT) AS n FROM vocab ORDER BY corpus_tf DESC, term LIMIT 20""")
def q_top_words(t: Tables):
    v = S.vocabulary(unigram_tf(t)).select("term", F.col("corpus_tf").cast("bigint").alias("n"))
    return top_k(v, [F.desc("n"), F.asc("term")], 20)


@query("top_words_tfidf", sql=f"""WITH {TF_SQL}, {tfidf_sql()}
SELECT term, round(sum(weight), 6) AS total_weight FROM tw GROUP BY term ORDER BY sum(weight) DESC, term LIMIT 20""")
def q_top_words_tfidf(t: Tables):
    s = tfidf_table(t).groupBy("term").agg(F.sum("weight").alias("w"))
    return top_k(s, [F.desc("w"), F.asc("term")], 20).select("term", r6("w").alias("total_weight"))


@query("top_words_by_type", sql=f"""WITH {TF_SQL}, {vocab_sql()}
SELECT lang, term, n, CAST(rk AS INTEGER) AS rank FROM (
  SELECT d.lang, tf.term, CAST(sum(tf.tf) AS BIGINT) AS n, row_number() OVER (PARTITION BY d.lang ORDER BY sum(tf.tf) DESC, tf.term) AS rk
  FROM tf JOIN documents d ON d.doc_id = tf.doc WHERE tf.term IN (SELECT term FROM vocab) GROUP BY d.lang, tf.term) x WHERE rk <= 10""")
def q_top_words_by_type(t: Tables):
    tf = unigram_tf(t)
    lang = t.documents.select(F.col("doc_id").alias("doc"), "lang")
    per = tf.join(lang, "doc").groupBy("lang", "term").agg(F.sum("tf").cast("bigint").alias("n"))
    return top_k_per_group(per, ["lang"], [F.desc("n"), F.asc("term")], 10, salt_cols=["term"]).select(
        "lang", "term", "n", "rank")


@query("bow_vectors", sql=f"""WITH toks AS (SELECT doc_id AS doc, {TOK_SQL} AS t FROM documents),
grams AS (SELECT doc, unnest(t) AS term FROM toks UNION ALL
  SELECT doc, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks WHERE len(t) > 1),
tf AS (SELECT doc, term, count(*) AS tf FROM grams GROUP BY doc, term), {vocab_sql()}
SELECT doc, term, tf FROM tf WHERE term IN (SELECT term FROM vocab)""")
def q_bow_vectors(t: Tables):
    tf = S.term_counts(_docs(t), "doc_id", S.with_bigrams(S.tokens("text")))
    return S.restrict(tf).select("doc", "term", "tf")


@query("tfidf_weights", sql=f"WITH {TF_SQL}, {tfidf_sql()} SELECT doc, term, round(weight, 6) AS weight FROM tw")
def q_tfidf_weights(t: Tables):
    return tfidf_table(t).select("doc", "term", r6("weight").alias("weight"))


@query("top_terms_per_doc", sql=f"""WITH {TF_SQL}, {tfidf_sql()}
SELECT doc, term, round(weight, 6) AS weight, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term) AS rk FROM tw) x WHERE rk <= 10""")
def q_top_terms_per_doc(t: Tables):
    w = tfidf_table(t)
    return top_k_per_group(w, ["doc"], [F.desc("weight"), F.asc("term")], 10, salt_cols=["term"]).select(
        "doc", "term", r6("weight").alias("weight"), "rank")


# No SQL oracle: DuckDB's levenshtein counts UTF-8 bytes, the reference (and
# Spark) count characters; tests/test_units.py checks this key by brute force.
@query("levenshtein_similarity")
def q_levenshtein_similarity(t: Tables):
    e = b.doc_edge(t)
    p = t.documents.select(F.col("doc_id").alias("src"), F.col("text").alias("a"))
    c = t.documents.select(F.col("doc_id").alias("dst"), F.col("text").alias("c"))
    # the distance costs the product of the lengths: spread the pairs whatever the file layout
    j = e.join(wide(p), "src").join(wide(c), "dst").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "dst")
    return j.select(F.col("src").alias("u"), F.col("dst").alias("v"),
                    r6(S.levenshtein_similarity(F.col("a"), F.col("c"))).alias("similarity"))


COS_SQL = """round(list_dot_product(CAST(a AS DOUBLE[]), CAST(c AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a AS DOUBLE[]), CAST(a AS DOUBLE[]))) * sqrt(list_dot_product(CAST(c AS DOUBLE[]), CAST(c AS DOUBLE[])))), 6)"""


@query("cosine_pairs", sql=b.with_views(
    f"""SELECT e.src AS u, e.dst AS v, {COS_SQL} AS cosine
FROM emb_edge e JOIN (SELECT vec_id, embedding AS a FROM embeddings) p ON p.vec_id = e.src
JOIN (SELECT vec_id, embedding AS c FROM embeddings) ch ON ch.vec_id = e.dst""", "emb_edge"))
def q_cosine_pairs(t: Tables):
    e = b.emb_edge(t)
    p = t.embeddings.select(F.col("vec_id").alias("src"), F.col("embedding").alias("a"))
    c = t.embeddings.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("c"))
    # the distance costs the product of the lengths: spread the pairs whatever the file layout
    j = e.join(p, "src").join(c, "dst").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "dst")
    return j.select(F.col("src").alias("u"), F.col("dst").alias("v"),
                    r6(S.cosine_dense(F.col("a"), F.col("c"))).alias("cosine"))


@query("cluster_sizes", sql="SELECT label AS cluster, count(*) AS members FROM embeddings GROUP BY label")
def q_cluster_sizes(t: Tables):
    return t.embeddings.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("members"))


@query("centroid_similarity", sql=f"""WITH x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY pos) AS cen FROM (SELECT label, pos, avg(v) AS m FROM x GROUP BY label, pos) y GROUP BY label)
SELECT p.label AS cluster_a, q.label AS cluster_b, round(list_dot_product(p.cen, q.cen) / (sqrt(list_dot_product(p.cen, p.cen)) * sqrt(list_dot_product(q.cen, q.cen))), 6) AS cosine
FROM c p JOIN c q ON p.label < q.label""")
def q_centroid_similarity(t: Tables):
    """Mean vector per cluster, cosine between every two centroids (clusters
    are few: the pair table is bounded by the square of the cluster count)."""
    x = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    cen = (x.groupBy("label", "pos").agg(F.avg("v").alias("m"))
           .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("l"))
           .select("label", F.transform("l", lambda s: s["m"]).alias("cen")))
    a = cen.select(F.col("label").alias("cluster_a"), F.col("cen").alias("ca"))
    c = cen.select(F.col("label").alias("cluster_b"), F.col("cen").alias("cb"))
    return a.join(c, F.col("cluster_a") < F.col("cluster_b")).select(
        "cluster_a", "cluster_b", r6(S.cosine_dense(F.col("ca"), F.col("cb"))).alias("cosine"))


@query("project_2d")
def q_project_2d(t: Tables):
    """Two principal components of the embeddings (Spark ML PCA, distributed
    covariance); signs fixed so the largest-magnitude loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(v)
    pcs = model.pc.toArray()  # 64 x 2 loadings: bounded by the vector width
    signs = [1.0 if pcs[abs(pcs[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(v).select("vec_id", vector_to_array("pc").alias("p"))
    return out.select("vec_id", r6(F.col("p")[0] * signs[0]).alias("x"), r6(F.col("p")[1] * signs[1]).alias("y"))
