"""Tables that grow with the input are joined by shuffles, however small they are here."""

from pyspark.sql import functions as F

from kinframe.operators import graph as g
from kinframe.operators import vectors as V
from kinframe.operators.components import components
from kinframe.operators.names import contained_names
from kinframe.plans.registry import QUERIES
import kinframe.plans  # noqa: F401  registers the queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_joins(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "id long")
    links = spark.createDataFrame([(i // 2, i, "merge") for i in range(1, 9)] + [(99, 3, "merge")], "src long, dst long, rel string")
    edges = g.build_edges(links, nodes)
    names = spark.createDataFrame([("abcdefgh",), ("abc",)], "name string")
    texts = spark.createDataFrame([("xxabcdefghxx",)], "text string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    for df in (edges, g.roots(nodes, edges), g.descendant_counts(nodes, edges), g.degrees(nodes, edges), contained_names(names, texts),
               components(links.select(F.col("src").alias("u"), F.col("dst").alias("v"))), V.density_clusters(vectors, 1.1, 2),
               QUERIES["sorted_by_depth"](spark, "/root/testdata/sf0.001"), QUERIES["coverage_found_missing"](spark, "/root/testdata/sf0.001")):
        assert "BroadcastHashJoin" not in plan(df)


def test_histograms_do_not_pass_through_the_driver(spark):
    """Running sums, quantiles and counts by depth join the histogram by shuffles; it grows with the distinct values."""
    from kinframe.operators import sequence, stats
    rows = spark.createDataFrame([(i % 3, i) for i in range(60)], "g long, x long")
    for df in (sequence.dense_index(rows, ["g"], ["x"], "at"), stats.exact_quantiles(rows, "x", [0.25, 0.5], ["g"]),
               QUERIES["crosstab_by_depth_type"](spark, "/root/testdata/sf0.001")):
        assert df.collect()  # the plan that ran: sizes are known then
        assert "BroadcastHashJoin" not in plan(df)


def test_terms_are_counted_where_the_document_lies(spark):
    """The texts are exchanged once by their id, the (document, term) rows are not."""
    p = plan(QUERIES["bow_vectors"](spark, "/root/testdata/sf0.001"))
    assert p.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_COL" in p


def test_weights_of_some_documents_equal_those_of_all(spark):
    from kinframe.operators import similarity as S
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 5 + 1))) for i in range(12)], "doc_id long, text string")
    tf, n = S.term_counts(docs, "doc_id", S.tokens("text")), docs.agg(F.count(F.lit(1)).alias("n"))
    some = spark.createDataFrame([(3,), (7,), (99,)], "doc long")
    rows = lambda d: sorted((r.doc, r.term, round(r.weight, 9)) for r in d.collect())
    assert rows(S.tfidf(tf, n, some)) == [r for r in rows(S.tfidf(tf, n)) if r[0] in (3, 7)]


def test_term_counts_are_stored_as_parquet(spark):
    """Tables of a row per document and term are not checkpoints, which are several times larger."""
    assert "ExistingRDD" not in plan(QUERIES["tfidf_weights"](spark, "/root/testdata/sf0.001"))
