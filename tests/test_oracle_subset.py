"""A representative subset of keys against their DuckDB oracle on sf0.001
(the full sweep at sf0.01 is ``python tests/oracle.py``)."""

import pytest

KEYS = ["net_flow_order", "trait_transitions", "build_edges", "edge_deltas", "bfs_descendants", "descendant_counts",
        "params_coalesced", "card_stats", "tags_by_prefix", "gini", "km_survival", "tfidf_weights", "assign_chunks",
        "top_children_by_downloads", "summary_by_depth", "bootstrap_mean_ci", "top_k_neighbors", "silhouette", "coverage_summary",
        "html_lineage_rows", "html_keywords", "flatten_nested_tree", "sample_uncle", "number_properties",
        "lin_trait_transitions", "field_presence_by_depth", "stream_new_ids"]


@pytest.fixture(scope="module")
def duck():
    from tests.oracle import duck as mk
    return mk("/root/testdata/sf0.001")


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    from tests.oracle import compare
    r = compare(spark, key, E.queries()[key], E.oracle_sql()[key], "/root/testdata/sf0.001", duck)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "net_flow" in df.columns


def test_every_key_has_a_builder():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
