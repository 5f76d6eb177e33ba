"""Mean and quartiles of every measure per depth, against the catalog's rows."""

import numpy as np

from kinframe.operators import stats as st
from kinframe.plans import stats as ps
from kinframe.plans.registry import ORACLE
from kinframe.sources.tables import Tables
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def test_every_measure_has_mean_and_quartiles_per_depth(spark):
    rows = ps.crawl_full(Tables(spark, SF)).select("depth", *ps.SPREAD).collect()
    got = {r.depth: r for r in ps.q_derivative_stats_by_depth(Tables(spark, SF)).collect()}
    assert set(got) == {r.depth for r in rows}
    for depth, row in got.items():
        own = [r for r in rows if r.depth == depth]
        assert row.n == len(own)
        for m in ps.KINDS + ["total_derivatives", "card_length"]:
            x = [r[m] for r in own if r[m] is not None]
            names = [f"mean_{m}", *[f"q{p}" if m == "total_derivatives" else f"q{p}_{m}" for p in (25, 50, 75)]]
            want = [np.mean(x), *np.quantile(x, [0.25, 0.5, 0.75])] if x else [None] * 4
            assert [row[c] for c in names] == [w if w is None else round(float(w), 6) for w in want]


def test_oracle_has_the_same_columns_and_rows(spark):
    key = "derivative_stats_by_depth"
    r = compare(spark, key, lambda s, d: ps.q_derivative_stats_by_depth(Tables(s, d)), ORACLE[key], SF, duck(SF))
    assert r["status"] == "ok", r
    assert "q75_card_length" in ORACLE[key] and "q25_merges_count" in ORACLE[key]


def test_quantiles_of_a_histogram_without_a_measure(spark):
    h = spark.createDataFrame([(0, "a", 1, 3), (0, "a", 5, 1), (0, "b", 2, 1), (1, "a", 7, 2)], "depth int, m string, v long, c long")
    got = {(r.depth, r.m): (r.q25, r.q50, r.q75) for r in st.histogram_quantiles(h, [0.25, 0.5, 0.75], ["depth", "m"]).collect()}
    assert got == {(0, "a"): (1, 1, 2), (0, "b"): (2, 2, 2), (1, "a"): (7, 7, 7)}
