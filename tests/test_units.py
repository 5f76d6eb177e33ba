"""Unit cases: literal rows of the reference, and brute-force checks of the
operators that replace single-partition windows."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinframe.functions import params as P
from kinframe.operators import graph as g
from kinframe.operators import similarity as S
from kinframe.operators import stats as st
from kinframe.operators.sequence import previous_in_group, running_sum
from kinframe.plans.text import repo_file_list


def test_repo_sibling_flags(spark):
    def meta(files):
        return json.dumps({"siblings": [f"RepoSibling(rfilename='{f}', size=1, blob_id='x')" for f in files]})
    rows = [("bert-base-uncased", meta(["config.json", "model.safetensors.index.json", "tokenizer.json"])),
            ("gpt2", meta(["config.json", "pytorch_model.bin", "tokenizer.json"])),
            ("my-custom-model", meta(["README.md", "config.json"])),
            ("another-model-with-index", meta(["config.json", "model.safetensors.index.json", "special_weights.bin"]))]
    df = spark.createDataFrame(rows, "model_id string, metadata string")
    f = repo_file_list(F.col("metadata"))
    got = df.select("model_id", (F.array_contains(f, "config.json")
                                 & F.array_contains(f, "model.safetensors.index.json")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, True]


def test_number_texts(spark):
    rows = [("127k", 127e3), ("8x7b", 56e9), ("1,234,567", 1234567.0), ("1e9", 1e9), ("1.5 million", 1.5e6),
            ("abc", None), ("", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = [r.value for r in P.parse_suffixed_number(df, "t", "value").collect()]
    assert got == [v for _, v in rows]


def test_card_params(spark):
    df = spark.createDataFrame([("~127k parameters",), ("Params: 17K",), ("nothing here",)], "card string")
    got = [r.p for r in P.params_from_card(df, "card", "p").collect()]
    assert got == [127e3, 17e3, None]


def test_small_tree_depths(spark):
    # root, three children, one grandchild: depths 0,1,1,2,1; children 3,0,1,0,0
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 4), (2, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    d = {r.id: r.depth for r in g.bfs_depths(edges, g.roots(nodes, edges)).collect()}
    assert [d[i] for i in range(5)] == [0, 1, 1, 2, 1]
    deg = {r.id: r.out_degree for r in g.degrees(nodes, edges).collect()}
    assert [deg[i] for i in range(5)] == [3, 0, 1, 0, 0]


def test_lag_with_hot_key(spark):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 20), rnd.randint(0, 50), i, rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, ts long, id long, v double")
    got = previous_in_group(df, "k", ["ts", "id"], ["v"], buckets=6).select("id", "prev_v")
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("id", F.lag("v").over(w).alias("want"))
    bad = got.join(want, "id").where(~F.col("prev_v").eqNullSafe(F.col("want"))).count()
    assert bad == 0


def test_running_sum_matches_window(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3), i, rnd.randint(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = running_sum(df, ["k"], ["o"], "v", "rs", inclusive=False, buckets=5)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "o", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("want"))
    assert got.join(want, ["k", "o"]).where(F.col("rs") != F.col("want")).count() == 0


def test_exact_quantiles_and_gini(spark):
    rnd = random.Random(7)
    xs = [float(rnd.randint(0, 40)) for _ in range(999)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    q = st.exact_quantiles(df, "x", [0.1, 0.5, 0.9]).collect()[0]
    assert np.allclose([q.q10, q.q50, q.q90], np.percentile(xs, [10, 50, 90]))
    arr = np.sort(np.array(xs) + 1e-9)
    n = arr.size
    want = np.sum((2 * np.arange(1, n + 1) - n - 1) * arr) / (n * arr.sum())
    assert abs(st.gini(df, "x").collect()[0].gini - want) < 1e-9


def _lev(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_levenshtein_similarity_brute_force(spark):
    pairs = [("chat-éé", "chat-ee"), ("", ""), ("", "x"), ("kitten", "sitting"), ("Übermodell", "Ubermodel")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.s for r in df.select(S.levenshtein_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    for (a, b), s in zip(pairs, got):
        want = 1.0 if not a and not b else (0.0 if not a or not b else 1 - _lev(a, b) / max(len(a), len(b)))
        assert abs(s - want) < 1e-12


def test_levenshtein_key_on_fixture(spark):
    import __spark_entry__ as E
    rows = E.queries()["levenshtein_similarity"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert rows
    short = [r for r in rows if len(docs[r.u]) * len(docs[r.v]) <= 1_500_000]  # whole texts; plain Python is slow
    assert len(short) >= 30
    for r in short:
        a, b = docs[r.u], docs[r.v]
        want = 1 - _lev(a, b) / max(len(a), len(b)) if a or b else 1.0
        assert abs(r.similarity - want) < 1e-6  # key output is rounded to 6 places


def test_edit_distance_of_bits(spark):
    import random
    from kinframe.plans.registry import QUERIES
    draw = random.Random(3)
    for k in range(1500):
        letters = "ab" if k % 2 else "abcdé中\0😀"
        a, b = ("".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 5, 9, 31, 70]))) for _ in "ab")
        b = a[:len(a) // 2] + b + a[len(a) // 2:] if k % 3 == 0 else b
        assert S.edit_distance(a, b) == S.edit_distance(b, a) == _lev(a, b)
    assert S.edit_distance(None, "a") is None
    # the texts do not pass through the driver
    plan = QUERIES["levenshtein_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_null_keys_and_constant_columns(spark):
    rows = [(None, 1, 5.0), (None, 2, 7.0), ("a", 1, 1.0), ("a", 3, 2.0), ("a", 2, 4.0)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    got = {(r.k, r.o): r.prev_v for r in previous_in_group(df, "k", ["o"], ["v"], buckets=4).collect()}
    assert got == {(None, 1): None, (None, 2): 5.0, ("a", 1): None, ("a", 2): 1.0, ("a", 3): 4.0}
    got = {(r.k, r.o): r.rs for r in running_sum(df, ["k"], ["o"], "v", "rs", buckets=4).collect()}
    assert got == {(None, 1): 5.0, (None, 2): 12.0, ("a", 1): 1.0, ("a", 2): 5.0, ("a", 3): 7.0}
    q = {r.k: r.q50 for r in st.exact_quantiles(df, "v", [0.5], key=["k"]).collect()}
    assert q == {None: 6.0, "a": 2.0}
    h = st.fixed_histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 2).collect()
    assert [(r.bin_lo, r.bin_hi, r.n) for r in h] == [(3.0, 3.5, 4)]


def test_quoted_commas_stay_in_list_items(spark):
    from kinframe.functions.ids import parse_list_text
    texts = ['["a, b", "c"]', "['x', 'y, z']", "[1, 2]", "p, q", "[]", None]
    got = [r.l for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_list_text("t").alias("l")).collect()]
    assert got == [["a, b", "c"], ["x", "y, z"], ["1", "2"], ["p", "q"], [], []]


def test_last_listed_parent_wins(spark):
    from kinframe.operators.graph import single_parent_tree
    rel = spark.createDataFrame([(9, 3, 0), (9, 1, 2), (9, 77, 5), (8, 2, 1)], "dst long, src long, pos int")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (8,), (9,)], "id long")
    assert {r.id: r.parent for r in single_parent_tree(rel, nodes).collect()} == {9: 1, 8: 2}
