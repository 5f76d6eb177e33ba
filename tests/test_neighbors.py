"""Vector search, clusters and document pairs against all pairs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.operators import pairs as P
from kinframe.operators import similarity as S
from kinframe.operators import vectors as V
from kinframe.operators.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x double, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "z", 0.5, 3) for i, v, c in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 8)) * 3
    out = []
    for k in range(600):
        c = int(rng.integers(0, 12))
        out.append((k, [float(np.float32(e)) for e in centres[c] + rng.standard_normal(8) * (0.3 if c else 2)], c))
    hot = out[40][1]
    out += [(1000 + k, hot, out[40][2]) for k in range(300)]  # a third of all rows are copies
    out += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [math.nan] * 8, 2), (2003, [0.0] * 8, 3), (2004, [1.0], 1),
            (None, hot, 1), out[7]]
    return out


def clean(rows):
    kept = {(i, tuple(v)): c for i, v, c in rows if i is not None and v is not None and len(v) == 8
            and all(e is not None and math.isfinite(e) for e in v)}
    return [(i, np.array(v), c) for (i, v), c in kept.items()]


@pytest.mark.parametrize("block", [1024, 32])
def test_nearest_equals_all_pairs(spark, rows, block, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "QUERIES", 4)
    got, met = V.nearest(frame(spark, rows), 5, F.col("id") % 50 == 0)
    kept = [(i, v / np.linalg.norm(v)) for i, v, _ in clean(rows) if v.any()]
    want = set()
    for i, v in kept:
        if i % 50 == 0:
            best = sorted((-round(float(v @ w), 6), j) for j, w in kept if j != i)[:5]
            want |= {(i, j, -s, r) for r, (s, j) in enumerate(best, 1)}
    assert {(r.id, r.neighbour, r.similarity, r.rank) for r in got.collect()} == want
    share = [r.met for r in met.collect()]
    assert len(share) == len({w[0] for w in want}) and max(share) <= len(kept) and sum(share) < 0.8 * len(share) * len(kept)


def test_rows_that_meet_all_cells_leave_in_small_batches(spark, monkeypatch):
    """In 64 random dimensions no bound excludes a cell; what a task holds must not be rows times cells vectors."""
    from pyspark.sql.classic.dataframe import DataFrame
    run = DataFrame.mapInArrow

    def small(self, f, schema, *args):
        def held(batches):
            for out in f(batches):
                if out.nbytes > 10 << 20:
                    raise AssertionError(f"a batch of {out.nbytes} bytes")
                yield out
        return run(self, held, schema, *args)

    monkeypatch.setattr(DataFrame, "mapInArrow", small)
    x = np.random.default_rng(3).standard_normal((4096, 64)).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in V.nearest(table, 5, F.col("id") >= 0)[0].collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbour
    s = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(s @ s.T, 6)
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert got == {i: dict(enumerate(b.tolist(), 1)) for i, b in enumerate(best)}
    assert {(r.cluster, r.core) for r in V.density_clusters(table, 30.0, 3).collect()} == {(0, True)}


def test_few_vectors(spark):
    two = frame(spark, [(0, [1.0, 0.0], 1), (50, [1.0, 1.0], 1)])
    assert sorted((r.id, r.neighbour, r.rank) for r in V.nearest(two, 5, F.col("id") % 50 == 0)[0].collect()) == [(0, 50, 1), (50, 0, 1)]
    for none in (frame(spark, []), frame(spark, [(0, None, 1)]), frame(spark, [(0, [], 1)])):
        assert V.nearest(none, 5, F.col("id") % 50 == 0)[0].collect() == []
        assert V.density_clusters(none, 1.0, 2).collect() == []
        assert V.silhouette(none, "vec_id", "label", "embedding").collect()[0].silhouette is None


def dbscan(points, eps, least):
    x = np.array([v for _, v, _ in points])
    ids = np.array([i for i, _, _ in points])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, label = near.sum(1) >= least, {}
    for s in np.argsort(ids):
        if core[s] and s not in label:
            todo, label[s] = [s], ids[s]
            while todo:
                p = todo.pop()
                for t in np.flatnonzero(near[p] & core):
                    if t not in label:
                        label[t] = ids[s]
                        todo.append(t)
    out = {}
    for p in range(len(ids)):
        around = [label[t] for t in np.flatnonzero(near[p] & core)]
        out[int(ids[p])] = (int(label[p]) if core[p] else int(min(around, default=-1)), bool(core[p]))
    return out


@pytest.mark.parametrize("eps,least,block", [(0.9, 4, 1024), (1.4, 3, 16), (0.0, 2, 64)])
def test_density_clusters_equal_dbscan(spark, rows, eps, least, block, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", block)
    got = {r.id: (r.cluster, r.core) for r in V.density_clusters(frame(spark, rows), eps, least).collect()}
    assert got == dbscan(clean(rows), eps, least)
    assert any(c == -1 for c, _ in got.values()) and len({c for c, _ in got.values()}) > 1


def test_silhouette_equals_all_pairs(spark, rows, monkeypatch):
    kept = [p for p in clean(rows) if p[2] != 4] + [(5000, np.ones(8), 77)]
    x, c = np.array([v for _, v, _ in kept]), np.array([k for _, _, k in kept])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    values = []
    for i in range(len(c)):
        own = (c == c[i]).sum()
        a = d[i][c == c[i]].sum() / max(own - 1, 1)
        b = min(d[i][c == k].mean() for k in set(c) if k != c[i])
        values.append(0 if own == 1 else (b - a) / max(a, b))
    table = frame(spark, rows + [(5000, [1.0] * 8, 77), (5001, [2.0] * 8, None)])
    for room in (V.CENTROIDS, 24):  # all centroids at once, and in blocks
        monkeypatch.setattr(V, "CENTROIDS", room)
        got = V.silhouette(table, "vec_id", "label", "embedding", noise=4).collect()[0]
        assert (got.items, got.clusters) == (len(c), len(set(c))) and got.silhouette == pytest.approx(np.mean(values), abs=1e-9)
    one = V.silhouette(table.where("label = 2"), "vec_id", "label", "embedding").collect()[0]
    assert one.clusters == 1 and one.silhouette is None


def test_components(spark):
    links = [(5, 4), (4, 9), (1, 1), (20, 21), (21, 20), (9, 30), (40, 41)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {5: 4, 4: 4, 9: 4, 30: 4, 1: 1, 20: 20, 21: 20, 40: 40, 41: 40, **{k: 100 for k in range(100, 161)}}


TEXTS = ["red green blue", "red green blue", "blue green red", "red green blue teal", "the the the", "the", "the cat", "the cat sat",
         "a cat sat", "", None, "unique words here", "red red green green blue blue", "sat cat the", "teal teal", "zebra yak"]


def sparse(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tf = S.term_counts(docs, "doc_id", S.tokens("text"))
    return docs, tf, S.tfidf(tf, docs.agg(F.count(F.lit(1)).alias("n")))


def cosines(weights, n):
    w = {}
    for r in weights.collect():
        w.setdefault(r.doc, {})[r.term] = r.weight
    return {(u, v): sum(x * w.get(v, {}).get(t, 0) for t, x in w.get(u, {}).items()) for u, v in itertools.combinations(range(n), 2)}


@pytest.mark.parametrize("k", [1, 5, 12, 60])
def test_top_pairs_equal_all_pairs(spark, k):
    _, tf, w = sparse(spark, TEXTS)
    want = sorted((-round(s, 6), u, v) for (u, v), s in cosines(w, len(TEXTS)).items() if round(s, 6) > 0)[:k]
    got = [(-r.similarity, r.u, r.v) for r in P.top_pairs(tf, w, k).collect()]
    assert sorted(got) == [(pytest.approx(s), u, v) for s, u, v in want]


def test_top_pairs_of_no_documents(spark):
    _, tf, w = sparse(spark, ["alone", "other"])
    assert P.top_pairs(tf, w, 5).collect() == [] and P.top_pairs(tf.limit(0), w.limit(0), 5).collect() == []


def test_similarity_by_depth_equals_all_pairs(spark):
    _, _, w = sparse(spark, TEXTS)
    depth = {i: [0, 1, 1, 3][i % 4] for i in range(len(TEXTS))}
    table = spark.createDataFrame([*depth.items(), (99, None)], "doc long, depth int")
    want = {}
    for (u, v), s in cosines(w, len(TEXTS)).items():
        want.setdefault(abs(depth[u] - depth[v]), []).append(s)
    got = {r.depth_difference: (r.pairs, r.mean_similarity) for r in P.similarity_by_depth(w, table).collect()}
    assert got == {d: (len(s), pytest.approx(np.mean(s))) for d, s in want.items()}
    assert P.similarity_by_depth(w, table.limit(0)).collect() == []
