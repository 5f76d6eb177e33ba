"""Descendant counts, closures and trait transitions of random graphs against plain traversals."""

import random

import pytest

from kinframe.operators import graph as g
from kinframe.operators import traits as tr


def reach(edges, start):
    out, todo = {}, [(start, 0)]
    for node, d in todo:
        for a, b in edges:
            if a == node and b not in out:
                out[b] = d + 1
                todo.append((b, d + 1))
    return out


def graphs():
    rng = random.Random(4)
    tree = [(rng.randrange(0, k), k) for k in range(1, 60)]
    dag = tree + [(rng.randrange(0, 40), rng.randrange(40, 60)) for _ in range(6)] + [(100, 101), (101, 102), (100, 102), (102, 103)]
    cycle = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (6, 7), (8, 9), (9, 10), (0, 8), (5, 11), (20, 3)]
    return {"tree": tree, "dag": dag, "cycle": cycle, "chain": [(k, k + 1) for k in range(40)], "none": [],
            "random": [(rng.randrange(30), rng.randrange(30)) for _ in range(40)]}


@pytest.mark.parametrize("name", list(graphs()))
def test_descendant_counts_equal_traversal(spark, name):
    edges = graphs()[name]
    ids = sorted({x for e in edges for x in e} | {500})
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    table = spark.createDataFrame(edges + edges[:3], "src long, dst long")
    got = {r.id: r.n_descendants for r in g.descendant_counts(nodes, table).collect()}
    assert got == {i: len(reach(edges, i)) for i in ids}


def test_closure_from_some_nodes(spark):
    edges = graphs()["dag"]
    table, some = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (100,)], "id long")
    got = {(r.ancestor, r.descendant, r.distance) for r in g.closure_pairs(table, start=some).collect()}
    assert got == {(s, d, n) for s in (0, 100) for d, n in reach(edges, s).items()}


def test_many_levels_are_folded(spark):
    table = spark.createDataFrame([(k, k + 1) for k in range(45)], "src long, dst long")
    got = {r.id: r.depth for r in g.bfs_depths(table, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {k: k for k in range(46)}


def test_multi_valued_transitions(spark):
    rows = [(["a", "b"], ["b", "c"]), (["a"], ["a"]), ([], ["x"]), (["y"], []), (None, ["z"]), (["q", "a"], ["c", "d"])]
    table = spark.createDataFrame(rows, "src_traits array<string>, dst_traits array<string>")
    want = {}
    for s, d in rows:
        s, d = s or [], d or []
        for a in set(d) - set(s):
            for p in s:
                want.setdefault((p, a), [0, 0])[0] += 1
        for r in set(s) - set(d):
            for c in d:
                want.setdefault((r, c), [0, 0])[1] += 1
    got = {(r.from_trait, r.to_trait): [r.added_transitions, r.removed_transitions] for r in tr.trait_transitions(table).collect()}
    assert got == want
