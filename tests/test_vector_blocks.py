"""Blocks of vectors meet where they are stored: no vector leaves a task once for every cell that it meets."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from kinframe.operators import vectors as V
from tests.test_neighbors import dbscan

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, [float(e) for e in v]) for i, v in rows], SCHEMA)


def clusters(spark, rows, eps, least):
    return {r.id: (r.cluster, r.core) for r in V.density_clusters(table(spark, rows), eps, least).collect()}


def all_pairs(rows, k):
    """The k nearest ids of every id, each id by its best vector."""
    best = {}
    for i, v in rows:
        for j, w in rows:
            if i != j:
                s = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6)
                best[i, j] = max(best.get((i, j), -2), s)
    return {i: [j for _, j in sorted((-s, j) for (a, j), s in best.items() if a == i)[:k]] for i, _ in rows}


def neighbours(spark, rows, k):
    got = {}
    for r in sorted(V.nearest(table(spark, rows), k, F.lit(True))[0].collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append(r.neighbour)
    return got


@pytest.fixture
def sent(spark, monkeypatch):
    """Bytes that leave Python functions on batches."""
    total, run = spark.sparkContext.accumulator(0), DataFrame.mapInArrow

    def counted(self, f, schema, *args):
        def held(batches):
            for out in f(batches):
                total.add(out.nbytes)
                yield out
        return run(self, held, schema, *args)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    return total


def test_vectors_that_meet_all_cells_are_not_copied(spark, sent):
    """In 64 random dimensions no bound excludes a cell; there are 64 cells."""
    x = np.random.default_rng(4).standard_normal((4096, 64))
    found = clusters(spark, enumerate(x), 8.5, 3)
    assert {i: (int(c), core) for i, (c, core) in found.items()} == dbscan([(i, v, 0) for i, v in enumerate(x)], 8.5, 3)
    assert sent.value < 6 * x.nbytes
    before = sent.value
    assert len(neighbours(spark, enumerate(x), 5)) == len(x)
    assert sent.value - before < 6 * x.nbytes


@pytest.mark.parametrize("block", [4096, 16])
def test_chains_and_exact_distances(spark, block, monkeypatch):
    """A chain through many blocks is one cluster; a distance of exactly eps counts."""
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "QUERIES", 7)
    rows = [(1000 - k, np.array([float(k), 0.0])) for k in range(150)] + [(2000 + k, np.array([float(k % 9), 50.0 + k // 9 * 1.001])) for k in range(60)]
    rows += [(3000, np.array([-1.0, 0.0])), (3001, np.array([4.0, 49.0])), (3002, np.array([300.0, 0.0]))]
    assert clusters(spark, rows, 1.0, 3) == dbscan([(i, v, 0) for i, v in rows], 1.0, 3)


@pytest.mark.parametrize("block", [4096, 8])
def test_nearest_of_ids_with_many_vectors(spark, block, monkeypatch):
    """More vectors of one id than neighbours asked for don't crowd out the others; equal vectors come by id."""
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "QUERIES", 5)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(4)) for i in range(40)]
    rows += [(7, rows[0][1] + rng.standard_normal(4) * 0.01) for _ in range(12)]  # all nearest to id 0
    rows += [(500 + i, rows[3][1] * (i + 1)) for i in range(20)]  # one direction
    assert neighbours(spark, rows, 3) == all_pairs(rows, 3)
