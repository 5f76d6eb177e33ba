import math
import random

import numpy as np
import pytest

from kinframe.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, deviation string"


def brute(rows, k):
    """``{vec_id: (deviation, [projection / sqrt(e)])}``, eigenvalue shares, by whole numbers and numpy's solver."""
    width = max({len(v) for _, v in rows if v is not None}, key=lambda w: sum(v is not None and len(v) == w for _, v in rows))
    kept = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], float)
    n, sums = len(kept), [sum(v[d] for _, v in kept) for d in range(width)]
    y = x - x.mean(0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for _, v in kept]
    return [i for i, _ in kept], deviation, y @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n)


def run(spark, rows, k):
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    out = {}
    for r in whitening.whiten(frame, k).collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    spread = np.array([3, 2, 2, 1, .5, .2, .1, .05, .01, .01])
    return [(int(i), [float(np.float32(c)) for c in rng.standard_normal(10) * spread + 1]) for i in range(400)]


def test_whitening_equals_brute_force(session, cloud):
    rows = cloud + [(900, None), (901, [1.0] * 9 + [None]), (902, [1.0] * 9 + [math.nan]), (903, [1.0] * 9 + [math.inf]),
                    (904, [1.0]), (905, [1e30] * 10), (906, [])]
    got = run(session, rows, 8)
    ids, deviation, white, shares = brute([r for r in rows if r[0] != 905], 8)
    assert sorted(got) == sorted(ids)
    for i, dev, w in zip(ids, deviation, white):
        assert got[i][1].deviation == dev and got[i][1].n == len(ids) and len(got[i]) == 8
        for c in range(8):
            sign = np.sign(white[0, c]) * np.sign(got[ids[0]][c + 1].whitened)
            assert got[i][c + 1].whitened * sign == pytest.approx(w[c], abs=1e-8)
            assert got[i][c + 1].explained == pytest.approx(shares[c], rel=1e-9)
    assert got[0][1].identity_error < 1e-9


def test_copies_null_ids_and_low_rank(session):
    rng = random.Random(2)
    line = [(None if k == 0 else k // 2, [k * 1.0, 2.0 * k, rng.choice([0.0, 0.0])]) for k in range(20)]
    got = whitening.whiten(session.createDataFrame([(i, v, 1, 2, "x") for i, v in line], SCHEMA), 3).collect()
    assert len(got) == 20 and {r.component for r in got} == {1}  # one direction holds all variance
    assert got[0].identity_error < 1e-9 and got[0].explained == pytest.approx(1)
    assert sum(r.vec_id is None for r in got) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(session, rows):
    assert run(session, rows, 8) == {}


def test_large_numbers_stay_exact(session):
    rows = [(k, [float(k * 2 ** 40), 1.0]) for k in range(1, 40)]
    got = run(session, rows, 2)
    ids, deviation, _, _ = brute(rows, 1)
    assert [int(got[i][1].deviation) for i in ids] == deviation and max(deviation) > 2 ** 63


@pytest.mark.parametrize("n,kind", [(1, "any"), (2, "any"), (3, "any"), (40, "any"), (40, "equal"), (30, "blocks"), (25, "zero"),
                                    (50, "pairs"), (33, "rank")])
def test_eigenpairs(n, kind):
    rng = np.random.default_rng(n)
    b = rng.standard_normal((n, n))
    if kind == "any":
        a = b + b.T
    elif kind == "equal":
        a = 5 * np.eye(n)
    elif kind == "zero":
        a = np.zeros((n, n))
    elif kind == "blocks":
        a = np.kron(np.eye(n // 3), np.array([[2.0, 1, 0], [1, 2, 1], [0, 1, 2]]))
    elif kind == "pairs":
        q, _ = np.linalg.qr(b)
        a = (q * np.repeat(np.arange(n // 2) + 1.0, 2)) @ q.T
    else:
        a = b[:, :3] @ b[:, :3].T
    a = (a + a.T) / 2
    values, vectors = eigen.leading_pairs(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    size = max(1.0, np.abs(a).max())
    assert np.allclose(values, want, atol=1e-12 * size * n)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-11)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * size * n)
