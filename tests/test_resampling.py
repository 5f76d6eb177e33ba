"""Bootstrap by multinomial splits against replicates spelled out row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.operators import bootstrap as B

BINS = {"small": (0.0, 10.0), "mid": (10.0, 30.0), "big": (30.0, math.inf)}
GAP = (20.0, 25.0)


@pytest.mark.parametrize("n,p", [(1, .3), (7, .5), (40, .01), (200, .97), (1000, .4)])
def test_binomial_quantile_is_the_exact_one(n, p):
    mass = [math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)]
    below = np.cumsum(mass)
    u = np.random.default_rng(n).random(400)
    u = np.append(u, [1e-12, 1 - 1e-12])
    want = [min(int((below < x).sum()), n) for x in u]
    assert B.binomial_quantile(u, np.full(len(u), n), p).tolist() == want


def test_binomial_quantile_of_large_numbers():
    u = (np.arange(2000) + .5) / 2000
    k = B.binomial_quantile(u, np.full(2000, 10 ** 8), .25)
    assert abs(k.mean() - 25e6) < 30 and abs(k.std() / math.sqrt(10 ** 8 * .25 * .75) - 1) < .01
    mixed = B.binomial_quantile(np.full(3, .5), np.array([0, 5, 10 ** 6]), .5)
    assert mixed.tolist() == [0, 2, 500000]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [("a", float(rng.integers(1, 60)), int(rng.integers(0, 4))) for _ in range(300)]
    data += [("a", None, 1)] * 20 + [("a", -3.0, 2), ("a", 0.0, None), ("a", 5.0, None)]
    data += [("b", 1e12 * k, k) for k in range(1, 40)] + [("none", None, 1)] * 3 + [("one", 4.0, 2)] + [(None, 2.0, 1), (None, 3.0, 2)]
    return spark.createDataFrame(data, "g string, v double, d int"), data


@pytest.fixture(scope="module", params=[B.CHUNK, 5])
def weights(request, rows):
    old, B.CHUNK = B.CHUNK, request.param
    try:
        yield request.param, rows, B.replicate_weights(rows[0], "g", "v", "d", 50, 7).collect(), \
            B.replicate_statistics(rows[0], "g", "v", "d", BINS, GAP, 50, 7).collect()
    finally:
        B.CHUNK = old


def test_every_replicate_draws_as_many_rows_as_there_are(weights):
    _, (_, data), drawn, _ = weights
    sizes = {}
    for r in drawn:
        sizes[(r.g, r.replicate)] = sizes.get((r.g, r.replicate), 0) + r.draws
    for g in ("a", "b", "none", "one", None):
        n = sum(x[0] == g for x in data)
        assert all(sizes[(g, r)] == n for r in range(50))
    share = sum(r.draws for r in drawn if r.g == "a" and r.cell == -1) / 50
    assert abs(share - 22) < 3  # rows without a value are drawn, too


def test_statistics_equal_the_replicate_spelled_out(weights):
    _, _, drawn, stats = weights
    assert len(stats) == 5 * 50
    for s in stats:
        own = [r for r in drawn if r.g == s.g and r.replicate == s.replicate and r.v is not None]
        v, d = np.repeat([r.v for r in own], [r.draws for r in own]), np.repeat([r.d for r in own], [r.draws for r in own])
        assert s.n == len(v)
        if not len(v):
            assert (s.mean, s.median, s.std, s.correlation, s.small) == (0, 0, 0, 0, 0)
            continue
        assert s.mean == pytest.approx(v.mean()) and s.median == pytest.approx(np.median(v))
        assert (s.q1, s.q3) == (pytest.approx(np.quantile(v, .25)), pytest.approx(np.quantile(v, .75)))
        assert s.std is None if len(v) == 1 else s.std == pytest.approx(v.std(ddof=1), rel=1e-9, abs=1e-6)
        if len(set(v)) > 1 and len(set(d)) > 1:
            assert s.correlation == pytest.approx(np.corrcoef(v, d)[0, 1], abs=1e-6)
        else:
            assert s.correlation is None
        inside = ((v >= GAP[0]) & (v <= GAP[1])).sum()
        assert (s.below, s.inside, s.above) == ((v < GAP[0]).sum(), inside, (v > GAP[1]).sum())
        assert s.gap_percentage == pytest.approx(100 * inside / len(v))
        assert [s.small, s.mid, s.big] == [((v >= lo) & (v < hi)).sum() for lo, hi in BINS.values()]


def test_intervals_and_means(spark, rows):
    frame, data = rows
    out = {r.g: r for r in B.mean_interval(frame, "g", "v", 400, 3).collect()}
    assert set(out) == {"a", "b", "one", None}
    v = np.array([x[1] for x in data if x[0] == "a" and x[1] is not None])
    a = out["a"]
    assert a.n == len(v) and a.mean == pytest.approx(v.mean())
    half = 1.96 * v.std() / math.sqrt(len(v))
    assert abs(a.ci_lower - (v.mean() - half)) < half / 3 and abs(a.ci_upper - (v.mean() + half)) < half / 3
    assert (out["one"].mean, out["one"].ci_lower, out["one"].ci_upper) == (4, 4, 4)
    reps = B.replicate_statistics(frame.where("g = 'a'"), "g", "v", "d", BINS, GAP, 60, 3)
    ends = B.intervals(reps, "g", {"mean": ("dist", "mean"), "mid": ("bins", "mid")}).collect()
    values = [r.mean for r in reps.orderBy("replicate").collect()]
    m = next(r for r in ends if r.statistic == "mean")
    assert (m.section, m.mean) == ("dist", pytest.approx(np.mean(values)))
    assert (m.ci_lower, m.ci_upper) == tuple(pytest.approx(x) for x in np.percentile(values, [2.5, 97.5]))


def test_empty_input(spark, rows):
    none = rows[0].where(F.lit(False))
    assert B.replicate_statistics(none, "g", "v", "d", BINS, GAP, 10).collect() == []
    assert B.mean_interval(none, "g", "v", 10).collect() == []
