"""Bootstrap statistics from a histogram.

A bootstrap replicate draws n rows of n with replacement; its statistics depend only on how many draws fall on each
distinct cell (value, depth). So a replicate is drawn as a multinomial split of n over the cells, by conditional
binomials, and costs the number of cells, not n. A binomial is the quantile of a uniform number that a hash of
(seed, group, replicate, cell) gives: every engine that evaluates the same quantile draws the same replicate.

The cells of a group lie in value order in chunks of ``max(256, sqrt(cells))``. One step per group splits n over the
chunks; then each chunk splits its share over its cells, for all replicates at once (vectorised over them). No task
holds more than a chunk and the replicates' shares of it, and each adds up its part of every statistic; the position
of a quantile lies in the chunk that the shares before it say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinframe.functions.common import wide
from kinframe.operators.sequence import dense_index
from kinframe.session import ship_package

CHUNK = 256
QUARTERS = (0.25, 0.5, 0.75)


def uniforms(seed: int, group: str, replicates: np.ndarray) -> Callable[[str], np.ndarray]:
    """For a cell, the replicates' numbers in [0, 1): the first 60 bits of the md5 of ``seed:group:replicate:cell``."""
    begun = [hashlib.md5(f"{seed}:{group}:{r}:".encode()) for r in replicates]

    def of(cell: str) -> np.ndarray:
        ends, text = [], cell.encode()
        for h in begun:
            h = h.copy()
            h.update(text)
            ends.append(h.digest())
        return (np.frombuffer(b"".join(ends), ">u8")[::2] >> np.uint64(4)).astype(np.int64) / float(1 << 60)

    return of


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Elementwise the least k with P(Binomial(n, p) <= k) >= u, up to masses of less than 2^-60. The masses are built outward from the mode by their
    ratios and normalised, so no factorial is needed; the work is that of the standard deviation."""
    if p >= 1:
        return n.copy()
    if p <= 0 or not n.any():
        return np.zeros(len(n), np.int64)
    half = int(np.ceil(9 * np.sqrt(n.max() * p * (1 - p)))) + 20
    step, odds, out = np.arange(half), p / (1 - p), np.empty(len(n), np.int64)
    rows = max(1, (1 << 21) // half)
    for at in range(0, len(n), rows):
        size = n[at:at + rows, None].astype(float)
        mode = np.minimum(np.floor((size + 1) * p), size)
        up = np.cumprod(np.maximum(size - mode - step, 0) / (mode + 1 + step) * odds, axis=1)
        down = np.cumprod(np.maximum(mode - step, 0) / (size - mode + 1 + step) / odds, axis=1)
        mass = np.cumsum(np.concatenate([down[:, ::-1], np.ones((len(size), 1)), up], axis=1), axis=1)
        below = (mass < u[at:at + rows, None] * mass[:, -1:]).sum(1)
        out[at:at + rows] = np.clip(mode[:, 0] - half + below, 0, size[:, 0])
    return out


def split(n: np.ndarray, weights: Sequence[int], draws: Callable[[int], np.ndarray]) -> np.ndarray:
    """Multinomial split of each n over cells of these weights: (replicates x cells). ``draws(i)`` gives the
    uniform numbers of cell i."""
    left, rest = n.astype(np.int64), int(sum(weights))
    out = np.zeros((len(n), len(weights)), np.int64)
    for i, w in enumerate(weights):
        if not left.any():
            break
        out[:, i] = binomial_quantile(draws(i), left, w / rest)
        left, rest = left - out[:, i], rest - int(w)
    return out


def _cells(rows: DataFrame, group: str, value: str, depth: str) -> DataFrame:
    """Distinct cells with their weight, rank and chunk; rows without a positive value are one cell of chunk -1."""
    v = F.when(F.col(value) > 0, F.col(value).cast("double"))
    cells = rows.select(F.col(group).cast("string").alias("g"), v.alias("v"),
                        F.when(v.isNotNull(), F.coalesce(F.col(depth).cast("double"), F.lit(0.0))).alias("d"))
    cells = cells.groupBy("g", "v", "d").agg(F.count(F.lit(1)).alias("w"))
    kept = dense_index(cells.where("v IS NOT NULL"), ["g"], ["v", "d"], "cell")
    size = kept.groupBy(F.col("g").alias("sg")).agg(F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.count(F.lit(1))))).alias("size"),
                                 (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("cv"),
                                 (F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("cd"))
    kept = wide(kept).join(size, F.col("g").eqNullSafe(F.col("sg"))).select(
        "g", "v", "d", "w", "cell", F.floor(F.col("cell") / F.col("size")).cast("long").alias("chunk"), "cv", "cd")
    none = cells.where("v IS NULL").select("g", "v", "d", "w", F.lit(-1).cast("long").alias("cell"),
                                           F.lit(-1).cast("long").alias("chunk"), F.lit(0.0).alias("cv"), F.lit(0.0).alias("cd"))
    return kept.unionByName(none).checkpoint()


_SHARE = "g string, chunk long, replicate int, n long, before long, valid long"


def _shares(cells: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """Per replicate and chunk: its draws, the valid draws before it, the valid draws of the replicate."""
    replicates = np.arange(n_boot, dtype=np.int64)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        g, chunks, weights = table["g"][0].as_py(), table["chunk"].to_pylist(), table["w"].to_pylist()
        uniform = uniforms(seed, g or "", replicates)
        n = split(np.full(n_boot, sum(weights), np.int64), weights,
                  lambda i: uniform(f"c{chunks[i]}"))
        valid = n[:, 1:] if chunks[0] == -1 else n
        before = np.cumsum(n, axis=1) - n - (n[:, :1] if chunks[0] == -1 else 0)
        c = len(chunks)
        return pa.table({"g": pa.array([g] * (c * n_boot), pa.string()), "chunk": np.tile(chunks, n_boot).astype(np.int64),
                         "replicate": np.repeat(replicates, c).astype(np.int32), "n": n.ravel(), "before": before.ravel(),
                         "valid": np.repeat(valid.sum(1), c)})

    totals = cells.groupBy("g", "chunk").agg(F.sum("w").alias("w"))  # at most sqrt(cells) rows a group, or cells / 256
    return totals.groupBy("g").applyInArrow(run, _SHARE)


def _per_chunk(cells: DataFrame, n_boot: int, seed: int, reduce: Callable, schema: str) -> DataFrame:
    """``reduce(cells of the chunk, shares of the replicates, draws)`` for every chunk with valid cells."""
    def run(own: pa.Table, shares: pa.Table) -> pa.Table:
        if not own.num_rows or not shares.num_rows:
            return arrow.empty_table()
        own, shares = own.sort_by("cell"), shares.sort_by("replicate")
        g, names, replicates = own["g"][0].as_py(), own["cell"].to_pylist(), shares["replicate"].to_numpy()
        uniform = uniforms(seed, g or "", replicates)
        draws = split(shares["n"].to_numpy(), own["w"].to_pylist(), lambda i: uniform(str(names[i])))
        return pa.table(reduce(own, shares, draws), schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    ship_package(cells.sparkSession)
    key = [F.coalesce("g", F.lit("")).alias("k"), "chunk"]  # a null group meets itself
    return cells.groupBy(*key).cogroup(_shares(cells, n_boot, seed).groupBy(*key)).applyInArrow(run, schema)


def replicate_weights(rows: DataFrame, group: str, value: str, depth: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """``g, replicate, cell, v, d, draws``: how often each replicate drew each cell (cell -1: rows without a value)."""
    def reduce(own, shares, draws):
        r, c = np.nonzero(draws)
        take = lambda name: own[name].take(pa.array(c))
        return {"g": take("g"), "replicate": shares["replicate"].take(pa.array(r)), "cell": take("cell"),
                "v": take("v"), "d": take("d"), "draws": draws[r, c]}

    return _per_chunk(_cells(rows, group, value, depth), n_boot, seed, reduce,
                      "g string, replicate int, cell long, v double, d double, draws long")


def replicate_statistics(rows: DataFrame, group: str, value: str, depth: str, bins: dict[str, tuple[float, float]],
                         gap: tuple[float, float], n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """One row per group and replicate with mean, median, standard deviation (n - 1), quartiles, correlation of depth
    and value, counts below / in / above the closed gap and per half-open bin.

    Rows whose value is null or not positive are drawn like all others and then left out of every statistic. A null
    depth counts as 0. A replicate without valid rows has zeros; a statistic that is not defined (deviation of one
    row, correlation with a constant) is null.
    """
    edges = list(bins.values())

    def reduce(own, shares, draws):
        v, d = own["v"].to_numpy(), own["d"].to_numpy()
        before, valid = shares["before"].to_numpy(), shares["valid"].to_numpy()
        live = ~np.isnan(v)
        x, y = np.where(live, v - own["cv"].to_numpy(), 0.0), np.where(live, d - own["cd"].to_numpy(), 0.0)
        n = draws * live
        ends = before[:, None] + np.cumsum(n, axis=1)
        out = {"g": own["g"].take(pa.array(np.zeros(len(draws), np.int64))), "replicate": shares["replicate"], "n": n.sum(1),
               "x": n @ x, "xx": n @ (x * x), "y": n @ y, "yy": n @ (y * y), "xy": n @ (x * y),
               "cv": np.full(len(draws), own["cv"][0].as_py()),
               "below": n @ (v < gap[0]), "inside": n @ ((v >= gap[0]) & (v <= gap[1])), "above": n @ (v > gap[1])}
        for q, share in enumerate(QUARTERS):
            place = np.maximum(valid - 1, 0) * share
            for side, at in (("lo", np.floor(place)), ("hi", np.ceil(place))):
                cell = (ends <= at[:, None]).sum(1)
                here = (cell < len(v)) & (at >= before) & (valid > 0)
                found = np.where(here, v[np.minimum(cell, len(v) - 1)], np.nan)
                out[f"{side}{q}"] = pa.array(found, mask=np.isnan(found))
        for b, (lo, hi) in enumerate(edges):
            out[f"b{b}"] = n @ ((v >= lo) & (v < hi))
        return {k: a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a).cast(
            pa.int64() if k in whole else pa.float64()) for k, a in out.items()}

    whole = ["n", "below", "inside", "above", *(f"b{b}" for b in range(len(edges)))]
    real = ["x", "xx", "y", "yy", "xy", "cv"]
    quarter = [f"{side}{q}" for q in range(len(QUARTERS)) for side in ("lo", "hi")]
    schema = "g string, replicate int, " + ", ".join([
        "n long", *(f"{c} double" for c in real), *(f"{c} long" for c in whole[1:4]), *(f"{c} double" for c in quarter),
        *(f"{c} long" for c in whole[4:])])
    parts = _per_chunk(_cells(rows, group, value, depth), n_boot, seed, reduce, schema)
    s = parts.groupBy("g", "replicate").agg(
        *[F.sum(c).alias(c) for c in [*whole, *real[:-1]]], F.max("cv").alias("cv"),
        *[F.max(c).alias(c) for c in quarter])
    n, none = F.col("n"), F.col("n") == 0
    or_zero = lambda c: F.when(none, 0.0).otherwise(c)
    var = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / n
    spread = F.greatest(var("x", "x", "xx"), F.lit(0.0))
    both = F.sqrt(spread * F.greatest(var("y", "y", "yy"), F.lit(0.0)))
    place = [F.greatest(n - 1, F.lit(0)) * share for share in QUARTERS]
    quarters = [F.col(f"lo{q}") + (F.col(f"hi{q}") - F.col(f"lo{q}")) * (p - F.floor(p)) for q, p in enumerate(place)]
    return s.select(
        "g", "replicate", "n", or_zero(F.col("cv") + F.col("x") / n).alias("mean"), or_zero(quarters[1]).alias("median"),
        or_zero(F.when(n > 1, F.sqrt(spread / (n - 1)))).alias("std"), or_zero(quarters[0]).alias("q1"),
        or_zero(quarters[2]).alias("q3"), or_zero(F.when(both > 0, var("x", "y", "xy") / both)).alias("correlation"),
        or_zero(100.0 * F.col("inside") / n).alias("gap_percentage"), "below", "above", "inside",
        *[F.col(f"b{b}").alias(name) for b, name in enumerate(bins)])


def intervals(replicates: DataFrame, group: str, statistics: dict[str, tuple[str, str]], level: float = 0.95) -> DataFrame:
    """``group, section, statistic, mean, ci_lower, ci_upper`` over the replicates; ``statistics`` maps a column to
    (section, statistic). Percentiles are linear; undefined replicates are left out."""
    tail = (1 - level) / 2
    long = replicates.select("g", F.explode(F.array(*[
        F.struct(F.lit(a).alias("section"), F.lit(b).alias("statistic"), F.col(f"`{c}`").cast("double").alias("x"))
        for c, (a, b) in statistics.items()])).alias("s")).select("g", "s.*")
    ends = long.groupBy("g", "section", "statistic").agg(F.avg("x").alias("mean"), F.percentile("x", F.array(
        F.lit(tail), F.lit(1 - tail))).alias("p"))  # as many values as replicates
    return ends.select(F.col("g").alias(group), "section", "statistic", "mean", F.get("p", F.lit(0)).alias("ci_lower"),
                       F.get("p", F.lit(1)).alias("ci_upper"))


def mean_interval(rows: DataFrame, group: str, value: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """``group, n, mean, ci_lower, ci_upper``: the mean of positive and negative values alike and its bootstrap
    interval. Null values are no observations; a group of nulls has no row."""
    kept = rows.where(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("x"))
    low = kept.groupBy(F.col("g").alias("lg")).agg(F.min("x").alias("low"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    # cells hold positive values only: move the group above zero, and the means back
    moved = kept.join(low, F.col("g").eqNullSafe(F.col("lg"))).select("g", (F.col("x") - F.col("low") + 1).alias("x"), F.lit(0).alias("d"))
    stats = replicate_statistics(moved, "g", "x", "d", {}, (0.0, 0.0), n_boot, seed).select("g", "replicate", "mean")
    ends = intervals(stats, "g", {"mean": ("", "mean")})
    return ends.withColumnRenamed("mean", "boot").join(low, F.col("g").eqNullSafe(F.col("lg"))).select(
        F.col("lg").alias(group), "n", F.col("m").alias("mean"), (F.col("ci_lower") + F.col("low") - 1).alias("ci_lower"),
        (F.col("ci_upper") + F.col("low") - 1).alias("ci_upper"))
