"""Whitening of embeddings on their leading principal components.

Every entry c becomes the whole number ``floor(1024 c) + 100000``. One pass adds up the vectors exactly, a second
one the centred products (centred on the exact sums before multiplying), so each task hands on one square matrix
of the vectors' width. The width bounds what reaches the driver, where Householder tridiagonalisation, Sturm-count
bisection and inverse iteration (``eigen``) give the components; they are broadcast (width x components doubles)
and every vector is projected where it lies. A last pass measures the covariance of the result.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.llm.eigen import EPS, leading_pairs

#: Fixed values of the contract: entries are scaled, cut to whole numbers and moved.
SCALE, OFFSET = 1024, 100000
#: Entries of this size or more have no such whole number in a long; they count as non-finite.
TOO_LARGE = float(1 << 52)


@dataclasses.dataclass(frozen=True)
class Whitening:
    """A fitted transform: exact count and sums, eigenvalues, components as columns, total variance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``: the whole part is taken off exactly, then the rest of the division."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Per row the sum of ``(n x - S)^2``, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        z = x - whole
        if len(z) == 0 or (float(np.abs(z).max()) + 1) ** 2 * float(self.n) ** 2 * z.shape[1] < 2.0 ** 62:
            return ((self.n * z - rest.astype(np.int64)) ** 2).sum(1)
        return ((self.n * z.astype(object) - rest) ** 2).sum(1)


def usable(col: str, width: int) -> Column:
    """The vector has ``width`` entries, none of them null, non-finite or too large."""
    return (F.size(col) == width) & F.forall(
        F.col(col), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < TOO_LARGE), F.lit(False)))


def _whole(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(SCALE * entries).astype(np.int64) + OFFSET


def common_width(vectors: DataFrame, col: str) -> int:
    """The commonest number of entries (of two equally common ones the greater); 0 without vectors."""
    widths = vectors.where(F.col(col).isNotNull()).groupBy(F.size(col).alias("w")).count()
    top = widths.orderBy(F.desc("count"), F.desc("w")).first()
    return top["w"] if top else 0


def fit(vectors: DataFrame, col: str, width: int, k: int) -> Whitening | None:
    """The transform of all ``vectors`` (arrays of double, all usable); None if there are none. A component whose
    variance is nothing but rounding is left out, so there can be fewer than ``k``."""
    low = (1 << 31) - 1

    def add_up(batches):
        n, total_low, total_high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _whole(batch.column(0), width)
            n += len(x)
            total_low += (x & low).sum(0)
            total_high += (x >> 31).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)),
                                              pa.array(total_low), pa.array(total_high)], ["d", "n", "lo", "hi"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = (vectors.select(col).mapInArrow(add_up, "d int, n long, lo long, hi long")
            .groupBy("d").agg(F.sum("n").alias("n"), wide("lo"), wide("hi")).orderBy("d").collect())  # ``width`` rows
    if not rows:
        return None
    n = rows[0]["n"]
    centre = Whitening(n, tuple((int(r["hi"]) << 31) + int(r["lo"]) for r in rows), np.zeros(0), np.zeros((width, 0)), 0.0)

    def products(batches):
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            y = centre.centred(_whole(batch.column(0), width))
            total += y.T @ y
            seen = True
        if seen:
            yield from _cells(total)

    covariance = _sum_cells(vectors.select(col).mapInArrow(products, CELLS), (width, width)) / n
    trace = float(np.trace(covariance))
    values, components = leading_pairs(covariance, k)
    real = values > max(values[0], 0.0) * EPS * width
    return dataclasses.replace(centre, values=values[real], components=components[:, real], trace=trace)


CELLS = "i int, j int, v double"


def _cells(matrix: np.ndarray):
    i, j = np.nonzero(matrix)
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(matrix[i, j])],
                                         ["i", "j", "v"])


def _sum_cells(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' matrices: added up by Spark, at most one row per cell comes to the driver."""
    out = np.zeros(shape)
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[i, j] = v
    return out


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Greatest absolute entry of the covariance of ``whitened`` (arrays of ``k``) minus the identity. Each task
    centres on its own mean before multiplying; row ``k`` of its matrix carries the sums that join the tasks."""
    def products(batches):
        count, mean, total = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            if len(w) == 0:
                continue
            m, c = w.mean(0), len(w)
            step = m - mean
            total += (w - m).T @ (w - m) + np.outer(step, step) * (count * c / (count + c))
            mean, count = mean + step * (c / (count + c)), count + c
        if count:
            yield from _cells(np.vstack([total + count * np.outer(mean, mean), count * mean]))

    cells = _sum_cells(projected.select("whitened").mapInArrow(products, CELLS), (k + 1, k))
    mean = cells[k] / n
    return float(np.abs(cells[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def project(vectors: DataFrame, col: str, width: int, model: Whitening) -> DataFrame:
    """``vectors`` with ``deviation`` decimal(38,0) (null beyond 38 digits) and ``whitened`` array<double> in place
    of ``col``; the model (width x components doubles) is broadcast."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in vectors.schema.fields if f.name != col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "deviation string", "whitened array<double>"])

    def run(batches):
        model = sent.value
        scaled, k = model.components / np.sqrt(model.values), len(model.values)
        for batch in batches:
            x = _whole(batch.column(batch.schema.get_field_index(col)), width)
            whitened = model.centred(x) @ scaled
            ends = pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in keep),
                 pa.array([str(v) for v in model.deviations(x)], pa.string()),
                 pa.ListArray.from_arrays(ends, pa.array(whitened.ravel()))],
                [*(f.name for f in keep), "deviation", "whitened"])

    return vectors.mapInArrow(run, schema).withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def whiten(embeddings: DataFrame, k: int = 8, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, hold a null, non-finite or too large entry, or have another than the commonest number of
    entries are dropped. Null and repeated ids and repeated vectors are rows like all others. No usable vector, or
    vectors that are all equal (no variance): an empty result. Other columns of the table are not read.
    """
    width = common_width(embeddings, col)
    out = f"`{id_col}` {embeddings.schema[id_col].dataType.simpleString()}, component int, n long, " \
          "deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = embeddings.select(F.col(id_col), F.col(col).cast("array<double>").alias(col)).where(usable(col, width))
    model = fit(vectors, col, width, k) if width else None
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], out)
    projected = project(vectors, col, width, model)
    error = identity_error(projected, model.n, len(model.values))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return (projected.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
