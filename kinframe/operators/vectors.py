"""Exact search and clustering of dense vectors without pairs of rows.

A bounded sample of vectors serves as pivots; every vector belongs to the cell of its nearest pivot. The triangle
inequality on distances to pivots tells which cells can hold anything within a given distance, so only those are met.
Cells are dealt to blocks of bounded size (a large one is cut by a hash, small ones that lie close share a block), which
are stored once. Blocks meet blocks in the tasks of a Cartesian product, which read them where they are stored: no vector
is exchanged or copied for the cells that it meets. numpy compares them as matrices, a task keeps only the state of its
own block, and what leaves it is linear in that block.

* ``nearest``: the k nearest by cosine. The vectors of its own block give each query a k-th similarity; then it meets all
  cells whose least possible angle does not rule them out, which proves the answer.
* ``density_clusters``: DBSCAN. A vector meets the cells that can hold a neighbour; once it has enough it meets no more.
  Core vectors are joined inside their block first, so that blocks exchange links between such groups.
* ``silhouette``: the squared-Euclidean form from moments of the clusters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.common import wide
from kinframe.operators.components import components
from kinframe.operators.topk import top_k_per_group
from kinframe.session import ensure_checkpoint_dir, ship_package

#: Most pivots, sampled vectors per pivot, vectors of a block aimed at, of them compared at once, doubles of broadcast centroids.
PIVOTS, SAMPLE, BLOCK, QUERIES, CENTROIDS = 1024, 8, 4096, 256, 1 << 20
#: Tasks aimed at when there are few blocks.
TASKS = 32
#: Slack of bounds: similarities are compared at 6 decimals, angles of doubles are good to 1e-8.
SLACK = 1e-6
#: Most numbers of a matrix, and of the vectors of a block: it bounds a task's memory.
MATRIX = 1 << 20


def usable(vectors: DataFrame, id_col: str, col: str, *more: Column) -> tuple[DataFrame, int]:
    """``id long, x array<double>`` (and ``more`` columns) of the distinct rows whose vector is finite and has the
    commonest width (of two equally common ones the greater), and that width (0 without vectors). Other rows, and null
    ids, are left out."""
    x = F.col(col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), *more).where("id IS NOT NULL AND size(x) > 0")
    top = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    width = top["w"] if top else 0
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.where((F.size("x") == width) & finite).dropDuplicates(), width


def unit(x: str = "x") -> Column:
    """The vector scaled to length 1."""
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    return F.transform(x, lambda c: c / length)


def _matrix(column, width: int) -> np.ndarray:
    values = column.values if isinstance(column, pa.Scalar) else column
    while not pa.types.is_floating(values.type):
        values = values.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def choose_pivots(points: DataFrame, width: int, measure: Callable) -> np.ndarray:
    """About sqrt(n) and at most ``PIVOTS`` vectors that lay out the cells: of a bounded sample (``SAMPLE`` times as
    many, by a hash) each next one is the farthest from those before, so that separate groups get cells of their own."""
    n = points.count()
    wanted = int(min(PIVOTS, max(1, np.ceil(np.sqrt(n)))))
    sample = points.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(wanted * SAMPLE).collect()
    x = np.array([r["x"] for r in sample]).reshape(-1, width)
    chosen, away = [0], measure(x, x[:1])[:, 0]
    while len(chosen) < min(wanted, len(x)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, measure(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _placed(points: DataFrame, pivots: np.ndarray, measure: Callable) -> DataFrame:
    """``points`` with ``cell`` and ``away`` (distance to its pivot)."""
    sent, width = points.sparkSession.sparkContext.broadcast(pivots), pivots.shape[1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.schema.get_field_index("x")), width)
            step = max(1, MATRIX // len(sent.value))
            for at in range(0, len(x), step):
                away = measure(x[at:at + step], sent.value)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, step).columns, pa.array(away.argmin(1).astype(np.int32)), pa.array(away.min(1))],
                    [*batch.schema.names, "cell", "away"])

    ship_package(points.sparkSession)
    return points.mapInArrow(run, f"{fields}, cell int, away double")


def _cells(placed: DataFrame) -> dict[int, tuple[float, float, int]]:
    """Least and greatest ``away`` and rows of every cell: a row per pivot at most."""
    rows = placed.groupBy("cell").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    return {r["cell"]: (r["lo"], r["hi"], r["n"]) for r in rows}


def _blocks(placed: DataFrame, cells: dict, pivots: np.ndarray, measure: Callable, columns: list[str]) -> tuple[DataFrame, int]:
    """``block``, its distinct ``cells``, and ``cell`` and the columns as lists in the order of cells; and the number of blocks.

    A cell of more than a block is cut into several by a hash; smaller ones share a block with the nearest one left."""
    size = max(1, min(BLOCK, MATRIX // pivots.shape[1]))
    first, parts, left = [0] * len(pivots), [1] * len(pivots), np.isin(np.arange(len(pivots)), list(cells))
    n, room, at = 0, 0, min(cells, default=0)
    while left.any():
        rows, left[at] = cells[at][2], False
        if rows > size:
            first[at], parts[at], room = n, -(-rows // size), 0
            n += parts[at]
        else:
            if rows > room:
                n, room = n + 1, size
            first[at], room = n - 1, room - rows
        at = int(np.where(left, measure(pivots[at:at + 1], pivots)[0], np.inf).argmin())
    of = lambda l: F.get(F.array(*[F.lit(v) for v in l]), F.col("cell"))
    block = of(first) + F.pmod(F.xxhash64("id", "x"), of(parts)).cast("int")
    return placed.withColumn("block", block).repartition(max(n, 1), "block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("cell", *columns))).alias("rows")).select(
        "block", F.array_distinct("rows.cell").alias("cells"), *[F.col(f"rows.{c}").alias(c) for c in ["cell", *columns]]), max(n, 1)


def _list(batch, name: str, r: int, width: int = 0) -> np.ndarray:
    """The list in a row of a batch as an array; with ``width`` as a matrix."""
    value = batch.column(batch.schema.get_field_index(name))[r]
    return _matrix(value, width) if width else value.values.to_numpy(zero_copy_only=False)


def _with(batch, r: int, **more) -> pa.RecordBatch:
    """A row of a batch with further columns."""
    return pa.RecordBatch.from_arrays([*batch.slice(r, 1).columns, *[pa.array([v]) for v in more.values()]], [*batch.schema.names, *more])


def _meet(blocks: DataFrame, n: int, own: list[str], met: list[str], run: Callable, schema: str, once: bool = False) -> DataFrame:
    """``run`` over the pairs of a block (columns ``own``, ``reach`` the cells it has to meet) and one that holds such a cell
    (columns ``met``, with ``m_`` before their names); with ``once`` only blocks from its own number on.

    Every task reads a few blocks and streams the others, so all pairs of a block are in as few tasks as there is work for."""
    others = blocks.select(F.col("block").alias("m_block"), "cells", *[F.col(c).alias(f"m_{c}") for c in met]).coalesce(max(1, TASKS // n))
    on = F.arrays_overlap("reach", "cells")
    pairs = others.join(blocks.select("block", "reach", *own).hint("shuffle_replicate_nl"), on & (F.col("m_block") >= F.col("block")) if once else on)
    return pairs.drop("reach", "cells").mapInArrow(run, schema)


def _runs(cell: np.ndarray, mask: np.ndarray):
    """A block's rows by cell, in pieces: first row, end, and the rows of the other block that meet them. ``mask`` has a
    column per pivot."""
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    if mask[:, cell[starts]].all():
        starts = starts[:1]
    for start, end in zip(starts, [*starts[1:], len(cell)]):
        rows = np.flatnonzero(mask[:, cell[start]])
        for at in range(0, len(rows), QUERIES):
            yield start, end, rows[at:at + QUERIES]


class _Best:
    """The ``k`` most similar other ids of the rows of a block (ids ``own``), equal ones by id, as rows are added. An id that
    is found by several vectors counts once, with its best. ``kth``: similarities known to be reached."""

    def __init__(self, own: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.own, self.k = own, k
        self.kth = np.full(len(own), -2.0) if kth is None else kth.copy()
        self.kid = np.full(len(own), np.iinfo(np.int64).max)
        self.row, self.id, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.more, self.held = [], 0

    def add(self, rows: np.ndarray, s: np.ndarray, ids: np.ndarray, copies: int) -> None:
        """The similarities of rows to ids, of which one occurs ``copies`` times at most. ``s`` is not kept."""
        near = s >= self.kth[rows, None] - SLACK
        most = (self.k + 1) * copies  # of those at the top, the row's own id takes no more than ``copies``
        if np.count_nonzero(near) > 2 * most * len(rows) and most < len(ids):
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))[::-1]  # among equal ones the least id is first
            key = np.rint(s * 1e6).astype(np.int64) * len(ids) + rank
            near &= key >= np.partition(key, len(ids) - most, axis=1)[:, len(ids) - most, None]
        r, c = np.divmod(np.flatnonzero(near), len(ids))
        row, found, value = rows[r], ids[c], np.round(s[r, c], 6)
        kth = self.kth[row]
        keep = (self.own[row] != found) & ((value > kth) | ((value == kth) & (found <= self.kid[row])))
        self.more.append((row[keep], found[keep], value[keep]))
        self.held += len(self.more[-1][0])
        if self.held > MATRIX // 16:
            self.settle()

    def settle(self) -> None:
        row, found, s = (np.concatenate(c) for c in zip((self.row, self.id, self.s), *self.more))
        self.more, self.held = [], 0
        order = np.lexsort((-s, found, row))
        row, found, s = row[order], found[order], s[order]
        best = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(found, prepend=0) != 0))
        row, found, s = row[best], found[best], s[best]
        order = np.lexsort((found, -s, row))
        row, found, s = row[order], found[order], s[order]
        at = np.arange(len(row)) - np.searchsorted(row, row)
        self.row, self.id, self.s = (c[at < self.k] for c in (row, found, s))
        last = at == self.k - 1
        self.kth[row[last]], self.kid[row[last]] = s[last], found[last]


def nearest(vectors: DataFrame, k: int, asks: Column, id_col: str = "vec_id", col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``(id, neighbour, similarity, rank)`` for every row that meets ``asks`` (a condition on ``id``): its ``k`` most
    similar other ids by cosine at 6 decimals, equal ones by id; and ``(id, met)``, the rows it was compared with.

    Fewer rows where the table has fewer other ids. Vectors without direction (zero) or not usable are neither asked
    for nor found; an id with several vectors asks with and is found by each of them.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    points, width = usable(vectors, id_col, col)
    points = points.where(F.exists("x", lambda c: c != 0)).select("id", unit().alias("x")).checkpoint()
    if not width or points.isEmpty():
        return (spark.createDataFrame([], "id long, neighbour long, similarity double, rank int"),
                spark.createDataFrame([], "id long, met long"))
    pivots = choose_pivots(points, width, _angles)
    placed = _placed(points.withColumn("ask", F.coalesce(asks, F.lit(False))), pivots, _angles).checkpoint()
    cells = _cells(placed)
    full = [cells.get(c, (0.0, 0.0, 0)) for c in range(len(pivots))]
    sent = spark.sparkContext.broadcast((pivots, *[np.array(v) for v in zip(*full)]))

    def reached(x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The cells (a column per pivot) that the k-th similarity does not rule out."""
        pivots, lo, hi, size = sent.value
        out = np.zeros((len(x), len(pivots)), bool)
        step = max(1, MATRIX // len(pivots))
        for at in range(0, len(x), step):
            angle = _angles(x[at:at + step], pivots)
            bound = np.maximum(np.maximum(angle - hi, lo - angle), 0)
            out[at:at + step] = (np.cos(np.maximum(bound - SLACK, 0)) >= kth[at:at + step, None] - SLACK) & (size > 0)
        return out

    def copies(ids: np.ndarray) -> int:
        return int(np.unique(ids, return_counts=True)[1].max())

    def look(batches):
        """Blocks with a first k-th similarity of each row that asks, from its cell in the block or else the whole block."""
        size = sent.value[3]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, x, cell = _list(batch, "id", r), _list(batch, "x", r, width), _list(batch, "cell", r)
                ask = np.flatnonzero(_list(batch, "ask", r))
                best, times = _Best(ids[ask], k), copies(ids)
                seen = np.zeros((len(ask), len(size)), bool)
                seen[np.arange(len(ask)), cell[ask]] = True
                for every in (False, True):
                    if every:
                        seen[best.kth < -1] = np.isin(np.arange(len(size)), cell)
                    for start, end, rows in _runs(cell, seen & (best.kth < -1)[:, None]):
                        best.add(rows, x[ask[rows]] @ x[start:end].T, ids[start:end], times)
                    best.settle()
                open_cells = reached(x[ask], best.kth)
                yield _with(batch, r, kth=best.kth, met=(open_cells | seen) @ size, reach=np.flatnonzero(open_cells.any(0)).astype(np.int32))

    def compare(batches):
        mine = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column(batch.schema.get_field_index("block"))[r].as_py()
                if block not in mine:
                    ask, kth = np.flatnonzero(_list(batch, "ask", r)), _list(batch, "kth", r)
                    x = _list(batch, "x", r, width)[ask]
                    mine[block] = x, _Best(_list(batch, "id", r)[ask], k, kth), reached(x, kth)
                x, best, mask = mine[block]
                ids, other = _list(batch, "m_id", r), _list(batch, "m_x", r, width)
                times = copies(ids)
                for start, end, rows in _runs(_list(batch, "m_cell", r), mask):
                    best.add(rows, x[rows] @ other[start:end].T, ids[start:end], times)
        for _, best, _ in mine.values():
            best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(best.own[best.row]), pa.array(best.id), pa.array(best.s)], ["id", "neighbour", "similarity"])

    blocks, n = _blocks(placed, cells, pivots, _angles, ["id", "x", "ask"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields)
    blocks = blocks.mapInArrow(look, f"{fields}, kth array<double>, met array<long>, reach array<int>").checkpoint()
    found = _meet(blocks, n, ["id", "x", "ask", "kth"], ["cell", "id", "x"], compare, "id long, neighbour long, similarity double")
    # an id found in several tasks or by several vectors counts once, with its best
    best = top_k_per_group(found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity")), ["id"],
                           [F.desc("similarity"), F.asc("neighbour")], k, ["neighbour"])
    asked = blocks.select(F.explode(F.arrays_zip(F.filter("id", lambda _, i: F.get("ask", i)).alias("id"), "met")).alias("e"))
    met = asked.groupBy("e.id").agg(F.sum("e.met").alias("met"))
    return best.select("id", "neighbour", "similarity", "rank"), met


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are no more than ``eps`` apart. Where the product is too coarse, differences decide."""
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    close = a @ b.T
    close -= b2 / 2
    close -= a2[:, None] / 2  # minus half the squared distance
    edge, blur = -eps * eps / 2, 1e-12 * (a2.max(initial=0) + b2.max(initial=0) + eps * eps)
    out = close >= edge - blur
    row, col = np.divmod(np.flatnonzero(out & (close <= edge + blur)), max(len(b), 1))
    step = max(1, MATRIX // a.shape[1])
    for at in range(0, len(row), step):
        r, c = row[at:at + step], col[at:at + step]
        out[r, c] = np.sqrt(((a[r] - b[c]) ** 2).sum(1)) <= eps
    return out


def _forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label of the local component for the rows (labels ``a``) and columns (labels ``b``) of a neighbour matrix.
    Every row and column is followed once."""
    row, col = a.copy(), b.copy()
    left, turned = near.any(1), np.ascontiguousarray(near.T)
    fresh = near.any(0)
    while left.any():
        rows = np.array([left.argmax()])
        left[rows] = False
        in_row, in_col = [rows], []
        while len(rows):
            cols = np.flatnonzero(near[rows].any(0) & fresh)
            fresh[cols] = False
            rows = np.flatnonzero(turned[cols].any(0) & left)
            left[rows] = False
            in_row.append(rows), in_col.append(cols)
        r, c = np.concatenate(in_row), np.concatenate(in_col)
        row[r] = col[c] = min(a[r].min(), b[c].min())
    return row, col


def density_clusters(vectors: DataFrame, eps: float, min_rows: int, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """``(id, cluster, core)``: DBSCAN by Euclidean distance. An id is core if at least ``min_rows`` ids, itself
    included, lie within ``eps``; clusters are the components of core ids within ``eps`` of each other, named by their
    least core id; another id within ``eps`` of a core one joins the least such cluster; the rest is noise (-1).

    Rows that are not usable are left out. Equal vectors are one point with the number of their ids, so copies make no
    pairs. An id with several vectors is a point for each of them and has a row for each.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows, width = usable(vectors, id_col, col)
    rows = rows.withColumn("key", F.xxhash64("x")).checkpoint()
    out = "id long, cluster long, core boolean"
    if not width or rows.isEmpty():
        return spark.createDataFrame([], out)
    points = rows.groupBy("key", "x").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    points = points.withColumn("id", F.monotonically_increasing_id()).checkpoint()  # a point's own number, kept from here on
    pivots = choose_pivots(points, width, _distances)
    placed = _placed(points.select("id", "x", "n", "least"), pivots, _distances).checkpoint()
    sent = spark.sparkContext.broadcast(pivots)

    def stored_blocks(placed: DataFrame, columns: list[str], more: Callable, schema: str) -> tuple[DataFrame, int]:
        """The blocks with the cells that they have to meet, and what ``more`` gives for a block."""
        cells = _cells(placed)
        full = [cells.get(c, (0.0, 0.0, 0)) for c in range(len(pivots))]
        known = spark.sparkContext.broadcast([np.array(v) for v in zip(*full)])

        def reached(x: np.ndarray) -> np.ndarray:
            """The cells (a column per pivot) that can hold something within ``eps``."""
            lo, hi, size = known.value
            out, step = np.zeros((len(x), len(size)), bool), max(1, MATRIX // len(size))
            for at in range(0, len(x), step):
                away = _distances(x[at:at + step], sent.value)
                far = eps + SLACK * np.maximum(1, away)
                out[at:at + step] = (away <= away.min(1)[:, None] + eps + far) & (away <= hi + far) & (away >= lo - far) & (size > 0)
            return out

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    reach = np.flatnonzero(reached(_list(batch, "x", r, width)).any(0)).astype(np.int32)
                    yield _with(batch, r, reach=reach, **more(batch, r))

        blocks, n = _blocks(placed, cells, pivots, _distances, columns)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields)
        return blocks.mapInArrow(run, f"{fields}, reach array<int>{schema}").checkpoint(), n, reached

    ship_package(spark)
    blocks, n, reached = stored_blocks(placed, ["id", "x", "n"], lambda batch, r: {}, "")

    def count(batches):
        mine = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column(batch.schema.get_field_index("block"))[r].as_py()
                if block not in mine:
                    x = _list(batch, "x", r, width)
                    mine[block] = _list(batch, "id", r), x, np.zeros(len(x), np.int64), reached(x)
                _, x, found, mask = mine[block]
                times, other = _list(batch, "m_n", r), _list(batch, "m_x", r, width)
                for start, end, rows in _runs(_list(batch, "m_cell", r), mask):
                    hit, col = np.divmod(np.flatnonzero(_within(x[rows], other[start:end], eps)), end - start)
                    found[rows] += np.bincount(hit, times[start:end][col], len(rows)).astype(np.int64)
                mask[found >= min_rows] = False  # enough
        for ids, _, found, _ in mine.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], ["id", "found"])

    flags = _meet(blocks, n, ["id", "x"], ["cell", "n", "x"], count, "id long, found long").groupBy("id").agg(F.sum("found").alias("found")).select(
        F.col("id").alias("fid"), "found", (F.col("found") >= min_rows).alias("core")).checkpoint()

    def local(batch, r: int) -> dict:
        """Labels of core rows: the least number of a core row that is joined to it inside the block."""
        ids, x, core = _list(batch, "id", r), _list(batch, "x", r, width), np.flatnonzero(_list(batch, "core", r))
        near = np.zeros((len(core), len(core)), bool)
        for at in range(0, len(core), QUERIES):
            near[at:at + QUERIES] = _within(x[core[at:at + QUERIES]], x[core], eps)
        label = ids.copy()
        label[core] = _forest(near, ids[core], ids[core])[0]
        return {"label": label}

    # rows without any neighbour are noise and meet nobody again
    kept = placed.join(wide(flags), F.col("id") == F.col("fid")).where("core OR found > n").select("id", "x", "least", "core", "cell", "away")
    labelled, n, touched = stored_blocks(kept.checkpoint(), ["id", "x", "least", "core"], local, ", label array<long>")

    def link(batches):
        mine = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column(batch.schema.get_field_index("block"))[r].as_py()
                if block not in mine:
                    x = _list(batch, "x", r, width)
                    mine[block] = _list(batch, "label", r), x, _list(batch, "core", r), touched(x)
                a, x, core_a, mask = mine[block]
                b, other, core_b = _list(batch, "m_label", r), _list(batch, "m_x", r, width), _list(batch, "m_core", r)
                near = np.zeros((len(a), len(b)), bool)
                for start, end, rows in _runs(_list(batch, "m_cell", r), mask):
                    near[rows, start:end] = _within(x[rows], other[start:end], eps)
                to_a, to_b = _forest(near[core_a][:, core_b], a[core_a], b[core_b])
                joined = np.concatenate([np.stack([a[core_a], to_a], 1), np.stack([b[core_b], to_b], 1)])
                row, at = np.nonzero(near & ~core_a[:, None] & core_b)
                col, to = np.nonzero(near.T & ~core_b[:, None] & core_a)
                border = np.concatenate([np.stack([a[row], b[at]], 1), np.stack([b[col], a[to]], 1)])
                for pairs, core in ((joined[joined[:, 0] != joined[:, 1]], True), (border, False)):  # a label of a border row is its number
                    pairs = np.unique(pairs, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), core))], ["u", "v", "core"])

    links = _meet(labelled, n, ["label", "x", "core"], ["cell", "label", "x", "core"], link, "u long, v long, core boolean", once=True).checkpoint()
    roots = components(links.where("core").select("u", "v"))
    # a label has no more rows than a block, a cluster may have any number: clusters meet labels, labels meet rows
    cores = labelled.select(F.explode(F.arrays_zip("id", "least", "core", "label")).alias("e")).select("e.*").where("core")
    labels = cores.groupBy("label").agg(F.min("least").alias("least")).join(wide(roots), F.col("label") == F.col("node"), "left").select(
        "label", "least", F.coalesce("root", "label").alias("root")).checkpoint()
    names = labels.groupBy("root").agg(F.min("least").alias("cluster"))
    labels = labels.join(wide(names), "root").select("label", "cluster").checkpoint()
    named = cores.select("id", "label").join(wide(labels), "label")
    border = links.where("NOT core").join(wide(labels), F.col("v") == F.col("label")).groupBy(F.col("u").alias("node")).agg(
        F.min("cluster").alias("cluster"))
    known = points.select("id", "key", "x").join(wide(flags), F.col("id") == F.col("fid")).join(
        wide(named.select(F.col("id").alias("node"), "cluster").unionByName(border)), F.col("id") == F.col("node"), "left").select(
        F.col("key").alias("pkey"), F.col("x").alias("px"), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"), "core")
    return rows.join(wide(known), (F.col("key") == F.col("pkey")) & (F.col("x") == F.col("px"))).select("id", "cluster", "core")


def silhouette(vectors: DataFrame, id_col: str, cluster_col: str, col: str, noise: int | None = -1) -> DataFrame:
    """One row: ``items, clusters, silhouette``: the mean over all items of (b - a) / max(a, b) with a the mean squared
    Euclidean distance to the other items of its cluster and b the least such mean to another cluster.

    The mean squared distance to a cluster follows from its size, vector sum and sum of squared lengths, so an item
    meets clusters, never items. Items alone in their cluster count as 0; noise, null clusters and rows that are not
    usable are left out, repeated rows count once; with fewer than two clusters the value is null. (The Euclidean form needs all distances and is
    not computed.)
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    kept = vectors.where(F.col(cluster_col).isNotNull() & (F.lit(noise).isNull() | (F.col(cluster_col) != F.lit(noise))))
    rows, width = usable(kept, id_col, col, F.col(cluster_col).cast("long").alias("c"))
    rows = rows.select("c", "x").checkpoint()
    mean = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("m")).orderBy("d").collect()
    origin = F.array(*[F.lit(float(r["m"])) for r in mean]) if mean else F.array().cast("array<double>")
    rows = rows.withColumn("x", F.zip_with("x", origin, lambda a, b: a - b))  # about the mean, to keep digits
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e)
    sums = rows.select("c", F.posexplode("x").alias("d", "v")).groupBy("c", "d").agg(F.avg("v").alias("m"))
    sums = sums.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("l")).select("c", F.col("l.m").alias("m"))
    moments = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg(square("x")).alias("q")).join(sums, "c").checkpoint()
    n_clusters = moments.count()
    total = rows.count()
    if n_clusters < 2:
        return spark.range(1).select(F.lit(total).cast("long").alias("items"), F.lit(n_clusters).cast("long").alias("clusters"),
                                     F.lit(None).cast("double").alias("silhouette"))
    per = max(1, CENTROIDS // max(width, 1))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    found = None
    for part in range(-(-n_clusters // per)):  # clusters in blocks whose centroids are a bounded broadcast
        n_parts = -(-n_clusters // per)
        block = moments.where(F.pmod(F.xxhash64("c"), F.lit(n_parts)) == part).collect()
        if not block:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["c"] for r in block]), np.array([r["n"] for r in block], float),
                                             np.array([r["q"] for r in block]), np.array([r["m"] for r in block])))

        def run(batches, sent=sent):
            cluster, n, q, m = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, c = _matrix(batch.column(2), width), batch.column(1).to_numpy()
                for at in range(0, len(x), 1024):
                    y = x[at:at + 1024]
                    away = np.maximum((y * y).sum(1)[:, None] - 2 * (y @ m.T) + q, 0)
                    own = c[at:at + 1024, None] == cluster
                    alone = own & (n == 1)
                    a = np.where(own & ~alone, away * n / np.maximum(n - 1, 1), 0).sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, 1024), pa.array(np.where(own.any(1), a, np.nan)), pa.array(alone.any(1)),
                         pa.array(np.where(own, np.inf, away).min(1))], ["row", "a", "alone", "b"])

        ship_package(spark)
        each = rows.select("row", "c", "x").mapInArrow(run, "row long, a double, alone boolean, b double")
        found = each if found is None else found.unionByName(each)
    if n_clusters > per:
        found = found.groupBy("row").agg(F.max(F.nanvl("a", F.lit(0.0))).alias("a"), F.max("alone").alias("alone"), F.min("b").alias("b"))
    top = F.greatest("a", "b")
    value = F.when(F.col("alone") | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return found.agg(F.count(F.lit(1)).alias("items"), F.lit(n_clusters).cast("long").alias("clusters"), F.avg(value).alias("silhouette"))
