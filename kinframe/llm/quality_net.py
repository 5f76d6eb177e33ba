"""Quality scores: random-indexing word vectors, pooled per document, under a small calibrated network.

1. *Random indexing.* Every token has a fixed sparse index vector (a few entries of +1 or -1). A token's context
   vector is the sum of the index vectors met within two tokens of it, over all documents. Tokens fall into a fixed
   number of slots by a hash, so a task adds up one table of bounded size, Spark adds the tables of all tasks,
   and the finished word vectors (``SLOTS x WIDTH`` floats, 8 MB) can be broadcast whatever the corpus.
2. *Pooling.* A document becomes the mean and the spread of its tokens' vectors, and the mean steps from a token's
   vector to those of the next token and the one after it.
3. *Network.* Two numpy layers (tanh, then a logit), fitted to a bounded sample of labelled documents; a part of it
   is kept back to stop the fit and to choose the temperature that divides the logit.
"""

from __future__ import annotations

import dataclasses
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of tokens, width of the vectors, entries of an index vector, tokens to each side.
SLOT_BITS, WIDTH, ENTRIES, SIDE = 16, 32, 4, 2
SLOTS = 1 << SLOT_BITS
#: Contexts after which half of a token's vector is taken from them.
TRUST = 10
#: Bytes split at once, tokens handled at once.
PIECE, TOKENS = 1 << 20, 1 << 18
#: At most so many labelled documents are fitted to.
SAMPLE = 20000
HIDDEN, EPOCHS, BATCH, PATIENCE, RATE, DECAY = 32, 200, 128, 20, 0.004, 1e-3
#: Fixed value: the score from which a document is predicted to be of good quality.
GOOD = 0.7
FEATURES = 4 * WIDTH

#: Fixed classes of bytes: 0 separates, runs of one of 1 to 4 are tokens, every 5 is a token.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(0x21), 0x7F]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A], _CLASS[0x5F], _CLASS[0x0A] = 2, 4, 5
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for one piece."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(PIECE + 1, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS


def pieces(column: pa.Array):
    """The tokens of a column of texts, piece by piece: their slots, and the row of each. Tokens are runs of letters
    (all bytes beyond ASCII are letters), of digits, of underscores or of other signs, and line ends; the slot comes from
    a polynomial hash of the bytes. A text longer than a piece is cut where a separator stands."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at, last = int(offsets[0]), int(offsets[-1])
    power, inverse = _powers()
    while at < last:
        stop = min(at + PIECE, last)
        if stop < last:
            start_of_row = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            gaps = np.flatnonzero(_CLASS[data[at:stop]] == 0) if start_of_row <= at else ()
            stop = start_of_row if start_of_row > at else at + int(gaps[-1]) + 1 if len(gaps) else stop
        text = data[at:stop]
        kind = _CLASS[text]
        change = np.ones(len(text), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 5)
        rows = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, stop)]
        change[rows - at] = True
        begin = np.flatnonzero(change)
        end = np.append(begin[1:], len(text))
        keep = kind[begin] != 0
        begin, end = begin[keep], end[keep]
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:len(text)], out=sums[1:])
        hashes = (sums[end] - sums[begin]) * inverse[begin] * np.uint64(_MIX)
        yield (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int32), np.searchsorted(offsets, begin + at, "right") - 1
        at = stop


def slots_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all tokens of a column, and where each row's begin (and the last's end)."""
    found = list(pieces(column))
    slots = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int32)
    rows = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return slots, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(column)))])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (slots x entries) of the fixed sparse vectors."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((SLOTS, WIDTH), np.float32), axis=1)[:, :ENTRIES].astype(np.int64)
    return places, rng.choice(np.array([-1, 1], np.int8), (SLOTS, ENTRIES))


class Contexts:
    """Sums of context vectors and counts of contexts per slot."""

    def __init__(self):
        self.places, signs = index_vectors()
        self.signs = signs.astype(np.int32)
        self.sums, self.counts = np.zeros(SLOTS * WIDTH, np.int64), np.zeros(SLOTS, np.int64)
        self.recent, self.n_recent = np.zeros(SLOTS * WIDTH, np.int32), 0  # half the size, so more of it stays in cache
        self.texts, self.tail = 0, (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def settle(self) -> None:
        """Move the recent sums over before they could exceed their type."""
        self.sums += self.recent
        self.recent[:], self.n_recent = 0, 0

    def add(self, column: pa.Array) -> None:
        for slots, rows in pieces(column):
            for at in range(0, len(slots), TOKENS):
                self._count(slots[at:at + TOKENS], rows[at:at + TOKENS] + self.texts)
        self.texts += len(column)

    def _count(self, slots: np.ndarray, texts: np.ndarray) -> None:
        """Contexts of the tokens with those before them; the last ones before this call are the tail."""
        first = len(self.tail[0])
        slots, texts = np.append(self.tail[0], slots), np.append(self.tail[1], texts)
        for step in range(1, SIDE + 1):
            pair = np.flatnonzero(texts[step:] == texts[:-step])
            pair = pair[pair + step >= first]  # two tokens of the tail have met
            a, b = slots[pair], slots[pair + step]
            for centre, near in ((a, b), (b, a)):
                start = centre * np.int64(WIDTH)
                for e in range(ENTRIES):
                    np.add.at(self.recent, start + self.places[near, e], self.signs[near, e])
                self.counts += np.bincount(centre, minlength=SLOTS)
        self.tail = slots[-SIDE:], texts[-SIDE:]
        self.n_recent += len(slots)
        if self.n_recent > 1 << 28:
            self.settle()


def word_vectors(docs: DataFrame, col: str = "text") -> np.ndarray:
    """Vector per slot (float32) from the contexts of all texts: the mean context less that of all tokens, trusted
    more the more contexts there are, plus the token's own index vector."""
    rows = 256  # slots of a row: a task hands on SLOTS / 256 rows at most

    def count(batches):
        found = Contexts()
        for batch in batches:
            found.add(batch.column(0))
        found.settle()
        table = np.concatenate([found.sums.reshape(SLOTS, WIDTH), found.counts[:, None]], 1)
        blocks = [b for b in range(SLOTS // rows) if found.counts[b * rows:(b + 1) * rows].any()]
        if blocks:
            yield _packed(blocks, [table[b * rows:(b + 1) * rows] for b in blocks])

    def add_up(batches):
        at, total = None, None
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != at and at is not None:
                    yield _packed([at], [total])
                part = _unpacked(cells.as_py())
                total, at = part if block != at else total + part, block
        if at is not None:
            yield _packed([at], [total])

    schema = "block int, cells binary"
    parts = docs.select(F.col(col).cast("string")).mapInArrow(count, schema)
    whole = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add_up, schema).collect()  # SLOTS / 256 rows
    table = np.zeros((SLOTS, WIDTH + 1))
    for block, cells in whole:
        table[block * rows:(block + 1) * rows] = _unpacked(cells).reshape(rows, WIDTH + 1)
    return finished(table[:, :WIDTH], table[:, WIDTH])


def finished(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = np.maximum(counts, 1)[:, None]
    vectors = sums / n - sums.sum(0) / max(counts.sum(), 1)
    vectors *= np.where(counts > 0, counts / (counts + TRUST), 0.0)[:, None]
    weight = counts / max(counts.sum(), 1)
    vectors /= np.sqrt((weight[:, None] * vectors ** 2).sum(0).mean()) or 1.0
    places, signs = index_vectors()
    np.add.at(vectors, (np.arange(SLOTS)[:, None], places), signs * 1.0)
    return vectors.astype(np.float32)


def _packed(blocks: list, tables: list) -> pa.RecordBatch:
    cells = [zlib.compress(np.ascontiguousarray(t, np.int64).tobytes(), 1) for t in tables]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], ["block", "cells"])


def _unpacked(cells: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(cells), np.int64)


def pooled(slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and mean steps to the next two of a document's token vectors; zeros without tokens."""
    n, total, square, steps = len(slots), np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, WIDTH))
    if not n:
        return np.zeros(FEATURES)
    for at in range(0, n, 2048):  # floats in short runs, doubles across them
        x = vectors[slots[at:at + 2048 + 2]]
        for k in (1, 2):
            gap = x[k:2048 + k] - x[:min(len(x) - k, 2048)]
            steps[k - 1] += np.abs(gap, out=gap).sum(0)
    kinds, times = np.unique(slots, return_counts=True)
    for at in range(0, len(kinds), 2048):
        total += times[at:at + 2048].astype(np.float32) @ vectors[kinds[at:at + 2048]]
    mean = total / n
    for at in range(0, len(kinds), 2048):
        x = vectors[kinds[at:at + 2048]] - mean.astype(np.float32)
        square += times[at:at + 2048].astype(np.float32) @ np.square(x, out=x)
    return np.concatenate([mean, np.sqrt(square / n), steps[0] / max(n - 1, 1), steps[1] / max(n - 2, 1)])


@dataclasses.dataclass(frozen=True)
class Network:
    """Standardisation, two layers and the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Network:
    """Fit to the rows that are not ``check``, stop at the least loss on those that are, then choose the temperature
    on them. Without examples of both labels every score is the share of label 1 (0.5 without any example)."""
    share = (y.sum() + 1) / (len(y) + 2)
    constant = Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1),
                       float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return constant
    if not 0 < check.sum() < len(y):
        check = np.arange(len(y)) % 4 == 3
        check = check if check.any() else np.ones(len(y), bool)
    fit = ~check if (~check).any() else check
    shift, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    rng, xs = np.random.default_rng(17), (x - shift) / scale
    net = [rng.standard_normal((FEATURES, HIDDEN)) / np.sqrt(FEATURES), np.zeros(HIDDEN),
           rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    best, least, since, t = [p.copy() for p in net], np.inf, 0, 0
    rows = np.flatnonzero(fit)
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            part = rows[at:at + BATCH]
            h = np.tanh(xs[part] @ net[0] + net[1])
            off = (_sigmoid(h @ net[2] + net[3]) - y[part]) / len(part)
            back = np.outer(off, net[2]) * (1 - h * h)
            steps = [xs[part].T @ back + DECAY * net[0], back.sum(0), h.T @ off + DECAY * net[2], np.array([off.sum()])]
            t += 1
            for p, g, m, v in zip(net, steps, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        loss = _loss(np.tanh(xs[check] @ net[0] + net[1]) @ net[2] + net[3], y[check])
        if loss < least - 1e-5:
            best, least, since = [p.copy() for p in net], loss, 0
        else:
            since += 1
            if since >= PATIENCE:
                break
    z = np.tanh(xs[check] @ best[0] + best[1]) @ best[2] + best[3]
    temperatures = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    temperature = float(temperatures[np.argmin([_loss(z / t, y[check]) for t in temperatures])])
    return Network(shift, scale, best[0], best[1], best[2], float(best[3][0]), temperature)


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 4


def _pool_rows(vectors):
    """Batches (..., text last) with the pooled vector in place of the text."""
    def run(batches):
        table = vectors.value
        for batch in batches:
            slots, ends = slots_of(batch.column(batch.num_columns - 1))
            out = np.array([pooled(slots[a:b], table) for a, b in zip(ends, ends[1:])], np.float64)
            ends = pa.array(np.arange(0, out.size + 1, FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))],
                                             [*batch.schema.names[:-1], "features"])

    return run


def fit_network(docs: DataFrame, labels: DataFrame, vectors, sample: int = SAMPLE, id_col: str = "doc_id", col: str = "text",
                label_col: str = "quality", held_out: int = 2) -> Network:
    """The network of at most ``sample`` labelled documents, chosen by a hash; ``vectors`` is the broadcast table.

    Labels come only from ids whose fold is not ``held_out``; the fold after it is kept back for stopping and
    calibration. Null labels and null ids teach nothing; several labels of one id count as their mean, rows of ``docs``
    that repeat an id and text as one.
    """
    known = (labels.where(F.col(label_col).isNotNull() & (fold(id_col) != held_out)).groupBy(F.col(id_col).alias("doc"))
             .agg(F.avg(F.col(label_col).cast("double")).alias("y")))
    known = known.orderBy(F.xxhash64("doc"), "doc").limit(sample)  # the bounded sample; safe to broadcast
    rows = docs.select(F.col(id_col).alias("doc"), F.col(col).cast("string").alias("text")).join(F.broadcast(known), "doc")
    rows = rows.select(F.xxhash64("doc", "text").alias("h"), "y", (fold("doc") == (held_out + 1) % 4).alias("check"), "text")
    pooled_rows = rows.mapInArrow(_pool_rows(vectors), "h long, y double, check boolean, features array<double>")
    pooled_rows = pooled_rows.groupBy("h").agg(*[F.first(c).alias(c) for c in ("y", "check", "features")])
    got = pooled_rows.orderBy("h").limit(sample).toArrow()
    x = got.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return train(x, got.column("y").to_numpy(), got.column("check").to_numpy().astype(bool))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", col: str = "text",
                    label_col: str = "quality", held_out: int = 2) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    The score (0 to 1, higher: label 1 is likelier) comes from the whole text alone. Null and empty texts and texts
    without tokens share one score. Every row of ``docs`` is scored, repeated or not; a null id is not held out. An
    empty table gives an empty result; without usable labels of both kinds all scores are one share. Other columns
    are not read.
    """
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs, col))
    net = sc.broadcast(fit_network(docs, labels, vectors, sample, id_col, col, label_col, held_out))

    def run(batches):
        pool, network = _pool_rows(vectors), net.value
        for batch in pool(batches):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(x))], ["doc", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc"), F.col(col).cast("string").alias("text")).mapInArrow(
        run, f"doc {kind}, score double")
    return scored.select(F.col("doc").alias(id_col), F.coalesce(fold("doc") == held_out, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
