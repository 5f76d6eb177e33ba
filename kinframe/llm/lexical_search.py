"""Ranked lexical search: the best documents of a table for every item of a query table.

Documents become vectors over the queries' terms (stored once). A task turns its documents into shards of a bounded
number of postings; in a shard every posting list is cut into blocks of similar documents (geometric blocking: the
documents of a list join the nearest of some of them, by random projections of their impacts), and each block keeps
the coordinatewise maximum of its documents' impacts. Queries go through their terms from the weightiest. When a term's
turn comes, a document that holds a weightier term of the query has been scored or has been ruled out, so the bound of
all others is the product of the query's remaining terms and the summary. A block is skipped only if that bound is below
the query's ``k``-th best score so far (the same for a whole list, whose summary is the shard's); the documents of all
other blocks are scored in full. What crosses tasks is ``k`` rows per item and task. Frequent terms are spread over all
shards, so no posting list belongs to one task.

Queries are taken in blocks of a bounded number of bytes, each against all documents; a block's terms are broadcast.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinframe.llm.common import stored
from kinframe.operators.topk import top_k_per_group

#: Fixed values of the contract: what is no part of a term, and the letters that are lower-cased.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if c < 91 and c >= 65 else c
               for c in range(256))

#: A shard ends at so many documents or postings, a block of queries at so many bytes (256 are added per item).
SHARD_DOCS, SHARD_POSTINGS, QUERY_BYTES = 16384, 2 << 20, 1 << 20
#: Documents per block aimed at, most blocks of a list, numbers of a document's sketch, cells of a summary at once.
BLOCK_DOCS, MAX_BLOCKS, SKETCH, SUMMARY_CELLS = 64, 256, 32, 4 << 20


def terms_of(text: Column) -> Column:
    """The terms of a text in order, repeats included; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def weight(n_docs: int, df: int) -> int:
    """A term's weight: ``floor(1000 ln((2 N + 2) / (2 df + 1)))``."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each occurrence of a term in the query adds to a document's score."""
    return weights * ((1000000000 * tf) // (1000 * tf + 12 * m))


@dataclasses.dataclass(frozen=True)
class Queries:
    """Queries over term numbers that fall in weight: query ``q`` has ``terms[starts[q]:starts[q + 1]]``, ascending,
    each ``times`` often."""

    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def of(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[q], self.starts[q + 1])
        return self.terms[at], self.times[at]

    def by_term(self, n_terms: int) -> list[list[tuple[int, int]]]:
        """For every term the queries with it, and its place among a query's terms."""
        out = [[] for _ in range(n_terms)]
        for q in range(len(self)):
            for i, t in enumerate(self.of(q)[0]):
                out[t].append((q, i))
        return out


@dataclasses.dataclass(frozen=True)
class Blocks:
    """A posting list in blocks: block ``b`` holds ``docs[starts[b]:starts[b + 1]]``; ``summary[t - term, b]`` is
    the greatest impact that term ``t``, the list's own or a lighter one, has in a document of the block."""

    docs: np.ndarray
    starts: np.ndarray
    summary: np.ndarray


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after the other."""
    sizes = hi - lo
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - sizes), sizes)


class Shard:
    """Documents as rows of impacts, their posting lists and sketches."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.starts, self.terms, self.impact, self.n_terms = starts, terms, impact, n_terms
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        self.lists = row[order]
        self.list_starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.real, self.summary = impact.astype(float), np.zeros(n_terms)
        np.maximum.at(self.summary, terms, self.real)
        signs = np.random.default_rng(5).choice(np.array([-1.0, 1.0], np.float32), (SKETCH, n_terms))
        sketch = np.stack([np.bincount(row, impact * s[terms], len(starts) - 1) for s in signs], 1).astype(np.float32)
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-30)

    def blocks(self, term: int):
        """The blocks of a term's posting list, in groups whose summaries take a bounded number of cells."""
        docs = self.lists[self.list_starts[term]:self.list_starts[term + 1]]
        k = min(-(-len(docs) // BLOCK_DOCS), MAX_BLOCKS)
        if k > 1:
            centres = self.sketch[docs[np.arange(k) * len(docs) // k]]
            nearest = np.concatenate([np.argmax(self.sketch[docs[at:at + 4096]] @ centres.T, 1)
                                      for at in range(0, len(docs), 4096)])
            order = np.argsort(nearest, kind="stable")
            docs = docs[order]
            starts = np.append(np.flatnonzero(np.diff(nearest[order], prepend=-1)), len(docs))
        else:
            starts = np.array([0, len(docs)])
        width = self.n_terms - term
        group = max(1, SUMMARY_CELLS // width)
        for at in range(0, len(starts) - 1, group):
            ends = starts[at:at + group + 1]
            part = docs[ends[0]:ends[-1]]
            lo, hi = self.starts[part], self.starts[part + 1]
            places = _ranges(lo, hi)
            block = np.repeat(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), hi - lo)
            terms = self.terms[places] - term
            rest = terms >= 0
            summary = np.zeros((width, len(ends) - 1))
            np.maximum.at(summary.reshape(-1), terms[rest] * (len(ends) - 1) + block[rest], self.real[places[rest]])
            yield Blocks(part, ends - ends[0], summary)

    def scores(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of documents, none of them without terms, against a query given as times per term."""
        lo, hi = self.starts[docs], self.starts[docs + 1]
        places = _ranges(lo, hi)
        return np.add.reduceat(self.impact[places] * query[self.terms[places]], np.cumsum(hi - lo) - (hi - lo))


def search_shard(shard: Shard, rank: np.ndarray, queries: Queries, by_term: list, floor: np.ndarray, k: int,
                 tally: dict | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the scores and documents of its ``k`` best, equal scores by ``rank``. ``floor`` is a score per query
    that the ``k``-th best of all documents has at least. ``tally`` counts lists and blocks met and skipped, and
    documents scored."""
    n_docs, margin = len(shard.starts) - 1, 1 + 1e-9  # the margin covers the rounding of doubles
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    floor, seen, query = floor.copy(), np.zeros((len(queries), n_docs), bool), np.zeros(shard.n_terms, np.int64)
    tally = {} if tally is None else tally
    bounds = [np.cumsum((queries.of(q)[1] * shard.summary[queries.of(q)[0]])[::-1])[::-1] for q in range(len(queries))]
    for term in range(shard.n_terms):
        if shard.list_starts[term] == shard.list_starts[term + 1]:
            continue
        asked = [(q, i) for q, i in by_term[term] if bounds[q][i] * margin >= floor[q]]
        tally["lists"] = tally.get("lists", 0) + len(by_term[term])
        tally["lists skipped"] = tally.get("lists skipped", 0) + len(by_term[term]) - len(asked)
        for blocks in shard.blocks(term) if asked else ():
            sizes = np.diff(blocks.starts)
            for q, i in asked:
                terms, times = queries.of(q)
                open_blocks = times[i:] @ blocks.summary[terms[i:] - term] * margin >= floor[q]
                docs = blocks.docs[np.repeat(open_blocks, sizes)]
                docs = docs[~seen[q, docs]]
                tally["blocks"] = tally.get("blocks", 0) + len(sizes)
                tally["skipped"] = tally.get("skipped", 0) + int((~open_blocks).sum())
                tally["scored"] = tally.get("scored", 0) + len(docs)
                if not len(docs):
                    continue
                seen[q, docs] = True
                query[terms] = times
                score = shard.scores(docs, query)
                query[terms] = 0
                fit = (score >= floor[q]) & (score > 0)
                if not fit.any():
                    continue
                score, docs = np.append(best[q][0], score[fit]), np.append(best[q][1], docs[fit])
                top = np.lexsort((rank[docs], -score))[:k]
                best[q] = score[top], docs[top]
                if len(top) == k:
                    floor[q] = max(floor[q], score[top[-1]])
    return best


def _vectors(docs: DataFrame, id_col: str, col: str, vocabulary: list[bytes]) -> DataFrame:
    """``id, n, terms, tfs`` of every document that has terms, stored; only the vocabulary's terms are kept."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches):
        number = sent.value.get
        for batch in batches:
            rows, totals, lists, counts = [], [], [], []
            for r, text in enumerate(batch.column(1)):
                plain = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_BYTES)
                n, found, at = 0, [], 0
                while at < len(plain):  # a long text is split piece by piece
                    end = plain.find(b" ", at + (1 << 20))
                    end = len(plain) if end < 0 else end
                    words = plain[at:end].split()
                    n, at = n + len(words), end
                    found.append(np.array([i for i in map(number, words) if i is not None], np.int32))
                if n:
                    terms, tfs = np.unique(np.concatenate(found), return_counts=True)
                    rows.append(r), totals.append(n), lists.append(terms), counts.append(tfs.astype(np.int32))
            if rows:
                ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(totals, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts)))], ["id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return stored(docs.select(F.col(id_col).alias("id"), F.col(col).cast("string").alias("text"))
                  .mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<int>"), "search-vectors")


def _search_block(vectors: DataFrame, rows: list, vocabulary: list[bytes], item_type, k: int) -> DataFrame:
    """``item, id, score``: of each task the ``k`` best documents per item."""
    spark = vectors.sparkSession
    totals = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = totals[0], totals[1] or 0
    frequency = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row per query term
    weights = np.array([weight(n_docs, frequency.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    order = np.argsort(-weights, kind="stable")  # from here on terms are numbered from the weightiest
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    weights, number = weights[order], {t: int(place[i]) for i, t in enumerate(vocabulary)}
    items, lists = [], {}
    for r in rows:
        lists.setdefault(r["item"], []).append((number[r["term"].encode("utf-8", "surrogatepass")], r["times"]))
    items = list(lists)
    flat = [pair for i in items for pair in sorted(lists[i])]
    queries = Queries(np.cumsum([0, *(len(lists[i]) for i in items)]), np.array([t for t, _ in flat], np.int64),
                      np.array([c for _, c in flat], np.int64))
    kind, id_type = to_arrow_type(item_type), vectors.schema["id"].dataType
    sent = spark.sparkContext.broadcast((items, queries, weights, place))

    def run(batches):
        items, queries, weights, place = sent.value
        by_term = queries.by_term(len(weights))
        best = [[] for _ in items]  # (score, id) from the best
        for ids, n, starts, terms, tfs in _shards(batches):
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            terms = place[terms]
            impact = impacts(weights[terms], tfs, np.repeat(m, np.diff(starts)))
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            floor = np.array([b[-1][0] if len(b) == k else 0 for b in best], np.int64)
            shard = Shard(starts, terms, impact, len(weights))
            for q, (score, docs) in enumerate(search_shard(shard, rank, queries, by_term, floor, k)):
                if len(docs):
                    found = zip(score.tolist(), ids.take(pa.array(docs)).to_pylist())
                    best[q] = sorted([*best[q], *found], key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        out = [(items[q], score, i) for q, b in enumerate(best) for score, i in b]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], kind), pa.array([o[2] for o in out], to_arrow_type(id_type)),
                 pa.array([o[1] for o in out], pa.int64())], ["item", "id", "score"])

    return vectors.where(F.size("terms") > 0).mapInArrow(
        run, f"item {item_type.simpleString()}, id {id_type.simpleString()}, score long")


def _shards(batches):
    """Rows of all batches in shards: ids, lengths, starts of the rows, term numbers, frequencies."""
    kept, docs, postings = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        at = 0
        while at < len(sizes):
            room = np.cumsum(sizes[at:at + SHARD_DOCS - docs])
            take = max(int(np.searchsorted(room, SHARD_POSTINGS - postings, side="right")), 0 if kept else 1)
            if take:
                kept.append(batch.slice(at, take))
                docs, postings, at = docs + take, postings + int(room[take - 1]), at + take
            if at < len(sizes) or docs >= SHARD_DOCS:
                yield _joined(kept)
                kept, docs, postings = [], 0, 0
    if kept:
        yield _joined(kept)


def _joined(parts: list):
    whole = pa.Table.from_batches(parts).combine_chunks()
    lists = whole.column("terms").chunk(0)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    column = lambda c: whole.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return (whole.column("id").chunk(0), whole.column("n").chunk(0).to_numpy(zero_copy_only=False),
            np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), column("terms"), column("tfs"))


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id",
           col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item, rank, id, score`` (the first and third named as in the tables): the ``k`` documents of greatest score
    above 0 of every item.

    Equal scores rank by ascending id, null ids last. Rows of ``items`` with one id (null is one too) are one item
    with the terms of all of them; an item whose terms no document has is not in the result. Every row of ``docs`` is
    a document of its own, whether its id or text repeats or not; texts that are null, empty or without terms count in
    no statistic. Empty tables give an empty result. Other columns are not read.
    """
    terms = items.select(F.col(item_col).alias("item"), F.explode(terms_of(F.col(col))).alias("term")).groupBy(
        "item", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = stored(terms, "search-queries")
    size = terms.groupBy("item").agg((F.sum(F.octet_length("term") + 16) + 256).alias("b")).agg(F.sum("b")).first()[0] or 0
    n_blocks = max(1, -(-int(size) // query_bytes))
    item_type, out = items.schema[item_col].dataType, None
    for block in range(n_blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).orderBy("item", "term").collect()
        vocabulary = sorted({r["term"].encode("utf-8", "surrogatepass") for r in rows})
        if not rows and n_blocks > 1:
            continue
        found = _search_block(_vectors(docs, id_col, col, vocabulary), rows, vocabulary, item_type, k)
        found = stored(found, "search-found") if n_blocks > 1 else found  # block by block, one vocabulary at a time
        out = found if out is None else out.unionByName(found)
    ranked = top_k_per_group(out, ["item"], [F.desc("score"), F.asc_nulls_last("id")], k, salt_cols=["id", "score"])
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
