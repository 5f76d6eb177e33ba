"""Benchmark decontamination with one FM-index per training shard.

Documents are read in shards of bounded size. A shard's words become ids, its documents one sequence
(each ends in a separator of its own), and the sequence an FM-index. The windows of the benchmark items
are searched backwards through the wavelet ranks, their occurrences located by sampled suffix positions,
and the words they cover merged into spans. Documents are never shuffled.

The benchmark is the query set: it is taken in blocks of at most ``BLOCK_BYTES`` of text, each sent to
the workers and searched in every shard; results of several blocks are merged per document.

Words: A-Z lower-cased, runs of digits, letters and characters beyond ASCII. A window is ``window``
consecutive words of an item; a shorter item that has words is one window.

Defined cases: null texts have no words, null item ids read as the empty string; items without words
search nothing; an empty benchmark hits nothing; repeated documents each get their row; repeated items
count once by id; other columns are ignored by :func:`find_hits` and kept by :func:`remove_hits`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm.common import small_batches, stored, whole_text
from kinframe.llm.fm_index import FMIndex

#: Benchmark text that is held by a worker at a time.
BLOCK_BYTES = 4 << 20
#: Words after which a shard is closed (a longer document is a shard of its own).
SHARD_WORDS = 1_000_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or b in _KEEP or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


class Windows:
    """The distinct windows of some items: vocabulary, id matrices by length, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if ids:
                for k in range(max(1, len(ids) - window + 1)):
                    owners.setdefault(tuple(ids[k:k + window]), set()).add(number[name])
        self.by_length = []
        for n in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == n]
            self.by_length.append((np.array(own, np.int64), [np.array(sorted(owners[w]), np.int64) for w in own]))


def search_shard(docs: list[list[bytes]], windows: Windows) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """(start of each document in the shard, hit flag of each symbol, item numbers of each document)."""
    vocabulary: dict[bytes, int] = {}
    ids, starts = [], []
    for d in docs:
        starts.append(len(ids))
        ids.extend([vocabulary.setdefault(w, len(vocabulary)) for w in d])
        ids.append(-len(starts))
    seq = np.array(ids, np.int64)
    n_words = len(vocabulary)
    seq = np.where(seq < 0, n_words - 1 - seq, seq)  # separators follow the words
    starts = np.array(starts, np.int64)
    delta = np.zeros(len(seq) + 1, np.int64)
    items: list[set[int]] = [set() for _ in docs]
    to_shard = np.array([vocabulary.get(w, -1) for w in windows.vocabulary], np.int64)
    known = [(to_shard[m], owners) for m, owners in windows.by_length]
    known = [(m[ok], [owners[k] for k in np.nonzero(ok)[0]]) for m, owners in known for ok in [(m >= 0).all(axis=1)]
             if ok.any()]
    if known:
        index = FMIndex(seq, n_words + len(docs))
        for patterns, owners in known:
            which, lo, hi = index.search(patterns)
            if not len(which):
                continue
            many = hi - lo
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            at = index.locate(rows)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + patterns.shape[1], -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            for pair in np.unique(doc * len(patterns) + np.repeat(which, many)):
                items[pair // len(patterns)].update(owners[pair % len(patterns)].tolist())
    return starts, np.cumsum(delta[:-1]) > 0, items


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of set flags."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Windows]:
    """The benchmark's windows, a bounded block of items at a time."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             whole_text(text_col).alias("text"))
    held = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-held // BLOCK_BYTES))
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield Windows([(r["item"], r["text"]) for r in block.collect()], window)


def _shards(batches: Iterator[pa.RecordBatch], column: int):
    """(batches, words of each document) of about ``SHARD_WORDS``."""
    held, docs, n = [], [], 0
    for b in batches:
        held.append(b)
        for text in b.column(column).to_pylist():
            docs.append(words(text))
            n += len(docs[-1]) + 1
        if n >= SHARD_WORDS:
            yield held, docs
            held, docs, n = [], [], 0
    if held:
        yield held, docs


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _block_hits(keyed: DataFrame, windows: Windows) -> DataFrame:
    """``id, digest, n_words, spans, items`` of every document for one block."""
    sent = keyed.sparkSession.sparkContext.broadcast(windows)
    id_type = keyed.schema["id"].dataType.simpleString()

    def run(batches):
        for held, docs in _shards(batches, 2):
            starts, hit, items = search_shard(docs, sent.value)
            spans = [[{"lo": a, "hi": b} for a, b in spans_of(hit[s:s + len(d)])] for s, d in zip(starts, docs)]
            names = [sorted(sent.value.names[k] for k in own) for own in items]
            k = 0
            for b in held:
                m = k + b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(d) for d in docs[k:m]], pa.int64()),
                     pa.array(spans[k:m], _SPANS), pa.array(names[k:m], pa.list_(pa.string()))],
                    names=["id", "digest", "n_words", "spans", "items"])
                k = m

    return keyed.mapInArrow(
        run, f"id {id_type}, digest long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>")


def _merged_spans(spans):
    """Union of word spans (an array column) as sorted disjoint spans."""
    return F.aggregate(
        F.array_sort(spans), F.array().cast("array<struct<lo:bigint,hi:bigint>>"),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["hi"] >= s["lo"]), F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.struct(F.element_at(out, -1)["lo"].alias("lo"),
                             F.greatest(F.element_at(out, -1)["hi"], s["hi"]).alias("hi")))))
        .otherwise(F.concat(out, F.array(s))))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
              text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_hit, spans, items`` per document: the merged spans of word positions inside
    occurrences of windows, and the ids (as sorted strings) of the items with an occurring window."""
    small_batches(docs.sparkSession)
    text = whole_text(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    found = [_block_hits(keyed, w) for w in _blocks(benchmark, item_col, item_text_col, window)]
    hits = found[0]
    if len(found) > 1:
        key = ["id", "digest", "n_words"]
        some = [stored(f.filter(F.size("spans") > 0).distinct(), "hits") for f in found]
        every = some[0]
        for s in some[1:]:
            every = every.unionByName(s)
        merged = every.groupBy("id", "digest").agg(
            _merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = merged.select(F.col("id").alias("i"), F.col("digest").alias("d"), "spans", "items")
        hits = found[0].select(*key).join(
            merged, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left").select(
            *key, F.coalesce("spans", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return hits.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items")


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what lies between the words of a span."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))]
    out, done = [], 0
    for lo, hi in spans:
        out.append(raw[done:at[lo][0]])
        done = at[hi - 1][1]
    return b"".join(out + [raw[done:]]).decode()


def _clean(texts: list[str], windows: Windows) -> list[str | None]:
    """Texts with their hits cut out; cutting can bring the ends of a window together, so what was cut is
    searched again until nothing is hit. None: nothing but hits and punctuation was left."""
    out: list[str | None] = list(texts)
    todo = list(range(len(texts)))
    while todo:
        docs = [words(out[k]) for k in todo]
        starts, hit, _ = search_shard(docs, windows)
        again = []
        for k, s, d in zip(todo, starts, docs):
            spans = spans_of(hit[s:s + len(d)])
            if spans:
                out[k] = cut_text(out[k], spans)
                if words(out[k]):
                    again.append(k)
                else:
                    out[k] = None
        todo = again
    return out


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                length_col: str | None = "n_chars", item_col: str = "item_id",
                item_text_col: str = "text") -> DataFrame:
    """The documents without the words that benchmark windows cover; rows of which no word is left go.
    ``length_col``, where the table has it, follows the text. Rows without a hit come out unchanged."""
    small_batches(docs.sparkSession)
    names = docs.columns
    column, length = names.index(text_col), names.index(length_col) if length_col in names else -1

    def cleaner(sent):
        def run(batches):
            for held, _ in _shards(batches, column):
                texts = [t for b in held for t in b.column(column).to_pylist()]
                cleaned = iter(_clean([t or "" for t in texts], sent.value))
                for b in held:
                    before = b.column(column).to_pylist()
                    after = [next(cleaned) for _ in before]
                    if after == [t or "" for t in before]:
                        yield b
                        continue
                    cols = list(b.columns)
                    text = [None if t is None else a for t, a in zip(before, after)]
                    cols[column] = pa.array(text, cols[column].type)
                    if length >= 0:
                        old = cols[length].to_pylist()
                        cols[length] = pa.array([n if a == (t or "") or a is None else len(a) for n, t, a in
                                                 zip(old, before, after)], cols[length].type)
                    kept = pa.array([a is not None for a in after])
                    yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(kept)
        return run

    out = docs
    blocks = [docs.sparkSession.sparkContext.broadcast(w) for w in _blocks(benchmark, item_col, item_text_col, window)]
    while True:
        for sent in blocks:
            out = out.mapInArrow(cleaner(sent), docs.schema)
        if len(blocks) == 1:
            return out
        # a later block's cuts can bring words of an earlier block's window together
        out = stored(out, "cleaned")
        again = find_hits(out.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")), benchmark, window,
                          item_col=item_col, item_text_col=item_text_col)
        if again.filter("n_hit > 0").isEmpty():
            return out
