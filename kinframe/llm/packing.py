"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A sequence is filled greedily (the longest piece that fits, again and again); then its smallest piece is
replaced by two unpacked pieces if these fill the gap so widened more tightly, until no pair does.

What greedy filling does next depends only on how many pieces of each length are left, so the plan is
made from the histogram of lengths (at most ``capacity`` rows, whatever the corpus) and every pattern is
repeated as often as its lengths last. Spark then numbers the pieces of each length and looks the
numbers up in the plan: no task sees more than a salted part of a length's pieces, and no text moves.

Tokens of a text are those of its pre-tokens, since the pre-tokenizer drops white space; a worker keeps the
ids of those that it has met (about ``_CACHE_SIZE`` at most), and encodes only new ones, many in one call. Texts
are cut one group after the other, so a batch of long texts is never held in pieces as a whole.

Defined cases: a null or empty text has only the end token; longer documents are cut into pieces of
``capacity`` tokens; repeated rows and ids are packed as rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinframe.llm.common import small_batches, stored, whole_text

END = (0).to_bytes(4, "little")
_SALTS = 256
_CACHE_SIZE = 400_000
#: Characters of the texts that are cut into parts together, and parts that are encoded as one text.
_GROUP_CHARS, _JOINED = 1 << 20, 256
#: White space, visible ASCII and the Latin letters that normalisation leaves alone but for case, and the
#: tokenizer's pattern on these characters.
_PLAIN = re.compile(r"[ \t\n!-~À-ÖØ-öø-įı-ſ]*")
_RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \t\n0-9a-zß-öø-ſ]+")
_WORKER: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """(tokenizer, whether an id ends a pre-token, part -> ids as little-endian bytes), loaded once in a Python worker."""
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        vocab = tok.get_vocab()
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        _WORKER[path] = (tok, last, {})
    return _WORKER[path]


def _parts(text: str) -> list[str]:
    """Parts of a text that encode on their own: its pre-tokens if it has only ``_PLAIN`` characters; else those of its
    space-separated chunks, a chunk of other characters as it is."""
    if _PLAIN.fullmatch(text) and "<|" not in text:
        return _RUN.findall(text.lower())
    chunks = text.replace("\n", " ").split(" ")
    return [p for c in chunks for p in (_RUN.findall(c.lower()) if _PLAIN.fullmatch(c) and "<|" not in c else (c,))]


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts of ``_GROUP_CHARS`` characters together, or one longer text."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > _GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _encode_apart(parts: list[str], tok, last: np.ndarray) -> Iterator[tuple[str, bytes]]:
    """The ids of every part. Parts that are one pre-token go to the library together, each up to an id that ends a
    pre-token; others go alone."""
    one, other = [], []
    for p in parts:
        (one if _RUN.fullmatch(p) and _PLAIN.fullmatch(p) and "<|" not in p else other).append(p)
    for at in range(0, len(one), _JOINED):
        some = one[at:at + _JOINED]
        ids = np.array(tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        ends, joined = (4 * np.flatnonzero(last[ids]) + 4).tolist(), ids.tobytes()
        for p, start, end in zip(some, [0, *ends[:-1]], ends, strict=True):
            yield p, joined[start:end]
    for p, e in zip(other, tok.encode_batch_fast(other, add_special_tokens=False)):
        yield p, np.array(e.ids, "<u4").tobytes()


def encode_ids(texts: Iterable[str], path: str) -> Iterator[bytes]:
    """Ids of every text, each id 4 little-endian bytes; only some texts are held in parts at a time."""
    tok, last, known = _tokenizer(path)
    for group in _groups(texts):
        if len(known) > _CACHE_SIZE:
            known.clear()
        cut = [_parts(t) for t in group]
        known.update(_encode_apart(list(set().union(*cut).difference(known)), tok, last))
        for parts in cut:
            yield b"".join(map(known.__getitem__, parts))


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, crc``: documents cut into pieces of at most ``capacity`` ids."""
    small_batches(docs.sparkSession, 128)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rest = [], [[], [], [], []]
            for row, ids in enumerate(encode_ids((t.as_py() for t in b.column(1)), tokenizer_path)):
                ids += END
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    own = ids[4 * start:4 * (start + capacity)]
                    at.append(row)
                    for out, v in zip(rest, (piece, start, len(own) // 4, zlib.crc32(own))):
                        out.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(rest[0], pa.int32())]
                + [pa.array(x, pa.int64()) for x in rest[1:]], names=["id", "piece", "start", "length", "crc"])

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, piece int, start long, length long, crc long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({length: copies}, times)`` that use up the counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, patterns = sorted(left), []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity

        def free(n):
            return left[n] - used.get(n, 0)

        while True:  # the longest that fits
            i = bisect.bisect_right(lengths, gap) - 1
            while i >= 0 and not free(lengths[i]):
                i -= 1
            if i < 0:
                break
            n = lengths[i]
            k = min(free(n), gap // n)
            used[n] = used.get(n, 0) + k
            gap -= k * n
        while gap:  # two for the smallest
            small = min(used)
            room = gap + small
            best = _best_pair(lengths, free, room)
            if best is None or sum(best) <= small:
                break
            used[small] -= 1
            if not used[small]:
                del used[small]
            for n in best:
                used[n] = used.get(n, 0) + 1
            gap = room - sum(best)
        times = min(left[n] // k for n, k in used.items())
        patterns.append((used, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))
    return patterns


def _best_pair(lengths: list[int], free, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum that is at most ``room``."""
    best, i, j = None, 0, bisect.bisect_right(lengths, room) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if not free(b):
            j -= 1
        elif not free(a) or (i == j and free(a) < 2):
            i += 1
        elif a + b > room:
            j -= 1
        else:
            if best is None or a + b > sum(best):
                best = (a, b)
                if a + b == room:
                    break
            i += 1
    return best


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces (a table that reads the same each time, with ``id, piece,
    length, crc``)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, base, taken = [], 0, dict.fromkeys(counts, 0)
    for used, times in plan(counts, capacity):
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, taken[n], taken[n] + k * times, times, base, offset))
            taken[n] += k * times
            offset += n * k
        base += times
    # a row per pattern and length: bounded by the capacity, not by the corpus
    slots = spark.createDataFrame(rows, "length long, lo long, hi long, times long, base long, at long")

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(_SALTS)))
    per_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    first = per_salt.select("length", "salt", F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece", "crc"))
    ranked = (salted.withColumn("inside", inside).join(first, ["length", "salt"])
              .withColumn("rank", F.col("first") + F.col("inside") - 1).drop("salt", "inside", "first"))
    slot = F.col("rank") - F.col("lo")
    return (ranked.join(F.broadcast(slots), "length").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
            .select(*pieces.columns, (F.col("base") + slot % F.col("times")).alias("sequence_id"),
                    (F.col("at") + F.floor(slot / F.col("times")) * F.col("length")).alias("offset")))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Packed pieces of whole documents: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = stored(tokenized_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity).select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id",
        "offset")
