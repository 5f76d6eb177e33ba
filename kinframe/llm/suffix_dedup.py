"""Removal of long repeated byte strings by a distributed merge sort of sampled suffixes.

A byte goes if a string of ``LENGTH`` = 100 bytes that covers it also starts earlier (in a document with
a smaller id, or before in the same document); all strings are judged on the input.

1. Anchors. Every 100-byte window names the position of its least 36-byte hash (a minimizer), so equal
   windows name positions at equal offsets: about one position in 33. The context of an anchor is what its
   windows can cover: up to 64 bytes left of it and 100 from it on. One exchange of (hash of the 36 bytes,
   hash of the context, document, position) settles anchors whose whole context occurs earlier, all of
   whose windows repeat, and drops those whose 36 bytes have one context only. What is left is the first
   of each of several contexts around the same bytes: the borders of what repeats.
2. Sorted suffix runs. Each task takes the suffixes (100 bytes) that start at these anchors, with the
   bytes left of them, sorts them and front-codes them into runs, one per target of the exchange.
3. Merge. Each target merges its runs by a loser tree that compares no byte of a known common prefix and
   gives the common prefixes of neighbours. An offset o <= 64 fixes a window: ``o`` bytes left of the
   anchor and ``100 - o`` from it on. Windows are equal if no common prefix between their suffixes is
   shorter than ``100 - o`` and the o bytes to the left are equal; all but the earliest are repeats.
4. The bytes that repeats cover are merged per document.

Hot groups: 36 bytes that some task meets in more than ``HOT`` contexts are dealt by blocks of offsets, each
by a hash of the bytes that all windows of the block share, so even a line in every document is spread.
Copies meet inside the tasks first, and each task passes on one of them.

Whole contexts and the bytes left of an anchor are compared by 64-bit hashes, within anchors of the same
36 bytes; suffixes byte by byte.

Defined cases: a null text is empty, texts under 100 bytes lose nothing; a row without id is compared
with nothing and stays whole; repeated rows are one document (each gets the same result); rows with one id
and different texts are documents of their own, the one whose text has the lesser SHA-256 being the earlier;
ids of other types than whole numbers are ordered as Spark orders them; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm.common import n_partitions, small_batches, stored, whole_text
from kinframe.llm.suffix_runs import Run, merge, write_run
from kinframe.operators.sequence import dense_index

LENGTH = 100
GRAM = 36
LEFT = LENGTH - GRAM
#: Contexts of an anchor's bytes in one task after which they count as hot.
HOT = 16
#: Offsets are dealt in blocks of this many for hot anchors.
BLOCK = 8
#: Anchors, and suffixes, that a task holds at a time.
HELD = 1_000_000
HELD_SUFFIXES = 150_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`_range_hashes` takes the hash of any range."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(buf)), out=sums[1:])
    return sums


def _range_hashes(sums: np.ndarray, begin, end) -> np.ndarray:
    return _mixed((sums[end] - sums[begin]) * _powers(_INVERSE, len(sums))[begin])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    w = 1
    while 2 * w <= width:
        x = pick(x[:-w], x[w:])
        w *= 2
    return pick(x[:len(x) - (width - w)], x[width - w:]) if w < width else x


def anchors(sums: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts laid end to end; text i is offsets[i] .. offsets[i+1]."""
    n = len(sums) - 1
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _range_hashes(sums, slice(0, n + 1 - GRAM), slice(GRAM, n + 1))
    short = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(short, LEFT + 1, np.minimum)
    # a window that begins less than LENGTH before its text's end is none
    room = np.zeros(n + 1, np.int32)
    inside = np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1)
    np.add.at(room, inside, 1)
    np.add.at(room, offsets[1:], -1)
    least[np.cumsum(room[:len(least)]) > 0] = 0
    padded = np.concatenate([np.zeros(LEFT, np.uint32), least, np.zeros(LEFT, np.uint32)])
    at = np.nonzero(_slide(padded, LEFT + 1, np.maximum)[:len(short)] == short)[0]
    return at, grams[at]


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before in any of the keys."""
    heads = np.ones(len(sorted_keys[0]), bool)
    heads[1:] = False
    for k in sorted_keys:
        heads[1:] |= k[1:] != k[:-1]
    return heads


def _settled(context: np.ndarray, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (in order of context, document, position) whose context an earlier anchor has; ``context`` marks
    the first row of each. Rows that repeat the first anchor itself are not settled."""
    head = np.maximum.accumulate(np.where(context, np.arange(len(docs)), 0))
    return (docs != docs[head]) | (at != at[head])


_SETTLED, _OPEN, _HOT = 0, 1, 2
_ANCHORS = "route long, context long, doc long, at int, room int, kind int"


def _anchor_rows(*columns):
    names = [c.split()[0] for c in _ANCHORS.split(", ")]
    for k in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[k:k + (1 << 16)].astype(np.int64 if n < 3 else np.int32)) for n, c in enumerate(columns)],
            names=names)


def _dealt_anchors(batches):
    """``id, text`` to the anchors: route, context, document, position, bytes from there on (at most 100), kind.

    Anchors whose context the task has met earlier are settled. Of bytes with more than HOT contexts in the
    task one row goes where the bytes are counted and tells that they are hot; the others, known to have
    several contexts, are dealt by bytes and context."""
    held: list[tuple] = []
    n = 0

    def flush():
        docs, at, room, grams, contexts = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, docs, contexts, grams))
        docs, at, room, grams, contexts = (x[order] for x in (docs, at, room, grams, contexts))
        new_gram = _heads(grams)
        new_context = new_gram | _heads(contexts)
        settled = _settled(new_context, docs, at)
        many = np.bincount(np.cumsum(new_gram) - 1, weights=new_context)[np.cumsum(new_gram) - 1] > HOT
        kind = np.where(many, _HOT, _OPEN)
        kind[settled] = _SETTLED
        aside = settled | (many & ~new_gram)
        route = np.where(aside, _mixed(grams + contexts * np.uint64(_BASE)), grams)
        # settled anchors meet nobody: they are dealt by their place
        route[settled] = _mixed(docs[settled].view(np.uint64) * np.uint64(_BASE) + at[settled].astype(np.uint64))
        keep = settled | new_context
        yield from _anchor_rows(*(x[keep] for x in (route.view(np.int64), contexts.view(np.int64), docs, at, room, kind)))

    for b in batches:
        buf, offsets = _laid_out([t.encode() for t in b.column(1).to_pylist()])
        sums = _sums(buf)
        place, grams = anchors(sums, offsets)
        text = np.searchsorted(offsets, place, side="right") - 1
        at = place - offsets[text]
        room = np.minimum(LENGTH, offsets[text + 1] - place)
        back = np.minimum(LEFT, at)
        contexts = _mixed(_range_hashes(sums, place - back, place + room) + (back * 128 + room).astype(np.uint64))
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        held.append((ids[text], at, room, grams, contexts))
        n += len(at)
        if n >= HELD:
            yield from flush()
            held, n = [], 0
    if n:
        yield from flush()


def _repeated(batches):
    """Rows of :func:`_dealt_anchors`, all of a route together, to ``doc, at, room, kind``: anchors that are
    settled, and those that share their bytes but not their context with others."""
    parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(6)] for b in batches if b.num_rows]
    if not parts:
        return
    route, contexts, docs, at, room, kind = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((at, docs, kind == _SETTLED, contexts, route))
    route, contexts, docs, at, room, kind = (x[order] for x in (route, contexts, docs, at, room, kind))
    new_route = _heads(route)
    group = np.cumsum(new_route) - 1
    new_context = new_route | _heads(contexts)
    several = np.bincount(group, weights=new_context)[group] > 1
    hot = np.bincount(group, weights=kind == _HOT)[group] > 0
    done = (kind == _SETTLED) | _settled(new_context, docs, at)
    keep = done | (new_context & (several | hot))
    kind = np.where(done, _SETTLED, np.where(hot, _HOT, _OPEN))
    for k in range(0, len(docs), 1 << 16):
        s = np.nonzero(keep[k:k + (1 << 16)])[0] + k
        yield pa.RecordBatch.from_arrays([pa.array(docs[s]), pa.array(at[s]), pa.array(room[s]), pa.array(kind[s].astype(np.int32))],
                                         names=["doc", "at", "room", "kind"])


_RUN_SCHEMA = "target int, run binary, doc long, lo long, hi long"


def _hashed(columns: np.ndarray, seed) -> np.ndarray:
    """64-bit hash of each row of a byte matrix."""
    h = np.full(len(columns), seed, np.uint64) if np.isscalar(seed) else seed.astype(np.uint64)
    weights = _powers(_BASE, columns.shape[1] + 1)[1:]
    for k in range(0, columns.shape[1], 16):
        h = h + ((columns[:, k:k + 16].astype(np.uint64) + np.uint64(1)) * weights[k:k + 16]).sum(axis=1, dtype=np.uint64)
    return _mixed(h)


def _span_rows(docs, lo, hi, targets):
    n = len(docs)
    return pa.RecordBatch.from_arrays(
        [pa.array((np.abs(docs + lo) % targets).astype(np.int32)), pa.nulls(n, pa.binary()), pa.array(docs),
         pa.array(lo), pa.array(hi)], names=["target", "run", "doc", "lo", "hi"])


def _run_row(target, run):
    none = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), pa.array([run], pa.binary()), none, none, none],
                                      names=["target", "run", "doc", "lo", "hi"])


def _suffix_runs(docs, at, hot, right, right_len, left, left_len, targets):
    """Sorted front-coded runs per target, and the spans that the task settles itself."""
    key = np.concatenate([
        right, left, right_len[:, None].astype(np.uint8), left_len[:, None].astype(np.uint8),
        ((docs.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")).view(np.uint8).reshape(-1, 8),
        at.astype(">u8").view(np.uint8).reshape(-1, 8)], axis=1)
    context = LENGTH + LEFT + 2
    order = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel())
    key = key[order]
    alike = np.zeros(len(key), bool)
    again = alike.copy()
    alike[1:] = (key[1:, :context] == key[:-1, :context]).all(axis=1)
    again[1:] = alike[1:] & (key[1:, context:] == key[:-1, context:]).all(axis=1)  # a repeated row
    del key
    docs, at, hot, right_len, left_len = (x[order] for x in (docs, at, hot, right_len, left_len))
    # a suffix like an earlier one, its left included: all its windows repeat
    low, high = np.maximum(0, LENGTH - right_len), left_len
    settled = alike & (low <= high)
    # rows that repeat the first of their context are that first one
    head = np.maximum.accumulate(np.where(alike, 0, np.arange(len(docs))))
    settled &= (docs != docs[head]) | (at != at[head])
    if settled.any():
        yield _span_rows(docs[settled], (at - high)[settled], (at - low)[settled] + LENGTH, targets)
    first = np.nonzero(~alike)[0]
    docs, at, hot, right_len, left_len = (x[first] for x in (docs, at, hot, right_len, left_len))
    right, left = right[order[first]], left[order[first]]
    gram = _hashed(right[:, :GRAM], 0)

    which, block, dealt = [np.nonzero(~hot)[0]], [np.full((~hot).sum(), 255, np.int64)], [gram[~hot]]
    hots = np.nonzero(hot)[0]
    for j, o in enumerate(range(0, LEFT + 1, BLOCK)):
        last = min(o + BLOCK - 1, LEFT)
        own = hots[(left_len[hots] >= o) & (right_len[hots] >= LENGTH - last)]
        shared = np.concatenate([left[own][:, :o], right[own][:, :LENGTH - last]], axis=1)
        which.append(own)
        block.append(np.full(len(own), j, np.int64))
        dealt.append(_hashed(shared, j + 1))
    which, block, dealt = (np.concatenate(x) for x in (which, block, dealt))
    target = (dealt % np.uint64(targets)).astype(np.int64)
    by = np.lexsort((which, block, target))
    which, block, target = which[by], block[by], target[by]
    edges = np.concatenate([[0], np.nonzero(np.diff(target))[0] + 1, [len(target)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if a == b:
            continue
        w = which[a:b]
        strings = np.concatenate([block[a:b, None].astype(np.uint8), right[w]], axis=1)
        yield _run_row(int(target[a]), write_run(strings, right_len[w] + 1, left[w], left_len[w], docs[w], at[w]))


def _union_rows(docs: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Spans of documents, overlapping and touching ones joined."""
    order = np.lexsort((lo, docs))
    docs, lo, hi = docs[order], lo[order], hi[order]
    new = _heads(docs)
    part = np.cumsum(new)
    # the furthest end so far, kept apart by document
    reach = np.maximum.accumulate(hi + part * (1 << 40)) - part * (1 << 40)
    new[1:] |= lo[1:] > reach[:-1]
    begin = np.nonzero(new)[0]
    return docs[begin], lo[begin], np.maximum.reduceat(hi, begin) if len(begin) else hi


def _sorted_suffixes(targets: int):
    """``text, doc, anchors`` (array of at, room, kind) to runs and settled spans."""
    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            buf, offsets = _laid_out([t.encode() for t in b.column(0).to_pylist()])
            lists = b.column(2)
            flat = lists.flatten()
            at, room, kind = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
            text = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            ids = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            done = kind == _SETTLED
            if done.any():
                docs, lo, hi = _union_rows(ids[text[done]], at[done] - np.minimum(LEFT, at[done]), at[done] + room[done])
                yield _span_rows(docs, lo, hi, targets)
            fits = ~done & (at + GRAM <= (offsets[1:] - offsets[:-1])[text])
            text, at, hot = text[fits], at[fits], kind[fits] == _HOT
            for k in range(0, len(at), HELD_SUFFIXES):
                t, p, h = (x[k:k + HELD_SUFFIXES] for x in (text, at, hot))
                begin, end = offsets[t] + p, offsets[t + 1]
                right_len = np.minimum(LENGTH, end - begin)
                left_len = np.minimum(LEFT, p)
                ahead, back = np.arange(LENGTH), np.arange(1, LEFT + 1)
                right = np.where(ahead < right_len[:, None], buf[np.minimum(begin[:, None] + ahead, len(buf) - 1)], 0)
                left = np.where(back <= left_len[:, None], buf[np.maximum(begin[:, None] - back, 0)], 0)
                held.append((ids[t], p, h, right.astype(np.uint8), right_len, left.astype(np.uint8), left_len))
                n += len(p)
                if n >= HELD_SUFFIXES:
                    yield from _suffix_runs(*(np.concatenate(x) for x in zip(*held)), targets)
                    held, n = [], 0
        if n:
            yield from _suffix_runs(*(np.concatenate(x) for x in zip(*held)), targets)

    return run


def repeats(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans (doc, lo, hi) of the windows of merged runs that start earlier too."""
    order = [(r, p) for r, p in merge([iter(r) for r in runs])]
    run = np.fromiter((r for r, _ in order), np.int64, len(order))
    prefix = np.fromiter((p for _, p in order), np.int64, len(order))
    del order
    # the i-th string of a run comes out i-th among those of its run
    base = np.concatenate([[0], np.cumsum([len(r.docs) for r in runs])])
    by_run = np.argsort(run, kind="stable")
    row = np.empty(len(run), np.int64)
    row[by_run] = np.arange(len(run))
    del base
    docs, at, length, left_len = (np.concatenate([getattr(r, c) for r in runs])[row]
                                  for c in ("docs", "at", "lengths", "left_lengths"))
    left = np.concatenate([r.left for r in runs])[row]
    block = np.concatenate([_blocks_of(r) for r in runs])[row]
    # suffixes that share their gram with no neighbour are of no use
    joined = prefix > GRAM
    use = joined.copy()
    use[:-1] |= joined[1:]
    if not use.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    groups = np.cumsum(~joined)
    out = []
    some = np.nonzero(use)[0]
    cuts = [0]
    while cuts[-1] < len(some):  # whole groups, a bounded number of suffixes at a time
        end = min(len(some), cuts[-1] + HELD_SUFFIXES)
        if end < len(some):
            end = int(np.searchsorted(groups[some], groups[some[end - 1]], side="right"))
        cuts.append(end)
    for a, b in zip(cuts[:-1], cuts[1:]):
        s = some[a:b]
        out.append(_equal_windows(prefix[s], docs[s], at[s], length[s].astype(np.int64) - 1, left[s], left_len[s], block[s]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _blocks_of(run: Run) -> np.ndarray:
    """First byte of every string of a run."""
    heads = np.nonzero(run.shared == 0)[0]
    starts = np.cumsum(run.lengths.astype(np.int64) - run.shared) - (run.lengths.astype(np.int64) - run.shared)
    first = np.frombuffer(run.tails, np.uint8)[starts[heads]]
    return np.repeat(first, np.diff(np.append(heads, len(run.lengths)))).astype(np.int64)


def _equal_windows(prefix, docs, at, right_len, left, left_len, block):
    """Windows of neighbouring suffixes, offset by offset."""
    n = len(docs)
    lowest = np.where(block == 255, 0, block * BLOCK)
    highest = np.where(block == 255, LEFT, np.minimum(block * BLOCK + BLOCK - 1, LEFT))
    earlier = np.lexsort((at, docs))
    place = np.zeros(n, np.int64)
    d, p = docs[earlier], at[earlier]
    place[earlier[1:]] = np.cumsum((d[1:] != d[:-1]) | (p[1:] != p[:-1]))
    flags = np.zeros((n, LEFT + 2), bool)
    hashes = np.zeros(n, np.uint64)
    weights = _powers(_BASE, LEFT + 2)
    for o in range(LEFT + 1):
        if o:
            hashes = hashes + (left[:, o - 1].astype(np.uint64) + np.uint64(1)) * weights[o]
        ok = (left_len >= o) & (right_len >= LENGTH - o) & (lowest <= o) & (o <= highest)
        # the block's byte comes before the suffix
        group = np.cumsum(prefix < LENGTH - o + 1).astype(np.uint64)
        mine = earlier[ok[earlier]]
        if len(mine) < 2:
            continue
        key = _mixed(hashes[mine] + group[mine] * np.uint64(0xC2B2AE3D27D4EB4F))
        by = np.argsort(key, kind="stable")
        key, mine = key[by], mine[by]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        flags[mine, o] = place[mine] > place[mine[first]]
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), flags.astype(np.int8)], axis=1), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return docs[row], at[row] - (end - 1), at[row] - begin + LENGTH


def _merged(batches):
    """Runs of a target merged; spans that tasks have settled pass."""
    runs = []
    for b in batches:
        is_run = b.column(1).is_valid().to_numpy(zero_copy_only=False)
        if not is_run.all():
            yield b.filter(pa.array(~is_run)).select(["doc", "lo", "hi"])
        runs += [Run(x, LEFT) for x in b.column(1).drop_null().to_pylist()]
    if runs:
        docs, lo, hi = _union_rows(*repeats(runs))
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(lo), pa.array(hi)], names=["doc", "lo", "hi"])


def _union(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        lo, hi = max(0, lo), min(hi, n)
        if lo >= hi:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _cut(batches):
    """``id, text, spans`` to ``id, n_bytes, spans`` (merged) and the bytes left."""
    for b in batches:
        merged, kept, n_bytes = [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = text.encode()
            own = _union([(s["lo"], s["hi"]) for s in spans or ()], len(raw))
            edges = [0, *(x for s in own for x in s), len(raw)]
            merged.append([{"lo": a, "hi": z} for a, z in own])
            kept.append(b"".join([raw[a:z] for a, z in zip(edges[::2], edges[1::2])]) if own else raw)
            n_bytes.append(len(raw))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(merged, _SPANS), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "spans", "kept"])


def _spans(texts: DataFrame) -> DataFrame:
    """``id, text`` to ``doc, spans``: byte spans to remove (they may overlap), of documents that have any."""
    n = n_partitions(texts.sparkSession, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    dealt = texts.select("id", "text").mapInArrow(_dealt_anchors, _ANCHORS).repartition(n, "route")
    found = dealt.mapInArrow(_repeated, "doc long, at int, room int, kind int").groupBy("doc").agg(
        F.collect_list(F.struct("at", "room", "kind")).alias("anchors"))
    runs = (texts.join(found, F.col("id") == F.col("doc")).select("text", "doc", "anchors")
            .mapInArrow(_sorted_suffixes(4 * n), _RUN_SCHEMA).repartition(n, "target"))
    return runs.mapInArrow(_merged, "doc long, lo long, hi long").groupBy("doc").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans"))


_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _documents(rows: DataFrame) -> DataFrame:
    """``key, text`` (no null key) to ``id, text`` and, where the key is not the id, ``key``: equal rows share a long
    ``id``, ids rise with the key and, where rows of one key have different texts, with the SHA-256 of the text. Whole
    keys that name one text each are the ids."""
    if rows.schema["key"].dataType.simpleString() in _WHOLE:
        mark = F.xxhash64("text")
        several = rows.groupBy("key").agg((F.min(mark) < F.max(mark)).alias("several")).where("several").limit(1)
        if several.isEmpty():
            return rows.select(F.col("key").cast("long").alias("id"), "text")
    marked = rows.withColumn("digest", F.sha2("text", 256))
    numbers = dense_index(marked.select("key", "digest").distinct(), [], ["key", "digest"], "id")
    return stored(marked.join(numbers, ["key", "digest"]).select("id", "key", "text"), "suffix-texts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, spans, kept`` per row: the maximal removed byte spans and the bytes left."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), whole_text(text_col).alias("text"))
    # both joins deal the same rows by id, so Spark exchanges the texts once
    texts = _documents(rows.filter(F.col("key").isNotNull()))
    own = "key" if "key" in texts.columns else "id"
    joined = texts.join(_spans(texts), F.col("id") == F.col("doc"), "left").select(own, "text", "spans")
    alone = rows.filter(F.col("key").isNull()).select(
        F.col("key").cast(joined.schema[own].dataType).alias(own), "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans"))
    cut = joined.unionByName(alone).mapInArrow(
        _cut, f"id {joined.schema[own].dataType.simpleString()}, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")
    return cut.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)
