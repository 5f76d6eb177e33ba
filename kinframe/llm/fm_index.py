"""FM-index over a shard of token sequences (numpy): suffix array, wavelet matrix, backward search, locate."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array of ``seq`` (non-negative ints). Several symbols are packed into the first sort key; then
    prefix doubling sorts only suffixes whose rank is still shared."""
    n = len(seq)
    width = max(1, int(seq.max()).bit_length() + 1)
    packed = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key <<= width
        key[:max(0, n - j)] += seq[j:].astype(np.int64) + 1
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    heads = _heads(key[order])
    start = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank[order] = start
    del key
    at = np.nonzero(_shared(heads))[0]
    h = packed
    while len(at):
        sub = order[at]
        nxt = np.zeros(len(sub), np.int64)
        inside = sub + h < n
        nxt[inside] = rank[sub[inside] + h] + 1
        key = rank[sub] * (n + 1) + nxt
        by = np.argsort(key)
        sub, key = sub[by], key[by]
        order[at] = sub
        heads = _heads(key)
        rank[sub] = np.maximum.accumulate(np.where(heads, at, 0))
        at = at[_shared(heads)]
        h *= 2
    return order


def _heads(keys: np.ndarray) -> np.ndarray:
    heads = np.ones(len(keys), bool)
    heads[1:] = keys[1:] != keys[:-1]
    return heads


def _shared(heads: np.ndarray) -> np.ndarray:
    """Members of groups of two or more, given where groups begin."""
    single = heads.copy()
    single[:-1] &= heads[1:]
    return ~single


class Bits:
    """Bit vector with rank: 64-bit words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.zeros(8 * (n // 64 + 1), np.uint8)
        raw[:(n + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = raw.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """Index of one token sequence; the last symbol must occur nowhere else."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 8):
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.n = len(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        self.marked = Bits(sa % sample == 0)
        self.positions = sa[sa % sample == 0]
        del sa
        self.levels: list[tuple[int, int, Bits]] = []
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            one = (bwt >> shift) & 1 == 1
            self.levels.append((shift, int(len(one) - one.sum()), Bits(one)))
            bwt = np.concatenate([bwt[~one], bwt[one]])
        self.origin = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` comes to lie in the order of the last level, for symbol ``c``."""
        for shift, zeros, bits in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol ``c`` among the first ``i`` of the transformed sequence."""
        return self._descend(c, i) - self.origin[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long patterns: (row of the pattern, lo, hi) where lo < hi."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[which, j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            keep = lo < hi
            which, lo, hi = which[keep], lo[keep], hi[keep]
            if not len(which):
                break
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: step back through the text until a sampled position is met."""
        found = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marked.get(at) == 1
            found[todo[hit]] = self.positions[self.marked.rank(at[hit])] + steps
            todo, at, steps = todo[~hit], at[~hit], steps + 1
            i, c = at, np.zeros(len(at), np.int64)
            for _, zeros, bits in self.levels:
                b = bits.get(i).astype(np.int64)
                ones = bits.rank(i)
                i = np.where(b == 1, zeros + ones, i - ones)
                c = c * 2 + b
            at = self.first[c] + i - self.origin[c]
        return found
