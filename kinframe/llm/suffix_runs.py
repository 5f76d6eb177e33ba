"""Front-coded sorted runs of byte strings, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

_HEAD = struct.Struct("<IIII")


def front_code(strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of the prefix shared with the row before, mask of the bytes after it) of sorted rows.

    ``strings`` is a byte matrix, a row per string, zero beyond its length."""
    n, width = strings.shape
    shared = np.zeros(n, np.int64)
    if n > 1:
        differ = strings[1:] != strings[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[1:] = np.minimum(shared[1:], np.minimum(lengths[1:], lengths[:-1]))
    columns = np.arange(width)
    return shared, (columns >= shared[:, None]) & (columns < lengths[:, None])


def write_run(strings: np.ndarray, lengths: np.ndarray, left: np.ndarray, left_lengths: np.ndarray,
              docs: np.ndarray, at: np.ndarray) -> bytes:
    """A sorted run as bytes: front-coded strings and, per string, what stands left of it and where it is."""
    shared, tail = front_code(strings, lengths)
    tails = strings[tail].tobytes()
    lefts = left[np.arange(left.shape[1]) < left_lengths[:, None]].tobytes()
    return b"".join([
        _HEAD.pack(len(lengths), len(tails), len(lefts), 0), shared.astype("<u2").tobytes(),
        lengths.astype("<u2").tobytes(), left_lengths.astype("<u2").tobytes(), docs.astype("<i8").tobytes(),
        at.astype("<i8").tobytes(), tails, lefts])


class Run:
    """A run read back: columns, and the strings one after the other."""

    def __init__(self, blob: bytes, left_width: int):
        n, n_tails, n_lefts, _ = _HEAD.unpack_from(blob)
        o = _HEAD.size

        def take(kind, size):
            nonlocal o
            out = np.frombuffer(blob, kind, n, o)
            o += n * size
            return out

        self.shared, self.lengths, left_lengths = take("<u2", 2), take("<u2", 2), take("<u2", 2)
        self.docs, self.at = take("<i8", 8), take("<i8", 8)
        self.tails = blob[o:o + n_tails]
        self.left_lengths = left_lengths.astype(np.int64)
        self.left = np.zeros((n, left_width), np.uint8)
        self.left[np.arange(left_width) < self.left_lengths[:, None]] = np.frombuffer(blob, np.uint8, n_lefts, o + n_tails)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        text, o, tails = b"", 0, self.tails
        for shared, length in zip(self.shared.tolist(), self.lengths.tolist()):
            text = text[:shared] + tails[o:o + length - shared]
            o += length - shared
            yield shared, text


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """(run, common prefix with the string before) of all strings in order.

    A loser tree over the heads of the runs. Every head carries the length of its common prefix with the
    last string that came out; of two heads the one with the longer prefix is the lesser, and only on a
    tie are bytes compared, from that length on. The next head of the winner's run starts with the prefix
    its front coding states, which is its common prefix with the string just put out.
    """
    k = 1
    while k < len(runs):
        k *= 2
    feeds = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    text: list[bytes | None] = [None] * k
    prefix = [0] * k
    for r, feed in enumerate(feeds):
        text[r] = next(feed, (0, None))[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's prefix to the one it shares with the winner."""
        s, t = text[a], text[b]
        if t is None:
            return a, b
        if s is None:
            return b, a
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        m = min(len(s), len(t))
        x = int.from_bytes(s[p:m], "big") ^ int.from_bytes(t[p:m], "big")
        same = m - (x.bit_length() + 7) // 8
        if same == m:
            a_first = len(s) <= len(t)
        else:
            a_first = s[same] < t[same]
        if a_first:
            prefix[b] = same
            return a, b
        prefix[a] = same
        return b, a

    losers = [0] * k
    level = list(range(k))
    node = k
    while len(level) > 1:  # leaves up: the nodes of a level follow those above it
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            won, lost = play(level[i], level[i + 1])
            losers[node + i // 2] = lost
            up.append(won)
        level = up
    won = level[0]
    while text[won] is not None:
        yield won, prefix[won]
        prefix[won], text[won] = next(feeds[won], (0, None))
        node = (won + k) // 2
        while node:
            won, losers[node] = play(won, losers[node])
            node //= 2
