import random
from hashlib import sha256

import numpy as np
import pytest

from kinframe.llm import suffix_dedup as sd
from kinframe.llm.suffix_runs import Run, merge, write_run
from tests.llm.conftest import prose


def brute(rows):
    """{(id, text): (removed flags)} by looking at every 100-byte string in order."""
    seen, out = set(), {}
    for i, raw in sorted({(i, (t or "").encode()) for i, t in rows if i is not None}, key=lambda d: (d[0], sha256(d[1]).hexdigest())):
        hit = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - 99):
            w = raw[s:s + 100]
            if w in seen:
                hit[s] += 1
                hit[s + 100] -= 1
            seen.add(w)
        out[i, raw] = np.cumsum(hit[:-1]) > 0
    return out


def check(docs, rows):
    want = brute(rows)
    got = sd.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        flags = np.zeros(r.n_bytes, bool)
        for s in r.spans:
            assert not flags[s.lo:s.hi].any()
            flags[s.lo:s.hi] = True
        fits = []  # rows of one id can have texts of one length
        for raw in {(t or "").encode() for i, t in rows if i == r.doc_id and len((t or "").encode()) == r.n_bytes}:
            expected = want.get((r.doc_id, raw), np.zeros(len(raw), bool))
            fits.append((flags == expected).all() and bytes(r.kept) == np.frombuffer(raw, np.uint8)[~flags].tobytes())
        assert any(fits), r.doc_id
    return sum(f.sum() for f in want.values())


def test_against_every_string(odd_docs, odd_rows, no_docs):
    assert check(odd_docs, [(i, t) for i, t, _ in odd_rows]) > 1000
    assert check(odd_docs.filter("doc_id IS NULL OR doc_id <> 13"), [(i, t) for i, t, _ in odd_rows if i != 13]) > 1000
    again = odd_docs.filter("doc_id = 11")
    got = sd.remove_repeats(again.unionByName(again).unionByName(odd_docs.filter("doc_id = 13"))).collect()
    assert len(got) == 2 + sum(i == 13 for i, _, _ in odd_rows) and len({str(r) for r in got if r.doc_id == 11}) == 1
    assert sd.remove_repeats(no_docs).collect() == []


def test_one_id_with_many_texts_and_ids_of_other_types(session):
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = [(1, passage), (2, prose(rng, 20) + " " + passage), (2, prose(rng, 70)), (2, prose(rng, 50) + passage), (3, passage), (None, passage)]
    rows += [(7, prose(rng, 30) + passage[: 120 + k]) for k in range(20)]
    assert check(session.createDataFrame(rows, "doc_id int, text string"), rows) > 500
    named = [(None if i is None else f"id-{i}", t) for i, t in rows] + [("10", passage + prose(rng, 9)), ("9", prose(rng, 9) + passage)]
    assert check(session.createDataFrame(named, "doc_id string, text string").repartition(2), named) > 500


@pytest.mark.parametrize("seed", range(3))
def test_common_lines_and_hot_groups(session, seed):
    rng = random.Random(seed)
    line = prose(rng, 14)[:80]
    passage = prose(rng, 40)
    texts = []
    for k in range(150):
        parts = [prose(rng, rng.randrange(5, 40))]
        parts += [line] * (k % 3 == 0) + [passage] * (k % 4 == 0) + [passage[20:150]] * (k % 7 == 0)
        rng.shuffle(parts)
        texts.append(rng.choice(["\n", " "]).join(parts))
    # neighbours of the line repeat in some documents only
    texts += [f"{'left ' * (k % 5)}{line}{' right' * (k % 6)}" for k in range(60)]
    rows = [(rng.randrange(-10 ** 12, 10 ** 12), t) for t in texts]
    assert check(session.createDataFrame(rows, "doc_id long, text string").repartition(3), rows) > 1000


def test_runs_and_loser_tree():
    rng = np.random.default_rng(4)
    runs, every = [], []
    for n in (0, 1, 5, 40, 200, 3):
        own = sorted(bytes(rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8)) for _ in range(n))
        every += own
        width = 12
        strings = np.zeros((n, width), np.uint8)
        for k, s in enumerate(own):
            strings[k, :len(s)] = list(s)
        left = rng.integers(1, 255, (n, 4)).astype(np.uint8)
        left_len = rng.integers(0, 5, n)
        run = Run(write_run(strings, np.array([len(s) for s in own], np.int64), left, left_len, np.arange(n) - 2, np.arange(n) * 3), 4)
        assert [s for _, s in run] == own
        assert (run.left == np.where(np.arange(4) < left_len[:, None], left, 0)).all() and (run.docs == np.arange(n) - 2).all()
        runs.append(run)
    heads = [iter(r) for r in runs]
    out, prefixes = [], []
    for r, p in merge([iter(r) for r in runs]):
        out.append(next(heads[r])[1])
        prefixes.append(p)
    assert out == sorted(every)
    for a, b, p in zip(out, out[1:], prefixes[1:]):
        common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert p == common


def test_anchors_follow_content():
    rng = random.Random(9)
    shared = prose(rng, 90).encode()
    texts = [prose(rng, 30).encode() + shared + prose(rng, 20).encode(), shared, b"short", shared[3:] + b"!"]
    buf, offsets = sd._laid_out(texts)
    at, _ = sd.anchors(sd._sums(buf), offsets)
    inside = []
    for k, t in enumerate(texts):
        own = {int(a - offsets[k]) for a in at if offsets[k] <= a < offsets[k + 1]}
        inside.append({a - t.find(shared[3:]) for a in own} if shared[3:] in t else own)
    for s in range(len(shared) - 3 - 99):  # every window has an anchor at the same place in each text
        assert {a for a in inside[0] if s <= a <= s + 64} & {a for a in inside[1] if s <= a <= s + 64} & \
            {a for a in inside[3] if s <= a <= s + 64}
