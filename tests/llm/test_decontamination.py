import random
import re

import numpy as np
import pytest

from kinframe.llm import decontamination
from kinframe.llm.fm_index import FMIndex, suffix_array
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text, items, n=10):
    """(words, hit positions, item ids)"""
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(LOWER))
        for k in range(max(1, len(own) - n + 1) if own else 0):
            w = own[k:k + n]
            for at in range(len(words) - len(w) + 1):
                if words[at:at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    found.add("" if item is None else str(item))
    return words, hit, sorted(found)


@pytest.fixture(scope="module")
def items(odd_rows):
    shared = next(t for i, t, _ in odd_rows if i == 11)
    words = shared.split()
    return [(1, " ".join(words[5:30])), (2, "ONE, two!"), (10, None), (11, "..."), (3, prose(random.Random(1), 25)), (1, "be be be"),
            (None, "é" * 120)]


@pytest.fixture(scope="module")
def benchmark(session, items):
    return session.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("block", [4 << 20, 400])
def test_hits_match_brute_force(odd_docs, odd_rows, benchmark, items, no_docs, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    got = decontamination.find_hits(odd_docs, benchmark).collect()
    want = [(i, *brute(t, items)) for i, t, _ in odd_rows]
    key = lambda x: str(x)
    assert sorted([(i, len(w), len(h), tuple(f)) for i, w, h, f in want], key=key) == \
        sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got], key=key)
    for r in got:
        assert all(a.hi < b.lo for a, b in zip(r.spans, r.spans[1:]))
    assert sum(bool(h) for _, _, h, _ in want) >= 5
    assert decontamination.find_hits(no_docs, benchmark).collect() == []
    assert decontamination.find_hits(odd_docs, benchmark.limit(0)).filter("n_hit > 0").collect() == []


@pytest.mark.parametrize("block", [4 << 20, 400])
def test_removal_leaves_no_hit(odd_docs, odd_rows, benchmark, items, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    out = decontamination.remove_hits(odd_docs, benchmark)
    assert out.columns == odd_docs.columns
    out = out.collect()
    clean = [(i, t) for i, t, _ in odd_rows if not brute(t, items)[1]]
    same = [(r.doc_id, r.text) for r in out if (r.doc_id, r.text) in clean]
    assert sorted(map(str, same)) == sorted(map(str, clean))
    for r in out:
        assert not brute(r.text, items)[1]
        assert r.text is None or r.n_chars == len(r.text)


def test_cut_can_bring_a_window_together(session):
    words = [f"w{k}" for k in range(10)]
    text = " ".join(["x", *words[:5], *words, *words[5:], "y"])
    docs = session.createDataFrame([(1, text)], "doc_id long, text string")
    bench = session.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert decontamination.remove_hits(docs, bench).first().text.split() == ["x", "y"]


def test_index_against_plain_search():
    rng = np.random.default_rng(0)
    for n, v in ((1, 1), (50, 2), (400, 3), (1000, 40)):
        seq = np.concatenate([rng.integers(0, v, n), [v]])
        order = suffix_array(seq)
        tails = [tuple(seq[k:].tolist()) for k in range(len(seq))]
        assert [tails[k] for k in order] == sorted(tails)
        index = FMIndex(seq, v + 1)
        for m in (x for x in (1, 2, 3) if x < len(seq)):
            patterns = np.array([seq[k:k + m] for k in range(0, len(seq) - m, 7)])
            which, lo, hi = index.search(patterns)
            for w, a, b in zip(which, lo, hi):
                at = sorted(index.locate(np.arange(a, b)).tolist())
                assert at == [k for k in range(len(seq) - m + 1) if (seq[k:k + m] == patterns[w]).all()]
