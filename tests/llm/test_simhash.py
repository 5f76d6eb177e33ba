import random
import re

import numpy as np
import xxhash

from kinframe.llm import simhash
from kinframe.llm.components import connected_components
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + n]).encode(), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Index of the first member of each fingerprint's component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(fps))]


def near_copies():
    rng = random.Random(11)
    rows = []
    for k in range(25):
        text = prose(rng, 300)
        rows.append(text)
        for _ in range(6):
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
            rows.append(text)
    return rows


def test_components_match_brute_force(session, odd_docs, odd_rows, no_docs):
    texts = near_copies()
    docs = session.createDataFrame([(i, t, "s", 0, 0, "", 0.0) for i, t in enumerate(texts, 1000)], odd_docs.schema).unionByName(odd_docs)
    rows = [(i, t) for i, t in enumerate(texts, 1000)] + [(i, t) for i, t, _ in odd_rows]
    fps = [brute(t) for _, t in rows]
    root = components(fps)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(str((i, f, least.get(r))) for (i, _), f, r in zip(rows, fps, root))
    got = simhash.near_duplicates(docs, 4).collect()
    assert sorted(str((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in got) == want
    assert len(set(root)) < len(set(fps))  # some links join different fingerprints

    kept = simhash.keep_one(docs, 4)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == len(set(root))
    assert len({r for k in kept for (i, t), r in zip(rows, root) if (i, t) == (k.doc_id, k.text)}) == len(kept)
    assert {k.doc_id for k in kept if k.doc_id is not None} == set(least.values())
    assert simhash.near_duplicates(no_docs, 4).collect() == [] == simhash.keep_one(no_docs, 4).collect()


def test_pigeonring_finds_every_link(session):
    rng = random.Random(2)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for bits in range(7):
            near = base
            for b in rng.sample(range(64), bits):
                near ^= 1 << b
            fps.append(near)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps} | {0, -1, 1 << 62})
    got = {(r.u, r.v) for r in simhash.links(session.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    a = np.array(fps, np.int64).view(np.uint64)
    want = {(fps[x], fps[y]) for x in range(len(fps)) for y in range(x + 1, len(fps)) if int(a[x] ^ a[y]).bit_count() <= 4}
    assert got == want


def test_components_of_chain_star_and_loop(session):
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (-3, -9), (-9, -3)]
    got = {r.node: r.root for r in connected_components(session.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 560)}, -3: -9, -9: -9}
    assert connected_components(session.createDataFrame([], "u long, v long")).collect() == []
