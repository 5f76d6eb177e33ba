import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinframe.llm import lexical_search as ls

PATTERN = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for doc, c in counts:
            if c:
                m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
                found.append((sum(q[t] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                                  * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in q if c[t]), doc))
        found = sorted((f for f in found if f[0] > 0), key=lambda f: (-f[0], f[1] is None, f[1]))[:k]
        out += [(i, rank, doc, score) for rank, (score, doc) in enumerate(found, 1)]
    return sorted(out, key=str)


def run(frame, items, **options):
    return sorted(map(tuple, ls.search(frame, items, **options).collect()), key=str)


@pytest.fixture(scope="module")
def items(odd_rows):
    rng = random.Random(4)
    texts = [t for _, t, _ in odd_rows if t]
    rows = [(k, " ".join(rng.choices(terms(rng.choice(texts)) or ["x"], k=rng.randrange(1, 40)))) for k in range(60)]
    return rows + [(70, None), (71, ""), (72, "?!"), (73, "absentword"), (74, "RIVER river Zwölf"), (3, "more of item three river"),
                   (None, "stone light"), (75, "the the the and"), (75, "the the the and")]


@pytest.mark.parametrize("options", [{}, {"query_bytes": 4000}, {"k": 3}])
def test_search_equals_brute_force(session, odd_docs, odd_rows, items, options):
    table = session.createDataFrame([(i, t, 1, 2, "z") for i, t in items], "item_id long, text string, rank int, n long, terms string")
    want = brute([(i, t) for i, t, _ in odd_rows], items, options.get("k", 20))
    assert run(odd_docs, table, **options) == want and len(want) > 100


def test_empty_tables(session, odd_docs, no_docs, items):
    table = session.createDataFrame(items, "item_id long, text string")
    assert run(no_docs, table) == [] == run(odd_docs, table.limit(0))
    assert run(odd_docs.select("doc_id", "source").withColumnRenamed("source", "text").limit(0), table) == []


def test_string_ids_and_one_hot_word(session):
    rows = [(f"d{k % 900}", "hot " * (k % 7 + 1) + f"w{k % 50} " + "pad " * (k % 11)) for k in range(2000)]
    items = [("a", "hot w3"), ("b", "w7 w8 w7"), ("c", "pad")]
    got = run(session.createDataFrame(rows, "doc_id string, text string").repartition(3),
              session.createDataFrame(items, "item_id string, text string"))
    assert got == brute(rows, items)


@pytest.mark.parametrize("docs,postings,block", [(40, 1 << 20, 4), (1000, 500, 16), (100, 10, 3)])
def test_shards_and_blocks_lose_nothing(monkeypatch, docs, postings, block):
    """Many small shards and blocks give the scores of all documents, and blocks are skipped."""
    monkeypatch.setattr(ls, "SHARD_DOCS", docs)
    monkeypatch.setattr(ls, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ls, "BLOCK_DOCS", block)
    monkeypatch.setattr(ls, "SUMMARY_CELLS", 90)
    rng = np.random.default_rng(8)
    n_terms, rows = 30, []
    for i in range(600):
        topic = i % 5 * 6
        t = np.unique(np.append(rng.integers(topic, topic + 6, 4), rng.integers(0, n_terms, 2)))
        rows.append((i, t, rng.integers(1, 9, len(t))))
    batches = [pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in part]), pa.array([int(r[2].sum()) for r in part]), pa.array([r[1].tolist() for r in part]),
         pa.array([r[2].tolist() for r in part])], ["id", "n", "terms", "tfs"]) for part in (rows[:70], rows[70:71], rows[71:])]
    weights = np.sort(rng.integers(1, 5000, n_terms))[::-1]
    asked = [np.unique(rng.integers(0, n_terms, 5)) for _ in range(12)]
    queries = ls.Queries(np.cumsum([0, *map(len, asked)]), np.concatenate(asked), np.ones(sum(map(len, asked)), np.int64))
    best, tally, seen = [[] for _ in asked], Counter(), 0
    for ids, n, starts, terms_, tfs in ls._shards(iter(batches)):
        assert len(ids) <= docs and (len(terms_) <= postings or len(ids) == 1)
        seen += len(ids)
        impact = ls.impacts(weights[terms_], tfs, np.repeat(80 + n, np.diff(starts)))
        shard = ls.Shard(starts, terms_, impact, n_terms)
        floor = np.array([b[-1][0] if len(b) == 4 else 0 for b in best])
        found = ls.search_shard(shard, np.arange(len(ids)), queries, queries.by_term(n_terms), floor, 4, tally)
        for q, (score, at) in enumerate(found):
            best[q] = sorted(best[q] + list(zip(score.tolist(), ids.take(pa.array(at)).to_pylist())), key=lambda x: (-x[0], x[1]))[:4]
    assert seen == 600 and tally["skipped"] > 0 and tally["lists skipped"] > 0
    for q, t in enumerate(asked):
        full = []
        for i, ts, tf in rows:
            hit = np.isin(ts, t)
            full.append((int(ls.impacts(weights[ts[hit]], tf[hit], np.full(hit.sum(), 80 + tf.sum())).sum()), i))
        assert best[q] == sorted((f for f in full if f[0]), key=lambda x: (-x[0], x[1]))[:4]
