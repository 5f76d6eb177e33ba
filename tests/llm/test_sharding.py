import random
import zlib

from kinframe.llm import sharding


def test_laws_and_slots(odd_docs, odd_rows, no_docs):
    rows = sharding.shard_documents(odd_docs, 4).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(no_docs, 4).collect() == []


def test_hot_text_is_cut_evenly(session):
    rng = random.Random(3)
    texts = ["same text " * 20] * 700 + [f"{k} " * rng.randrange(1, 60) for k in range(1300)]
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = sharding.shard_documents(docs, 8, n_ranges=64, sample=512).collect()
    total = sum(r["size"] for r in rows)
    for s in range(8):
        own = [r for r in rows if r.shard == s]
        assert abs(sum(r["size"] for r in own) - total / 8) < 0.06 * total / 8
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_groups_of_equal_texts_stay_whole(session):
    texts = [f"text {k % 900}" for k in range(3600)]
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs, 8, n_ranges=64).collect()
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
