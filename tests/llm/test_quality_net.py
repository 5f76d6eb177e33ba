import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinframe.llm import quality_net as qn
from tests.llm.conftest import WORDS, prose


TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|_+|\n|[!-/:-@\[-^`{-~]+")


def plain_slots(text):
    """Slots token by token."""
    out = []
    for token in TOKEN.findall((text or "").encode()):
        h = sum((b + 1) * pow(qn._BASE, i, 1 << 64) for i, b in enumerate(token)) * qn._MIX % (1 << 64)
        out.append(h >> (64 - qn.SLOT_BITS))
    return np.array(out, np.int64)


def one(text):
    return qn.slots_of(pa.array([text], pa.string()))[0]


def plain_contexts(texts):
    """Context sums and counts, neighbour by neighbour."""
    places, signs = qn.index_vectors()
    sums, counts = np.zeros((qn.SLOTS, qn.WIDTH)), np.zeros(qn.SLOTS)
    for text in texts:
        slots = plain_slots(text)
        for i, centre in enumerate(slots):
            for j in range(max(0, i - qn.SIDE), min(len(slots), i + qn.SIDE + 1)):
                if j != i:
                    sums[centre, places[slots[j]]] += signs[slots[j]]
                    counts[centre] += 1
    return sums, counts


def plain_pooled(slots, vectors):
    x = vectors[slots].astype(float)
    steps = [np.abs(x[k:] - x[:-k]).mean(0) if len(x) > k else np.zeros(qn.WIDTH) for k in (1, 2)]
    return np.concatenate([x.mean(0), x.std(0), *steps])


@pytest.mark.parametrize("tokens,piece", [(1 << 18, 1 << 20), (7, 1 << 20), (1 << 18, 40), (5, 60)])
def test_contexts_and_pooling_equal_brute_force(monkeypatch, odd_rows, tokens, piece):
    monkeypatch.setattr(qn, "TOKENS", tokens)
    monkeypatch.setattr(qn, "PIECE", piece)
    monkeypatch.setattr(qn, "_POWERS", [])
    texts = [t for _, t, _ in odd_rows if t is None or len(t) < 3000 and "x" * 50 not in t and "é" * 50 not in t][:18]
    texts += ["a_b__c 12,5!! \n\n#x", "\n", "", None, "Zwölf_é€ 9\x7f9"]
    found = qn.Contexts()
    column = pa.array(["dropped", *texts], pa.string()).slice(1)
    found.add(column.slice(0, 9))
    found.add(column.slice(9))
    found.settle()
    sums, counts = plain_contexts(texts)
    assert (found.sums.reshape(sums.shape) == sums).all() and (found.counts == counts).all()
    vectors = qn.finished(sums, counts)
    slots, ends = qn.slots_of(column)
    for t, a, b in zip(texts, ends, ends[1:]):
        assert slots[a:b].tolist() == plain_slots(t).tolist()
        want = plain_pooled(plain_slots(t), vectors) if b > a else np.zeros(qn.FEATURES)
        assert np.allclose(qn.pooled(slots[a:b], vectors), want, atol=1e-5)


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(qn, "PIECE", 50)
    monkeypatch.setattr(qn, "_POWERS", [])
    text = "one two! three\n" * 300 + "x" * 500 + " end"
    whole = plain_slots(text[:4500])
    assert one(text)[:len(whole)].tolist() == whole.tolist() and one(text)[-1] == plain_slots("end")[0]
    vectors = np.random.default_rng(1).standard_normal((qn.SLOTS, qn.WIDTH)).astype(np.float32)
    slots = np.random.default_rng(2).integers(0, qn.SLOTS, 40000).astype(np.int32)
    assert np.allclose(qn.pooled(slots, vectors), plain_pooled(slots, vectors), atol=1e-5)


def test_word_vectors_of_spark_equal_one_task(session, odd_docs, odd_rows):
    texts = [t for _, t, _ in odd_rows]
    assert np.allclose(qn.word_vectors(odd_docs.repartition(5)), qn.finished(*plain_contexts(texts)), atol=1e-5)


@pytest.fixture(scope="module")
def judged(session):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(500):
        text = prose(rng, rng.randrange(20, 80))
        good = k % 5 != 0
        if not good:
            text = " ".join(w + "###" for w in text.split()) if k % 2 else " ".join([rng.choice(WORDS)] * 60)
        rows.append((k, text, "a"))
        labels.append((k, int(good), 0))
    rows += [(None, "river stone", None), (900, None, None), (901, "", None), (902, "\n", "x"), (7, "a second text of seven", "a")]
    labels += [(None, 1, 0), (900, None, 0), (3, 1, 0), (3, 1, 0), (7777, 0, 0)]
    extra = [(*r, 0.5, 1, True) for r in rows]
    return (session.createDataFrame(extra, "doc_id long, text string, lang string, score double, predicted int, held_out boolean"),
            session.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels)


def test_held_out_accuracy_and_odd_rows(judged):
    docs, labels, rows, marks = judged
    got = qn.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    truth = {i: q for i, q, _ in marks[:500]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1


def test_held_out_labels_teach_nothing(judged):
    docs, labels, rows, marks = judged
    turned = [(i, 1 - q if q is not None and i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in marks]
    spark = docs.sparkSession
    again = qn.score_documents(docs, spark.createDataFrame(turned, labels.schema)).collect()
    first = {(r.doc_id, r.score) for r in qn.score_documents(docs, labels).collect()}
    assert {(r.doc_id, r.score) for r in again} == first


def test_empty_tables_and_one_label(session, judged, no_docs):
    docs, labels, rows, _ = judged
    assert qn.score_documents(no_docs, labels).count() == 0
    assert len({r.score for r in qn.score_documents(docs, labels.limit(0)).collect()}) == 1
    ones = qn.score_documents(docs, labels.where("quality = 1")).collect()
    assert len(ones) == len(rows) and ones[0].score > 0.9


def test_network_learns_calibrated_probabilities():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, qn.FEATURES))
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))
    y = (rng.random(6000) < p).astype(float)
    check = np.arange(6000) % 4 == 3
    net = qn.train(x[:4000], y[:4000], check[:4000])
    s = net.score(x[4000:])
    for lo, hi in ((0, .25), (.25, .5), (.5, .75), (.75, 1)):
        part = (s >= lo) & (s < hi)
        assert abs(s[part].mean() - y[4000:][part].mean()) < 0.1
