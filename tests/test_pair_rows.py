"""Most similar pairs: terms become numbers, documents rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.operators import pairs as P
from kinframe.operators import similarity as S
from tests.test_neighbors import TEXTS, cosines, sparse


def some_texts():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(t)}" for t in rng.zipf(1.4, int(rng.integers(1, 30))) if t < 400) for _ in range(120)]
    for k in range(0, 30, 3):  # near copies, and words of one document
        texts.append(texts[k] + (" zz" if k % 2 else f" alone{k}"))
    return texts


def check(spark, texts, k):
    docs, tf, w = sparse(spark, texts)
    want = sorted((-round(s, 6), u, v) for (u, v), s in cosines(w, len(texts)).items() if round(s, 6) > 0)[:k]
    got = sorted((-r.similarity, r.u, r.v) for r in P.top_pairs_of(P.tfidf_rows(tf, len(texts)), k).collect())
    assert got == [(pytest.approx(s, abs=1e-6), u, v) for s, u, v in want]


@pytest.mark.parametrize("k,frequent,seeds", [(5, 1 << 16, 200), (40, 7, 1)])
def test_pairs_of_rows_equal_all_pairs(spark, k, frequent, seeds, monkeypatch):
    monkeypatch.setattr(P, "FREQUENT", frequent)  # most terms meet their number by an exchange
    monkeypatch.setattr(P, "SEEDS", seeds)
    check(spark, some_texts(), k)
    check(spark, TEXTS, k)


def test_pairs_with_many_copies(spark):
    check(spark, some_texts()[:20] + ["same words here"] * 40 + ["same words here too"] * 3, 9)


def test_no_text_is_stored_but_the_numbered_terms(spark, monkeypatch):
    kinds, keep = {}, P.stored

    def held(df, name):
        out = keep(df, name)
        kinds.setdefault(name, []).append(({t for _, t in df.dtypes}, out.count()))
        return out

    monkeypatch.setattr(P, "stored", held)
    texts = some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tf = S.term_counts(docs, "doc_id", S.tokens("text"))
    n = tf.count()
    from kinframe.plans import neighbors as N

    class Tables:
        documents = docs.withColumn("lang", F.lit("x"))
    monkeypatch.setattr(N, "stored", lambda df, name: df)
    assert len(N.q_top_similar_pairs(Tables).collect()) == 5
    assert all("string" not in t for name, l in kinds.items() if name != "terms" for t, _ in l)
    rows = [c for name, l in kinds.items() if name != "terms" for _, c in l]
    assert max(rows) < n / 2  # none has a row per document and term
