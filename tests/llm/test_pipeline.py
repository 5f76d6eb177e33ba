import public_tokenizers

import corpus_pipeline
from kinframe.llm import queries
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_line_dedup import brute as line_cuts
from tests.llm.test_quality import brute as quality_of
from tests.llm.test_simhash import brute as fingerprint
from tests.llm.test_simhash import components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(session):
    from kinframe.llm.packing import encode_ids

    docs = session.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in session.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if quality_of(t)["fail_bits"] == 0}
    cuts = line_cuts(list(kept.items()))
    cut = {}
    for (i, t), gone in cuts.items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or left.strip():
            cut[i] = left
    order = sorted(cut)
    root = components([fingerprint(cut[i]) for i in order])
    first = {i: cut[i] for k, i in enumerate(order) if root[k] == k}
    hit = {i for i, t in first.items() if hits(t, items)[1]}

    seen, d = [], docs
    for name, stage in corpus_pipeline.STAGES:
        d = stage(session, d, SF)
        seen.append((name, d))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.schema == docs.schema, name
            d = session.createDataFrame(d.collect(), d.schema)
    got = [{r.doc_id: r.text for r in x.collect()} for _, x in seen[:4]]
    assert got[0] == kept and got[1] == cut and got[2] == first
    assert set(first) - hit <= set(got[3]) and all(got[3][i] == first[i] for i in set(first) - hit)
    assert not any(hits(got[3][i], items)[1] for i in hit & set(got[3]))
    lengths = {}
    for r in seen[4][1].collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    path = public_tokenizers.path("word_bpe_49k.json")
    assert lengths == {i: len(x) // 4 + 1 for i, x in zip(got[3], encode_ids(list(got[3].values()), path))}


def test_odd_rows_and_empty_tables(session, odd_docs, odd_rows):
    """Nulls, empty, long and repeated texts, copies, null ids and clashing columns through all stages."""
    d = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(session, d, SF)
        assert out.schema == odd_docs.schema, name
        rows = out.collect()
        d = session.createDataFrame(rows, odd_docs.schema)
    texts = {t for _, t, _ in odd_rows}
    assert rows and all(r.text and r.id == 1 and r.key == "k" and r.kept == 2.0 for r in rows)
    assert len({(r.doc_id, r.text) for r in rows}) == len(rows) and len({r.text for r in rows}) == len(rows)
    assert any(r.text in texts for r in rows) and 4 not in {r.doc_id for r in rows}  # a copy of 0
    packed = corpus_pipeline.STAGES[-1][1](session, d, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
    d = odd_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        d = stage(session, d, SF)
        assert d.collect() == [], name


def test_run_and_registration(session):
    out = corpus_pipeline.run(session, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
    import __spark_entry__ as entry

    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")) == list(range(1, 14))
