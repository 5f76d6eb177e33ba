import re
from collections import Counter

import duckdb
import pytest

from kinframe.llm import queries, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = dict(n_words=len(words), word_chars=sum(map(len, words)), n_symbols=sum(c in quality.SYMBOLS for c in text),
               n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered))
    out["fail_bits"] = sum(1 << k for k, rule in enumerate(quality.RULES.values()) if eval(rule, {}, out))
    out["base_failed"] = out["fail_bits"] & 3 != 0
    return out


def test_ledger_matches_brute_force(odd_docs, odd_rows):
    got = quality.apply_policy(quality.ledger(odd_docs), 2).collect()
    want = [(i, brute(t)) for i, t, _ in odd_rows]
    assert sorted(map(str, ({"doc_id": i, **b, "kept": b["fail_bits"] == 0} for i, b in want))) == \
        sorted(str({"doc_id": r.doc_id, **{k: r[k] for k in want[0][1]}, "kept": r.kept}) for r in got)


def test_policies_and_ablations(odd_docs, odd_rows):
    led = quality.ledger(odd_docs)
    bits = [brute(t)["fail_bits"] for _, t, _ in odd_rows]
    for policy in quality.POLICIES:
        m = quality.mask(policy)
        assert quality.apply_policy(led, policy).filter("kept").count() == sum(b & m == 0 for b in bits)
        assert quality.verdicts(led).filter(f"kept_v{policy}").count() == sum(b & m == 0 for b in bits)
        rows = {r.rule: r for r in quality.ablations(led, policy).collect()}
        for rule in quality.POLICIES[policy]:
            bit = quality.bit(rule)
            assert rows[rule].n_failed == sum(b & bit != 0 for b in bits)
            assert rows[rule].n_failed_alone == sum(b & m == bit for b in bits)


def test_filter_keeps_rows_whole(odd_docs, odd_rows, no_docs):
    kept = quality.filter_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t, _ in odd_rows if brute(t)["fail_bits"] == 0)
    assert quality.filter_documents(no_docs).collect() == []
    assert quality.ablations(quality.ledger(no_docs), 2).collect() == []


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_queries_with_sql(session, key):
    from tests.oracle import compare, duck

    sf = "/root/testdata/sf0.001"
    assert isinstance(duck(sf), duckdb.DuckDBPyConnection)
    assert compare(session, key, queries.QUERIES[key], queries.ORACLE[key], sf, duck(sf))["status"] == "ok"
