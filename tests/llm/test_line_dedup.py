import random

import pytest

from kinframe.llm import line_dedup as ld
from tests.llm.conftest import prose


def longest_common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *_next(row, x, b)]
    return row[-1]


def _next(row, x, b):
    out, left = [], 0
    for j, y in enumerate(b):
        left = row[j] + 1 if x == y else max(left, row[j + 1])
        out.append(left)
    return out


def test_patience_matches_in_order():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(14) for _ in range(rng.randrange(14))]
        b = [rng.randrange(14) for _ in range(rng.randrange(14))]
        if rng.random() < 0.5:
            b = a[:5] + b + a[5:]
        got = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:]))
        # of lines that differ from each other it matches as many as any alignment
        a, b = rng.sample(range(20), rng.randrange(15)), rng.sample(range(20), rng.randrange(15))
        assert len(ld.patience(a, b)) == longest_common(a, b)


def substance(line):
    return len(line.strip(" \t\r\x0b\x0c"))


def keys_of(lines, min_line):
    """Keys in order with the characters of the line that begins each."""
    solid, out = [x for x in lines if substance(x)], {}
    for k, x in enumerate(solid):
        if substance(x) >= min_line:
            out[x] = substance(x)
            continue
        run, chars = [], 0
        for y in solid[k:]:
            if substance(y) >= min_line or chars >= min_line:
                break
            run, chars = [*run, y], chars + substance(y)
        if chars >= min_line:
            out["short", *run] = substance(x)
    return out


def common(earlier, later, min_line):
    """Positions of ``later`` in any block of lines that ``earlier`` has as well, with enough characters."""
    out = set()
    for j in range(len(later)):
        for i in range(len(earlier)):
            n = 0
            while i + n < len(earlier) and j + n < len(later) and earlier[i + n] == later[j + n]:
                n += 1
            if sum(map(substance, later[j:j + n])) >= min_line:
                out.update(range(j, j + n))
    return out


def brute(rows, min_line=20, rare=0.2):
    """{(id, text): positions deleted}"""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    lines = [t.split("\n") for _, t in docs]
    own = [keys_of(ls, min_line) for ls in lines]
    have = {}
    for k, s in enumerate(own):
        for x in s:
            have.setdefault(x, []).append(k)
    cut = {d: set() for d in docs}
    for k, s in enumerate(own):
        owners = {}
        for x in s:
            if have[x][0] < k:
                owners.setdefault(have[x][0], []).append(x)
        for o, shared in owners.items():
            if sum(s[x] for x in shared) >= 3 * min_line or min(len(have[x]) for x in shared) <= max(2, rare * len(docs)) or len(shared) == len(s):
                cut[docs[k]] |= common(lines[o], lines[k], min_line)
    return cut


@pytest.mark.parametrize("hot", [500, 1, 10 ** 9])
def test_against_brute_force(session, odd_docs, odd_rows, no_docs, monkeypatch, hot):
    monkeypatch.setattr(ld, "HOT", hot)
    rng = random.Random(5)
    pool = [prose(rng, 8, 100) + f" {k}" for k in range(60)] + ["", "--", "short"]
    boiler = "All rights reserved by nobody in particular"
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    texts += ["\n".join([prose(rng, 9, 100), boiler, prose(rng, 9, 100)]) for _ in range(130)]
    texts += [boiler] * 3
    rows = list(enumerate(texts, 100)) + [(i, t) for i, t, _ in odd_rows if i != 13]
    docs = session.createDataFrame([(i, t, "s", 0, 0, "", 0.0) for i, t in enumerate(texts, 100)], odd_docs.schema).unionByName(
        odd_docs.filter("doc_id IS NULL OR doc_id <> 13"))
    want = brute(rows)
    got = ld.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for (i, t), cut in want.items():
        r = by_id[i]
        assert set(r.removed_lines) == cut and r.n_removed == len(cut), i
        if t:
            assert r.kept_text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut) and r.n_lines == t.count("\n") + 1
        else:
            assert r.n_lines == 0
    assert sum(map(len, want.values())) > 300
    left = {x for r in got for x in (r.kept_text or "").split("\n")}
    assert {x for _, t in rows for x in (t or "").split("\n")} <= left | {""}  # no line is lost everywhere
    assert any(boiler in (r.kept_text or "") and r.doc_id > 300 for r in got)  # a lone boilerplate line pairs nothing

    kept = ld.remove_lines(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        if r.doc_id in by_id and by_id[r.doc_id].n_removed:
            assert r.text == by_id[r.doc_id].kept_text and r.n_chars == len(r.text) and r.text.strip()
    assert ld.dedup_lines(no_docs).collect() == [] == ld.remove_lines(no_docs).collect()


def test_repeated_rows_share_a_result(odd_docs, odd_rows):
    got = [r for r in ld.dedup_lines(odd_docs.filter("doc_id IN (11, 12, 13)")).collect() if r.doc_id == 13]
    assert len(got) == sum(i == 13 for i, _, _ in odd_rows) and len({str(r) for r in got}) <= 2


def test_rarity_is_a_share_and_passages_always_go(session):
    """The same corpus at two sizes: what goes does not depend on the number of documents."""
    rng = random.Random(8)
    passage = "this line is long enough to be a passage by itself, wherever it occurs in the table"
    shared, common = "a shared line of few words", "a common line of few words"
    for n in (150, 1500):
        texts = ["\n".join([prose(rng, 9, 100) + f" {k}", *[shared] * (k % 10 == 3), *[common] * (k % 10 < 5),
                            *[passage] * (k % 10 > 2), prose(rng, 9, 100) + f" {k}"]) for k in range(n)]
        got = ld.dedup_lines(session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        left = {line: sum(line in r.kept_text.split("\n") for r in got) for line in (passage, shared, common)}
        # the passage is in 70 % and the shared line in 10 % of the documents; where both are, one pair cuts both
        assert left[passage] == 1 and left[shared] == 1, n
        assert left[common] >= n // 10 * 3, n  # in half of the documents, and alone in three of ten


def test_blocks_that_alignment_leaves():
    # the owner holds the passage twice, and no other line is common; a block in another order
    assert sorted(ld.common_blocks([1, 8, 9, 2, 8, 9, 3], [5, 8, 9, 6], [20] * 4, 20)) == [1, 2]
    assert sorted(set(ld.common_blocks([1, 2, 3, 4, 5], [4, 5, 1, 2, 3], [20] * 5, 20))) == [0, 1, 2, 3, 4]
    # short lines go with neighbours of the same block only
    assert sorted(set(ld.common_blocks([1, 7, 2, 3], [2, 3, 9, 7, 9, 1, 7], [20, 20, 20, 3, 20, 20, 3], 20))) == [0, 1, 5, 6]
    rng = random.Random(3)
    for _ in range(500):
        a = [rng.randrange(9) for _ in range(rng.randrange(20))]
        b = [rng.randrange(9) for _ in range(rng.randrange(20))]
        ends = [max(n for n in range(j + 2) if n == 0 or any(a[i:i + n] == b[j + 1 - n:j + 1] for i in range(len(a))))
                for j in range(len(b))]
        assert ld.longest_ends(a, b) == ends
        text = lambda x: "x" * x + chr(97 + x)
        got = set(ld.common_blocks(a, b, [x + 1 for x in b], 9))
        assert got == common([text(x) for x in a], [text(x) for x in b], 9)


def test_documents_of_short_lines(session):
    """Copies and passages of lines that are all shorter than a key."""
    rng = random.Random(12)
    verse = lambda n: [f"{prose(rng, 2, 100)[:12]} {rng.randrange(100)}" for _ in range(n)]
    poem, passage = verse(60), verse(12)
    texts = ["\n".join(poem)] * 3 + ["\n\n".join(poem[:20]), "\n".join([*verse(5), "", *passage, *verse(4)]), "\n".join([*verse(8), *passage, "", *verse(2)])]
    texts += ["ab\ncd", "ab\ncd", "\n".join(["x"] * 40), "\n".join(["x"] * 25)]
    rows = list(enumerate(texts))
    want = brute(rows)
    got = {r.doc_id: set(r.removed_lines) for r in ld.dedup_lines(session.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: cut for (i, _), cut in want.items()}
    assert got[1] == got[2] == set(range(60)) and len(got[5]) >= 12 and not got[7] and len(got[9]) == 25


def test_a_document_with_very_many_partners(session):
    rng = random.Random(13)
    lines = [prose(rng, 6, 100) + f" number {k}" for k in range(1500)]
    rows = [(k, lines[k] + f"\nown {k}") for k in range(1500)] + [(9999, "\n".join(lines))]
    got = ld.deletions(session.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.id, sorted(r.cut)) for r in got] == [(9999, list(range(1500)))]


def test_no_partner_is_missed(session):
    """What the first document has twice or in another order goes from all others."""
    rng = random.Random(9)
    p, q = [prose(rng, 9, 100) + f" {k}" for k in (1, 2)]
    own = [prose(rng, 9, 100) + f" {k}" for k in range(10, 40)]
    texts = ["\n".join([own[0], p, own[1], p, own[2], q])] + ["\n".join([q, own[k], p, own[k + 10]]) for k in range(3, 9)]
    got = ld.dedup_lines(session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed_lines for r in got} == {0: [], **{k: [0, 2] for k in range(1, 7)}}
