import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from kinframe.llm import packing, token_counts
from kinframe.llm.common import scratch

PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")


def test_counts_and_cache(session, odd_docs, odd_rows, no_docs):
    import sentencepiece

    model, cache = sentencepiece.SentencePieceProcessor(model_file=PIECE), scratch(session, "test-cache")
    assert token_counts.count_tokens(no_docs, PIECE, cache).collect() == []
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in odd_rows), key=lambda x: (str(x[0]), x[1:]))
    for _ in range(2):
        got = token_counts.count_tokens(odd_docs, PIECE, cache).collect()
        assert sorted(map(tuple, got), key=lambda x: (str(x[0]), x[1:])) == want
    # the second run found every text in the cache
    stored = session.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, _ in odd_rows})


@pytest.mark.parametrize("few,hot", [(10000, 500), (3, 500), (10000, 1)])
def test_half_filled_cache_and_copies(session, odd_docs, odd_rows, monkeypatch, few, hot):
    import sentencepiece

    monkeypatch.setattr(token_counts, "FEW", few)
    monkeypatch.setattr(token_counts, "HOT", hot)
    model, cache = sentencepiece.SentencePieceProcessor(model_file=PIECE), scratch(session, "test-cache")
    token_counts.count_tokens(odd_docs.filter("source = 'a'"), PIECE, cache).collect()
    before = session.read.parquet(cache).count()
    many = odd_docs.unionByName(odd_docs.filter("doc_id = 0").crossJoin(session.range(40).select("id").withColumnRenamed("id", "n")).drop("n"))
    got = token_counts.count_tokens(many, PIECE, cache).collect()
    rows = [(i, t) for i, t, _ in odd_rows] + [(0, odd_rows[0][1])] * 40
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stored = session.read.parquet(cache)
    assert before < stored.count() == stored.select("digest").distinct().count()


def test_chunked_ids_are_the_library_s(odd_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    texts = [t or "" for _, t, _ in odd_rows] + [
        "A.B, C., 's it's IT'S\tTab\x1cFS <|ENDOFTEXT|> <|endoftext|>. x<|startoftext|>y é. é, ́. naïve ª. 1. 2,3, Σ. İ."]
    for t, ids in zip(texts, packing.encode_ids(texts, WORD)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(odd_docs, odd_rows, no_docs, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    docs = odd_docs.filter("doc_id <> 13")
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in odd_rows if i not in (None, 13)}
    rows = packing.pack_documents(docs, WORD, capacity).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(ids[i])
        assert all(n == capacity for _, _, n in own[:-1])
    assert set(pieces) == set(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // capacity) + 2
    assert packing.pack_documents(no_docs, WORD, capacity).collect() == []
    # repeated rows and a null id are packed too
    assert packing.tokenized_pieces(odd_docs, WORD, 1 << 20).count() == len(odd_rows)


def step_by_step(counts, capacity):
    """The method on single pieces, one sequence after the other."""
    left, out = dict(counts), []
    while any(left.values()):
        own, gap = [], capacity
        while fits := [n for n in left if left[n] and n <= gap]:
            own.append(max(fits))
            left[own[-1]] -= 1
            gap -= own[-1]
        while gap:
            small = min(own)
            pairs = [(a + b, a, b) for a in left for b in left if a <= b and a + b <= gap + small
                     and left[a] > (a == b) and left[b]]
            if not pairs or max(pairs)[0] <= small:
                break
            top = max(p[0] for p in pairs)
            _, a, b = min(p for p in pairs if p[0] == top)
            left[a] -= 1
            left[b] -= 1
            left[small] += 1
            own.remove(small)
            own += [a, b]
            gap = gap + small - a - b
        out.append(sorted(own))
    return out


def test_patterns_are_the_sequences_one_by_one():
    rng = np.random.default_rng(5)
    for capacity, n in ((20, 40), (50, 200), (97, 60)):
        lengths = rng.integers(1, capacity + 1, n) if n < 200 else rng.integers(1, 12, n)
        values, counts = np.unique(lengths, return_counts=True)
        counts = dict(zip(values.tolist(), counts.tolist()))
        got = [sorted(n for n, k in used.items() for _ in range(k)) for used, times in packing.plan(counts, capacity) for _ in range(times)]
        assert got == step_by_step(counts, capacity)


def test_pre_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(WORD), np.random.default_rng(11)
    alphabet = np.array(list("abcdestvmlrABST'''.,*$-_#<|>0129     \t\n\r\x1c\x0b éÉßÿŸĀžſŉ×÷ªº²İıΣσςя中́​😀"))
    texts = ["".join(rng.choice(alphabet[:n], size)) for n in (20, 45, len(alphabet)) for size in (5, 40, 300) for _ in range(60)]
    texts += ["IT'S we'Re 'Tis x<|startoftext|>Y <|endoftext|> <|no", ""]
    for t, ids in zip(texts, packing.encode_ids(texts, WORD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_a_batch_of_long_texts_is_not_held_in_parts():
    import tracemalloc

    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15000)]
    texts = [" ".join(words)] * 100
    n = sum(map(len, packing.encode_ids(texts[:1], WORD)))  # loads the tokenizer and the parts
    tracemalloc.start()
    assert [len(b) for b in packing.encode_ids(iter(texts), WORD)] == [n] * 100
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
