"""Shared forward scores against a search of all segmentations."""

import random

from gridproof.llm import token_counts as tc

VOCAB = tc.Vocabulary({"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.5, "ab": -2.2, "▁ab": -2.1, "bab": -3.1, "c": -4.0, "▁abc": -9.0, "é": -3.0}, -8.0)


def best(word):
    text = "▁" + word
    table = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(table[end - 1][0] + VOCAB.byte * n, table[end - 1][1] - n)]
        for start in range(max(0, end - 5), end):
            score = VOCAB.pieces.get(text[start:end])
            if score is not None:
                options.append((table[start][0] + score, table[start][1] - 1))
        table.append(max(options))
    return -table[-1][1]


def test_shared_prefixes_change_nothing():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcéz") for _ in range(rng.randrange(1, 9))) for _ in range(400)})
    assert tc.forward_counts(words, VOCAB) == [best(w) for w in words]


def test_odd_rows(documents, odd):
    rows = [(i, t) for i, t in odd if not t or len(t) < 100_000]
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in tc.count_tokens(documents(rows), VOCAB).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode().split()), sum(best(w.decode()) for w in (t or "").encode().split())) for i, t in rows), key=str)


def test_long_word_and_full_cache(documents, monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 3)
    text = "ab abab c ab " + "ab" * 20_000
    r = tc.count_tokens(documents([(1, text), (2, text)]), VOCAB).collect()
    assert r[0].n_tokens == r[1].n_tokens == best("ab") * 2 + best("abab") + best("c") + best("ab" * 20_000)


def test_public_vocabulary(documents):
    vocabulary = tc.Vocabulary.from_sentencepiece(tc.DEFAULT_MODEL)
    assert len(vocabulary.pieces) > 30_000
    assert tc.forward_counts(["the"], vocabulary) == [1]
    assert tc.count_tokens(documents([]), vocabulary).count() == 0
