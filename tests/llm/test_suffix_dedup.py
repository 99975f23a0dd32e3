"""Removed bytes against all strings compared, and the covers."""

import random

import pytest

from gridproof.llm import suffix_dedup


def brute(rows, match):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in texts:
        for k in range(len(b) - match + 1):
            seen[b[k : k + match]] = seen.get(b[k : k + match], 0) + 1
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - match + 1):
            if seen[b[k : k + match]] > 1:
                gone[k : k + match] = [True] * match
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def run(df, match):
    got = suffix_dedup.remove_repeats(df, match).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=str)


@pytest.mark.parametrize("period", sorted(suffix_dedup.COVERS))
def test_covers_have_all_differences(period):
    cover = suffix_dedup.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("match", [200, 40, 5])
def test_random_copies(documents, match):
    rng = random.Random(match)
    pool = "".join(rng.choice("abcdé ") for _ in range(3000))
    rows = []
    for k in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(2500)
            parts.append(pool[at : at + rng.choice([match - 1, match, match + 1, match + 150])])
            parts.append("".join(rng.choice("xyzuvw") for _ in range(rng.randrange(30))))
        rows.append((k, "".join(parts)))
    assert run(documents(rows), match) == brute(rows, match)


def test_overlaps_within_one_text(documents):
    rows = [(1, "ab" * 101), (2, "q" * 199), (3, "r" * 201)]
    assert run(documents(rows), 200) == brute(rows, 200)


def test_odd_rows(documents, odd):
    rows = [r for r in odd if not r[1] or len(r[1]) < 10_000] + [(20, "y" * 3000), (21, "y" * 3000)]
    assert run(documents(rows), 200) == brute(rows, 200)


def test_very_long_texts(documents):
    text = " ".join(f"w{k}" for k in range(120_000))
    r = suffix_dedup.remove_repeats(documents([(1, text), (2, text[5000:700_000])])).orderBy("doc_id").collect()
    assert [[(s.start, s.stop) for s in x.spans] for x in r] == [[(5000, min(700_000, len(text)))], [(0, min(700_000, len(text)) - 5000)]]


def test_empty_table(documents):
    assert run(documents([]), 200) == []
