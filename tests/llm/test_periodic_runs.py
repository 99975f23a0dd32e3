"""Runs against all periods of all stretches; the whole query against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gridproof.llm import periodic_runs as pr
from gridproof.llm import queries


def brute(w, least=24, times=3):
    """For each period the maximal stretches in which words that far apart are equal; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((i, n, q) for (i, n), q in found.items())


def collapse(w, runs):
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    return [x for k, x in enumerate(w) if k not in gone]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_small_sequences(seed):
    rng = random.Random(seed)
    for _ in range(120):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            w = (w[: rng.randrange(1, 9)] * 12)[: rng.randrange(60)] + w
        for least, times in ((24, 3), (4, 2), (6, 3)):
            assert pr.runs_of(np.array(w, np.int64), least, times).tolist() == [list(r) for r in brute(w, least, times)]


def test_suffix_tree_orders_suffixes():
    rng = random.Random(3)
    for _ in range(60):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))] + [0]
        tree = pr.suffix_tree(s)
        order, meet = pr.leaves(tree)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        falling = pr.leaves(tree, True)[0].tolist()
        assert falling == sorted(range(len(s)), key=lambda i: [-x if x else -9 for x in s[i:]])
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert meet[k] == next(n for n in range(len(s)) if a[n] != b[n])


def test_stretches_hold_all_runs_of_many_documents():
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        w = [rng.randrange(400) for _ in range(rng.randrange(200))]
        at, p, n = rng.randrange(len(w) + 1), rng.randrange(1, 30), rng.randrange(150)
        cycle = [rng.randrange(3) for _ in range(p)]
        texts.append(w[:at] + (cycle * n)[:n] + w[at:] + w[: rng.randrange(60)])
    words = np.array([x for t in texts for x in t], np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = [[] for _ in texts]
    for lo, hi in pr.stretches(words, doc, 24, 3):
        assert doc[lo] == doc[hi - 1]
        got[doc[lo]] += [(s + lo - at[doc[lo]], n, q) for s, n, q in pr.runs_of(words[lo:hi]).tolist()]
    assert [sorted(g) for g in got] == [brute(t) for t in texts]
    assert sum(map(len, got)) > 20


def planted(i, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    return w


def expected(i, text):
    w = planted(i, text)
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(collapse(w, runs))))


def got(df):
    return sorted(map(tuple, pr.digest(pr.periodic_runs(pr.with_planted_runs(df))).collect()), key=str)


def test_query_on_planted_and_odd_rows(documents, odd):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(150)))) for i in range(100, 500)]
    rows += [(300, "la " * 80), (301, "x y " * 30 + "z " * 30), (302, "x\ny\t" * 12), (303, "w " * 23), (304, "v " * 24)]
    odd = [(i, t) for i, t in odd if not t or len(t) < 10_000]
    found = got(documents(rows + odd))
    assert found == sorted((expected(i, t) for i, t in rows + odd), key=str)
    assert sum(r[1] for r in found) > 10


def test_long_and_empty(documents):
    text = " ".join(f"w{k % 5000}" for k in range(40_000))
    assert got(documents([(1, text), (2, "a " * 30_000)])) == sorted([expected(1, " ")[:1] + (1, 0, 40_000, 5000, 8000, *tail(text, [(0, 40_000, 5000)])), (2, 1, 0, 30_000, 1, 30_000_000, *tail("a " * 30_000, [(0, 30_000, 1)]))], key=str)
    assert got(documents([])) == []


def tail(text, runs):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(collapse(text.split(), runs)))


def test_whole_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    small = {i for i, t in rows if len((t or "").split()) < 1500}
    found = {r[0]: tuple(r) for r in queries.op13_periodic_runs(spark, folder).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        if i in small:
            assert found[i] == expected(i, t)
