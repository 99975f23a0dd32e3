"""Removed words against all windows compared, and the sketch against true counts."""

import random
import re

import duckdb
import numpy as np
import pytest

from gridproof.llm import queries
from gridproof.llm import substring_dedup as sd


def brute(rows, width):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for i, t in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            c = tuple(w[k : k + width])
            if c in seen:
                gone[k : k + width] = [True] * width
            seen.add(c)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def run(df, width):
    got = sd.remove_repeats(df, width).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), bytes(r.kept).decode()) for r in got), key=str)


@pytest.mark.parametrize("width", [20, 6, 1])
def test_random_copies(documents, width):
    rng = random.Random(width)
    pool = [f"w{rng.randrange(400)}" for _ in range(3000)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(2500)
            parts += pool[at : at + rng.choice([width - 1, width, width + 1, width + 50])]
            parts += [f"x{rng.randrange(10**9)}" for _ in range(rng.randrange(9))]
        rows.append((rng.randrange(10**6), " ".join(parts)))
    assert run(documents(rows), width) == brute(rows, width)


def test_odd_rows(documents, odd):
    # rows with equal ids are documents of their own, of which one keeps its words
    rows = odd + [(20, "y " * 90), (21, "y " * 25), (22, "z\n" * 19), (23, "z\t" * 20)]
    assert run(documents(rows), 20) == brute(rows, 20)
    assert run(documents([]), 20) == []


def test_equal_rows_keep_one(documents):
    text = " ".join(f"w{k}" for k in range(40))
    assert [r[2] for r in run(documents([(1, text), (1, text), (1, text)]), 20)] == [0, 40, 40]


@pytest.mark.parametrize("width", [1, 2, 5, 20, 31])
def test_window_hash_tells_windows_apart(width):
    rng = np.random.default_rng(width)
    words = rng.integers(0, 2, 400).astype(np.uint64)
    h = sd.window_hash(words, width, 1)
    seen = {}
    for k, x in enumerate(h.tolist()):
        assert seen.setdefault(x, tuple(words[k : k + width])) == tuple(words[k : k + width])
    assert len(h) == 400 - width + 1
    assert len(set(h.tolist())) == len({tuple(words[k : k + width]) for k in range(len(h))})


def test_a_crowded_sketch_loses_nothing(documents, monkeypatch):
    # so few cells that all windows are estimated repeated: results stay, as the second pass groups exactly
    monkeypatch.setattr(sd, "CELLS", 0)
    rng = random.Random(2)
    pool = [f"w{rng.randrange(50)}" for _ in range(6000)]
    rows = [(k, " ".join(pool[(at := rng.randrange(5000)) : at + rng.randrange(200)])) for k in range(50)]
    assert run(documents(rows), 20) == brute(rows, 20)


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(duckdb.sql(sd.ORACLE).fetchall())
    assert sorted(map(tuple, queries.op12_substring_dedup(spark, folder).collect())) == want
