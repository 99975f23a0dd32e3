"""Base counts against plain Python, decoding against all paths, and verdicts on labelled texts."""

import itertools
from collections import Counter

import numpy as np
import pytest

from gridproof.llm import quality_crf as q


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return q.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def counts(text):
    text = text or ""
    w = text.encode().split()
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    mark = [False] * len(w)
    for k in range(len(w) - 4):
        if grams[tuple(w[k : k + 5])] > 1:
            mark[k : k + 5] = [True] * 5
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, sum(mark), n < 10 or 100 * sum(mark) > 20 * n


def test_counts_of_odd_rows(documents, odd, model):
    rows = [*odd, (30, "a b\na b\n\n\na b \na b"), (31, "one two three four five six one two three four five"), (32, "#*$%&|<> <b>|")]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.judge(documents(rows), model).collect()), key=str)
    assert got == sorted(((i, *counts(t)) for i, t in rows), key=str)
    assert not q.judge(documents(rows), model).where("kept and base_failed").count()


def test_empty_tables(spark, documents, model):
    assert q.judge(documents([]), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    free = q.train(documents([(1, "some words")]), labels)
    assert q.judge(documents([(1, " ".join(f"word{k}" for k in range(20)))]), free).first().kept


def test_decode_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        crf = q.Crf(np.zeros(1), rng.normal(size=(2, 2)))
        s = rng.normal(size=6).tolist()

        def value(path, s=s, crf=crf):
            return sum(x for x, y in zip(s, path, strict=True) if y) + sum(crf.moves[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert tuple(crf.decode(s)) == best
    assert q.Crf(np.zeros(1), np.zeros((2, 2))).decode([]) == []


def test_fit_learns_neighbours():
    x0, x1 = np.zeros((6, len(q._BINS)), np.int32), np.ones((6, len(q._BINS)), np.int32)
    crf = q.fit([(x0, np.zeros(6, int)), (x1, np.ones(6, int))] * 5)
    assert crf.decode(crf.scores(x0).tolist()) == [0] * 6 and crf.decode(crf.scores(x1).tolist()) == [1] * 6
    assert crf.moves[0, 0] > crf.moves[0, 1]


def test_verdicts_on_held_out_labels(spark, model):
    d = "/root/testdata/sf0.1"
    got = q.judge(spark.read.parquet(f"{d}/documents.parquet"), model).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    right = got.selectExpr("avg(cast(kept = (quality > 0) as int))").first()[0]
    assert right > 0.98


def test_keep_passes_all_columns(documents, odd, model):
    df = documents(odd)
    kept = q.keep(df, model)
    assert kept.columns == df.columns
    verdict = {r.doc_id for r in q.judge(df, model).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict
