"""Retrieval and verification against every item scored."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridproof.llm import decontaminate as dc
from gridproof.llm import textops

ITEM = "item_id long, text string, split string"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], ITEM)


def built(texts):
    """One part with all the texts."""
    h, doc = dc.word_hashes(*textops.column_bytes(pa.array(texts, pa.large_string())))
    words = [h[doc == k] for k in range(len(texts))]
    frequency = {x: sum(x in set(w.tolist()) for w in words) for x in h.tolist()}
    return dc.Index.build(list(range(len(texts))), words, [np.array([frequency[x] for x in w.tolist()], float) for w in words], len(texts), len(h) / len(texts), max(5, *map(len, words)))


def brute(rows, bench, threshold=0.6, question=0.8, answer=0.8):
    """The whole query in plain Python: every passage against every item, with BM25 over all items."""
    def words(text):
        out = [w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
        return [w for w in out if w]

    items = [(i, words(t)) for i, t in bench]
    n, mean = len(items), max(1, sum(len(w) for _, w in items) / max(1, len(items)))
    longest = max([5, *(len(w) for _, w in items)])
    df = Counter(x for _, w in items for x in set(w))

    def weights(w):
        tf = Counter(w)
        return {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, c in tf.items()}

    def shingles(w, width):
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}

    out = {}
    for d, text in rows:
        doc = words(text)
        for start in range(0, max(1, len(doc)), longest):
            passage = doc[start : start + 2 * longest]
            for k, (i, w) in enumerate(items):
                if not w or not passage:
                    continue
                impact = weights(w)
                score = sum(v for x, v in impact.items() if x in passage) / sum(impact.values())
                if score < threshold - 1e-9:
                    continue
                at = max(0, len(w) - max(3, len(w) // 5))
                width = min(5, max(1, at))
                mine = shingles(w[:at], width)
                asked = len(mine & shingles(passage, width)) / len(mine) if mine else 1.0
                told = len(set(w[at:]) & set(passage)) / len(set(w[at:]))
                if asked >= question and told >= answer and ((d, k) not in out or (asked, told) > out[d, k][3:]):
                    out[d, k] = (d, i, round(score, 6), asked, told)
    return sorted(out.values(), key=str)


def query(docs, bench):
    return sorted(((r.doc_id, r.item_id, round(r.score, 6), r.question_overlap, r.answer_overlap) for r in dc.contaminated(docs, bench).collect()), key=str)


def stems(rng):
    """Items with a long shared stem, some common words and own endings, and documents with whole, cut and edited items."""
    stem = [f"s{k}" for k in range(12)]
    bench = [(k, " ".join([*(stem if k % 2 else []), *(f"c{rng.randrange(15)}" for _ in range(6)), *(f"i{k}x{j}" for j in range(rng.randrange(1, 12)))])) for k in range(60)]
    rows = []
    for k in range(80):
        words = [rng.choice([f"d{rng.randrange(200)}", f"c{rng.randrange(15)}"]) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            item = bench[rng.randrange(60)][1].split()
            for _ in range(rng.randrange(0, 3)):
                item[rng.randrange(len(item))] = "z"
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        rows.append((k, " ".join(words)))
    rows.append((80, " ".join(stem)))
    return bench, rows


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_whole_query_against_every_passage_and_item(spark, documents, monkeypatch, part_bytes):
    bench, rows = stems(random.Random(8))
    monkeypatch.setattr(dc, "PART_BYTES", part_bytes)
    monkeypatch.setattr(dc, "PASS_PARTS", 4)
    want = brute(rows, bench)
    assert len(want) > 20
    assert query(documents(rows), items(spark, bench)) == want


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 20))) for _ in range(40)]
    index = built(texts)
    for _ in range(60):
        query = {rng.randrange(len(index.vocabulary)) for _ in range(rng.randrange(1, 40))}
        scores = {}
        for block in index.blocks:
            for t in query & set(block.postings):
                for item, w in zip(*block.postings[t], strict=True):
                    scores[int(item)] = scores.get(int(item), 0.0) + float(w)
        for threshold in (0.2, 0.5):
            got = {i for block in index.blocks for i, _ in dc.wand(block, sorted(query), threshold)}
            assert {i for i, s in scores.items() if s >= threshold + 1e-6} <= got <= {i for i, s in scores.items() if s >= threshold - 1e-6}


def test_bounds_hold():
    index = built(["a b c d e", "a x y z"])
    for block, column in zip(index.blocks, index.bounds.T, strict=True):
        for t, (_, w) in block.postings.items():
            assert w.max() <= column[t]


def test_planted_items_are_found_wherever_they_stand(spark, documents):
    rng = random.Random(7)
    bench = [(k, " ".join(f"q{rng.randrange(3000)}" for _ in range(rng.randrange(8, 40)))) for k in range(25)]
    rows, planted = [], set()
    for k in range(60):
        words = [f"d{rng.randrange(3000)}" if rng.random() < 0.9 else f"q{rng.randrange(3000)}" for _ in range(rng.randrange(0, 300))]
        if k % 3 == 0:
            item = rng.randrange(25)
            at = rng.randrange(len(words) + 1)
            words[at:at] = bench[item][1].upper().split()
            planted.add((k, item))
        rows.append((k, " ".join(words)))
    got = dc.contaminated(documents(rows), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    assert all(r.question_overlap == r.answer_overlap == 1 and r.score == pytest.approx(1) for r in got)
    clean = dc.keep_clean(documents(rows), items(spark, bench))
    assert sorted(r.doc_id for r in clean.collect()) == [k for k in range(60) if k % 3]


def test_answer_must_be_there():
    words = np.arange(100, 120, dtype=np.uint64)
    asked, told = dc.overlaps(words, words[:16])
    assert asked == 1 and told == 0
    assert dc.overlaps(words, words) == (1, 1)


def test_odd_rows(spark, documents, odd):
    bench = items(spark, [(1, None), (2, ""), (3, "one"), (4, "a b c d"), (5, "a b c d"), (None, "null id text that has more than five words")])
    got = query(documents(odd), bench)
    assert got == brute(odd, [(r.item_id, r.text) for r in bench.collect()])
    assert {(4, 3), (5, 4), (6, 5), (None, None)} <= {r[:2] for r in got}
    assert dc.keep_clean(documents(odd), bench).columns == documents(odd).columns
    assert dc.contaminated(documents(odd), items(spark, [])).count() == 0
    assert dc.contaminated(documents([]), bench).count() == 0


def test_signs_around_words_hide_nothing(spark, documents):
    bench = items(spark, [(1, "One two, three four five. Six seven eight nine (ten)")])
    text = "x One### two,*** | three&&& four$$$ five.%%% \"Six### | seven eight nine$ ten%%% y"
    assert dc.contaminated(documents([(1, text), (2, text.replace("ten", "")), (3, "# | %")]), bench).select("doc_id").collect() == [(1,)]


def test_several_indexes_give_the_same(spark, documents, monkeypatch):
    bench = [(k, f"alpha{k} beta{k} gamma{k} delta{k} eps{k} zeta{k} eta{k} theta{k}") for k in range(20)]
    rows = [(k, f"before {bench[k][1]} after") for k in range(20)]
    one = {(r.doc_id, r.item_id) for r in dc.contaminated(documents(rows), items(spark, bench)).collect()}
    monkeypatch.setattr(dc, "PART_BYTES", 100)
    assert dc.index_parts(items(spark, bench)).count() > 3
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(documents(rows), items(spark, bench)).collect()} == one == {(k, k) for k in range(20)}
