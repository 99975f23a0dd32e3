"""Counts and base scores against plain Python; the model is a distribution and beats the base."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gridproof.llm import maxent_lm


def base(rows):
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in texts]
    c = Counter(x for (_, w), h in zip(texts, held, strict=True) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for (i, w), h in zip(texts, held, strict=True)), key=str)


def run(df):
    got = maxent_lm.score_texts(df)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.collect()), key=str)


def test_base_of_odd_rows(documents, odd):
    assert run(documents(odd)) == base(odd)


def test_empty_table(documents):
    assert run(documents([])) == []


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = maxent_lm.score_texts(docs).where("held_out").selectExpr("sum(base_score) / sum(n_tokens) b", "sum(score) / sum(n_tokens) s").first()
    assert r.s > r.b + 0.03


def bigrams(rows):
    """Log10 probability a held-out token of a bigram count model with as many smoothing counts as successors."""
    texts = [((t or "").encode().lower().split() + [None], zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    one = Counter(x for w, h in texts if not h for x in w)
    n, v = sum(one.values()), len(one)
    two = Counter(p for w, h in texts if not h for p in zip([0, *w], w, strict=False))
    context, kinds = Counter(), Counter(a for a, _ in two)
    for (a, _), c in two.items():
        context[a] += c
    total, size = 0.0, 0
    for w, h in texts:
        for a, b in zip([0, *w], w, strict=False) if h else ():
            base = (one[b] + 1) / (n + v + 1)
            total += math.log10((two[a, b] + kinds[a] * base) / (context[a] + kinds[a]) if a in context else base)
            size += 1
    return total / size


def test_model_beats_bigram_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = maxent_lm.score_texts(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) s").first()
    assert r.s > bigrams(docs.select("doc_id", "text").collect()) + 0.01


def test_scores_do_not_depend_on_the_partitions(sample):
    docs = sample.select("doc_id", "text")
    one, other = (sorted((r.doc_id, round(r.score, 6)) for r in maxent_lm.score_texts(docs.repartition(n)).collect()) for n in (1, 7))
    assert one == other


def test_scores_of_odd_rows_in_plain_python(documents, odd, monkeypatch):
    """Every score from counted words and pairs, where training leaves the class softmax at its bias."""
    shape = maxent_lm.Shape(singles=2, shared=1, shared_words=3, buckets=8)
    monkeypatch.setattr(maxent_lm, "train", lambda packs, head, s: (np.zeros((3 * s.buckets, s.classes), np.float32), head.bias))
    rows = [*odd[:6], (20, "a b a b c"), (21, "a b d"), (22, "b b a x9"), (30, "unseen a b")]
    texts = []
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        texts.append((i, maxent_lm.tokens(data, np.array([0, len(data)]))[0].tolist(), maxent_lm.held_out(i)))
    count = Counter(k for _, w, h in texts if not h for k in w)
    top = sorted(count, key=lambda k: (-count[k], k))[: shape.head]
    group = {k: r if r < shape.singles else shape.singles for r, k in enumerate(top)}

    def class_of(k):
        return group.get(k, shape.singles + shape.shared + k % 16)

    sums = Counter()
    for k in top:
        sums[group[k]] += count[k]
    tail = {c: (sum(n for k, n in count.items() if k not in group and k % 16 == c), sum(k not in group and k % 16 == c for k in count)) for c in range(16)}
    prior = [sums[c] for c in range(shape.singles + shape.shared)] + [tail[c][0] + 1 for c in range(16)]
    pair, context, kinds = Counter(), Counter(), Counter()
    for _, w, h in texts:
        for a, b in zip([None, *w], w, strict=False) if not h else ():
            pair[a, b] += 1
    for (a, b), n in pair.items():
        context[a, class_of(b)] += n
        kinds[a, class_of(b)] += 1
    want = []
    for i, w, _ in texts:
        total = 0.0
        for a, b in zip([None, *w], w, strict=False):
            c = class_of(b)
            share = count[b] / sums[c] if b in group else (count[b] + 1) / (sum(tail[b % 16]) + 1)
            n, t = context[a, c], kinds[a, c]
            total += math.log10((prior[c] + 0.5) / sum(p + 0.5 for p in prior)) + math.log10((pair[a, b] + t * share) / (n + t) if n else share)
        want.append((i, round(total, 3)))
    got = sorted(((r.doc_id, round(r.score, 3)) for r in maxent_lm.score_texts(documents(rows), shape).collect()), key=str)
    assert [(i, pytest.approx(s, abs=2e-3)) for i, s in sorted(want, key=str)] == got


def test_words_of_a_class_sum_to_one():
    share = np.array([0.5, 0.3, 0.2])
    met = np.array([[4, 6, 2], [2, 6, 2], [0, 6, 2]])
    assert np.exp(maxent_lm.within(share, met)).sum() == pytest.approx(1)
    assert np.exp(maxent_lm.within(share, met * 0)) == pytest.approx(share)


def test_shares_sum_to_one():
    shape = maxent_lm.Shape(singles=2, shared=1, shared_words=2, buckets=8)
    keys = np.array([16, 33, 50, 67], np.uint64)
    counts = np.array([9.0, 5.0, 3.0, 2.0])
    tails, words = np.full(16, 6.0), np.full(16, 2.0)
    tails[:4], words[:4] = 12.0, 3.0
    head = maxent_lm.Head(keys, counts, tails, words, shape)
    assert head.share[:2].tolist() == [1.0, 1.0] and head.share[2:].sum() == 1
    # in a tail class: known words with (count + 1), one slot for the unknown
    assert head.tail_size[5] == 6 + 2 + 1
    z = maxent_lm.log_softmax(np.zeros((24, shape.classes), np.float32), head.bias, np.zeros((3, 5), np.int32))
    assert np.exp(z).sum(1) == pytest.approx(1, abs=1e-5)


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    shape = maxent_lm.Shape(buckets=16)
    rows, target = rng.integers(0, 48, (3, 512)).astype(np.int32), rng.integers(0, shape.classes, 512)
    w, b = np.zeros((48, shape.classes), np.float32), np.zeros(shape.classes, np.float32)
    gw, gb = np.zeros_like(w), np.zeros_like(b)

    def loss():
        return -maxent_lm.log_softmax(w, b, rows)[np.arange(512), target].mean()

    first = loss()
    for _ in range(20):
        maxent_lm._step(w, b, gw, gb, rows, target, 0.25)
    assert loss() < first


def test_packs_give_back_the_tokens_of_their_texts():
    rng = np.random.default_rng(4)
    texts = [b"", b" ", b"one", b"A a\x0bB", *(" ".join(f"w{x}" for x in rng.zipf(1.3, 70_000) % 4000).encode() for _ in range(6)), b""]
    data, offsets = b"".join(texts), np.cumsum([0, *map(len, texts)])
    row = maxent_lm.token_columns(data, offsets)
    pack = maxent_lm.Tokens(row | {"pack_id": 5, "ids": [*range(len(texts) - 1), None]})
    keys, owner = maxent_lm.tokens(np.frombuffer(data, np.uint8), offsets)
    assert (np.diff(pack.names.astype(object)) > 0).all()
    assert (pack.names[pack.index] == keys).all() and (pack.owner == owner).all()
    assert row["n_words"] == len(keys) - len(texts)
    names, counts = pack.counts()
    held = np.array([maxent_lm.held_out(i) for i in pack.ids])[owner]
    assert dict(zip(names.tolist(), counts.tolist(), strict=True)) == dict.fromkeys(keys.tolist(), 0) | Counter(keys[~held].tolist())
    last = np.append(pack.names, maxent_lm._NONE)[pack.before(2)]
    assert last.tolist() == [keys[i - 2] if i > 1 and owner[i - 2] == owner[i] else maxent_lm._NONE for i in range(len(keys))]


def test_later_steps_read_tokens_and_no_texts(sample, monkeypatch):
    """Texts are cut and hashed once, when packs are written."""
    made, packed = [], maxent_lm.pk.packed
    monkeypatch.setattr(maxent_lm.pk, "packed", lambda *args, **more: made.append(packed(*args, **more)) or made[-1])
    docs = sample.select("doc_id", "text")
    plan = maxent_lm.score_texts(docs)
    (packs,) = made
    assert "data" not in packs.columns and "ranks" in packs.columns
    tokens = sum(len(maxent_lm.Tokens(r.asDict(True)).index) for r in packs.collect())
    assert tokens == plan.selectExpr("sum(n_tokens)").first()[0]


@pytest.mark.parametrize("n", [1, 2, 7, 8192])
def test_sums_of_equal_rows(n):
    rng = np.random.default_rng(n)
    for rows in (rng.integers(0, 9, n), rng.integers(0, 1 << 20, n), np.full(n, 3), np.minimum(rng.zipf(1.2, n), 4000)):
        values = rng.integers(-99, 99, (n, 5)).astype(np.float32)
        want = np.zeros((rows.max() + 1, 5))
        np.add.at(want, rows, values)
        at, sums = maxent_lm.row_sums(values, rows)
        assert at.tolist() == np.unique(rows).tolist() and (sums == want[at]).all()


def test_chance_of_one_class():
    rng = np.random.default_rng(6)
    weights, bias, rows = rng.normal(0, 20, (48, 9)).astype(np.float32), rng.normal(size=9).astype(np.float32), rng.integers(0, 48, (3, 400))
    target = rng.integers(0, 9, 400)
    assert maxent_lm.log_chance(weights, bias, rows, target) == pytest.approx(maxent_lm.log_softmax(weights, bias, rows)[np.arange(400), target], abs=1e-4)
