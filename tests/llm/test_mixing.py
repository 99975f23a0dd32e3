"""Targets by repeated sharing, what is taken, and the tree."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from gridproof.llm import mixing


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 2.0 * sizes[s] for s in over}


def plan(df):
    return mixing.mix_plan(df).taken().collect()


def rows_of(n=300):
    return [(k, " ".join(["w"] * (1 + k * 37 % 50)), ("a", "é", "b", None, "Z")[0 if k % 3 == 0 else k % 5]) for k in range(n)]


def test_targets_and_taken(documents):
    rows = rows_of()
    got = plan(documents(rows))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = expected_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken % r.size == 0 and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 50 for s in sizes)


def test_reruns_agree(documents):
    rows = rows_of(200)
    assert sorted(map(str, plan(documents(rows)))) == sorted(map(str, plan(documents(rows[::-1]).repartition(7))))


def test_odd_rows(documents, odd):
    got = plan(documents([*odd, (40, "a b", None)]))
    assert len(got) == len(odd) + 1
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert plan(documents([])) == []
    assert [r.taken for r in plan(documents([(1, None), (2, " ")]))] == [0, 0]


def test_one_source_is_all(documents):
    got = plan(documents([(k, "x y z") for k in range(1000)]))
    assert sum(r.taken for r in got) == pytest.approx(4500, abs=3)
    assert {r.target for r in got} == {4500.0}


def test_tree_keeps_quotas():
    units = np.array([1000, 0, 37, 500])
    out = mixing.split_tree(units, 6, 3)
    assert (out.sum(0) == units).all() and out.sum(1).max() - out.sum(1).min() <= 1
    assert (out == mixing.split_tree(units, 6, 3)).all()
    # each shard's share of a source is near the whole's
    assert abs(out[:, 0] - 1000 / 6).max() < 60


def test_mixed_rows_are_the_plan(documents):
    rows = rows_of(2000)
    df = documents(rows)
    mix = mixing.mix_plan(df, block_docs=20)
    out = mix.mixed(4).select("doc_id", "copy", "shard", "n", "lang").collect()
    copies = Counter(r.doc_id for r in out)
    assert copies == {r.doc_id: r.taken // r.size for r in mix.taken().collect() if r.taken}
    assert len({(r.doc_id, r.copy) for r in out}) == len(out)
    assert {r.shard for r in out} == {0, 1, 2, 3}
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) < 1.3 * min(sizes.values())


def test_repeated_rows(documents):
    rows = [(1, "a b c"), (1, "a b c"), (2, "d e")] * 3
    mix = mixing.mix_plan(documents(rows))
    assert len(mix.taken().collect()) == 9
    assert mix.mixed(2).count() >= 9


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 9, 14, 31, 63, 64, 126, 1000])
def test_permutation_is_one_and_is_none_of_the_plain_ones(n):
    every = np.arange(n)
    got = mixing.permuted(every, n, 5)
    assert sorted(got) == every.tolist()
    if n > 10:
        assert (got != every).mean() > 0.5 and (got != every[::-1]).mean() > 0.5
        # neighbours don't stay neighbours
        assert (np.abs(np.diff(got)) == 1).mean() < 0.3
        assert (got != mixing.permuted(every, n, 6)).any()


def test_shards_draw_disjoint_blocks_and_all_of_them(documents):
    mix = mixing.mix_plan(documents(rows_of(900)), block_docs=10)
    draws = [(r.source, r.copy, r["rank"], r.shard) for r in mix.draws(7).collect()]
    units = [d[:3] for d in draws]
    assert len(set(units)) == len(units)
    plan = {r.source: r for r in mix.plan.collect()}
    for source, r in plan.items():
        full = {(c, b) for s, c, b in units if s == source and c <= r.full}
        assert full == {(c + 1, b) for c in range(r.full) for b in range(r.n_blocks)}
    # exact quotas: what the tree's leaves say
    counts = Counter(d[0] for d in draws)
    names = sorted(plan, key=lambda s: (s is None, (s or "").encode()))
    tree = mixing.split_tree(np.array([counts[s] for s in names]), 7, mix.seed)
    assert all(Counter(d[3] for d in draws if d[0] == s) == {k: int(v) for k, v in enumerate(tree[:, j]) if v} for j, s in enumerate(names))


def test_taken_comes_from_the_draws(documents, monkeypatch):
    df = documents(rows_of(100))
    whole = sorted(map(str, mixing.mix_plan(df).taken(3).collect()))
    assert whole == sorted(map(str, mixing.mix_plan(df).taken(5).collect()))
    draws = mixing.Mix.draws
    monkeypatch.setattr(mixing.Mix, "draws", lambda self, shards=None: draws(self, shards).limit(0))
    assert sum(r.taken for r in mixing.mix_plan(df).taken().collect()) == 0


def test_query_columns(spark):
    from gridproof.llm.queries import op4_mixing

    assert op4_mixing(spark, "/root/testdata/sf0.001").columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
