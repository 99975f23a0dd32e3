"""Components by exact Jaccard, against brute force."""

import random

from gridproof.llm import ngram_join
from gridproof.llm.components import connected


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k, (i, s) in enumerate(sets):
        groups.setdefault(find(k), []).append((i, len(s)))
    out = []
    for members in groups.values():
        known = [i for i, _ in members if i is not None]
        out += [(i, n, min(known) if known else None) for i, n in members]
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()), key=str)


def test_random_edits_of_few_bases(documents):
    rng = random.Random(1)
    rows = []
    for k in range(150):
        words = [f"b{k % 4}w{j}" for j in range(rng.choice([30, 40, 60]))]
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(6)}"
        if rng.random() < 0.3:
            words = words[: rng.randrange(3, len(words))]
        rows.append((k, " ".join(words)))
    assert run(documents(rows)) == brute(rows)


def test_one_large_group_of_near_copies(documents):
    """Around one base, most linked with it and some only with each other."""
    rng = random.Random(2)
    rows = []
    for k in range(200):
        words = [f"w{j}" for j in range(100)]
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(100)] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    assert run(documents(rows)) == brute(rows)


def test_shared_passage_links_nothing(documents):
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(k, f"{passage} " + " ".join(f"d{k}w{j}" for j in range(60))) for k in range(60)]
    assert all(r[0] == r[2] for r in run(documents(rows)))


def test_odd_rows(documents, odd):
    assert run(documents(odd)) == brute(odd)


def test_threshold_is_met_exactly(documents):
    base = [f"w{k}" for k in range(22)]
    # 18 shingles, of which 16 are shared with a text cut by two words: 16 / 18, and 14.4 / 18 needed
    rows = [(1, " ".join(base)), (2, " ".join(base[:20])), (3, " ".join(base[:18])), (4, " ".join(base[:8]))]
    assert run(documents(rows)) == brute(rows)


def test_empty_table(documents):
    assert run(documents([])) == []


def test_keep_one_keeps_columns_and_rows_without_words(documents, odd):
    df = documents(odd)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, None, None, 7, 8, 10, 11, 12], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(50, 90)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 1 for k in (1, *range(50, 90))}


def test_keep_one_goes_by_row_not_by_id(documents):
    words = [f"w{k}" for k in range(40)]
    near = " ".join(["x", *words[1:]])
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(1, " ".join(words)), (1, other), (1, other), (2, near), (None, near), (None, "a text of its own")]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(documents(rows)).collect()), key=str)
    assert kept == sorted([(1, " ".join(words)), (1, other), (None, "a text of its own")], key=str)


def test_the_product_drops_what_the_bounds_exclude(spark):
    """Overlaps are summed over all blocks; a pair below the bound goes and one at it stays."""
    def row(name, columns):
        blocks = [[c for c in columns if c % 8 in own] for own in ((0,), (1, 2), (3, 4, 5, 6, 7))]
        return (bytearray(name), len(columns), len(columns), *blocks)

    sets = spark.createDataFrame([row(b"a", list(range(18))), row(b"b", list(range(2, 20))), row(b"c", list(range(3, 21)))], "sig binary, n long, met long, b0 array<long>, b1 array<long>, b2 array<long>")
    pairs = spark.createDataFrame([(bytearray(b"a"), bytearray(b"b")), (bytearray(b"a"), bytearray(b"c"))], "u binary, v binary")
    assert [(bytes(r.u), bytes(r.v)) for r in ngram_join._product(pairs, sets, 80).collect()] == [(b"a", b"b")]


def test_hot_keys_are_joined_without_a_shuffle(spark):
    from gridproof.llm.hot import hot_keys, join_hot

    rows = spark.range(1000).selectExpr("if(id < 600, 0, id) as k", "id")
    counts = rows.groupBy("k").count()
    hot = hot_keys(counts, "k", "count", 1000)
    assert hot == [0]
    table = counts.selectExpr("k", "k * 2 as twice").where("k <> 700")
    for how in ("inner", "left", "left_semi"):
        got, want = (sorted(map(tuple, df.collect()), key=str) for df in (join_hot(rows, table, "k", hot, how), rows.join(table, "k", how)))
        assert got == want


def test_rows_without_a_possible_partner_are_not_dealt_out(spark):
    """A shared passage too short to link pages of 100 shingles: no row has either role, so no pair is made."""
    cells = spark.range(500).selectExpr("cast(cast(id as string) as binary) as sig", "cast(cast(id as string) as binary) as root", "100L as n", "85L as room", "7L as shingle")
    small, large = ngram_join._roles(cells, 80)
    # a partner has 91 columns at most, so pages of 100 can only be the larger of a pair
    assert small.count() == 0
    assert ngram_join._meeting(cells, 80).count() == 0
    assert large.select("sig").distinct().count() == 500


def test_meeting_is_all_pairs_that_the_bounds_allow(spark):
    rng = random.Random(5)
    rows = [(bytearray(f"{k:03}".encode()), bytearray(f"{k % 37:03}".encode()), n, rng.randrange(n // 2, n + 1), k % 3) for k in range(150) for n in [rng.choice([5, 9, 20, 23, 40, 44, 50, 90, 100, 110])]]
    cells = spark.createDataFrame(rows, "sig binary, root binary, n long, room long, shingle long")
    want = {(bytes(a[0]), bytes(b[0])) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and a[4] == b[4] and 100 * min(a[2], b[2]) >= 80 * max(a[2], b[2]) and 180 * min(a[3], b[3]) >= 80 * (a[2] + b[2])}
    assert want and {(bytes(r.u), bytes(r.v)) for r in ngram_join._meeting(cells, 80).collect()} == want


def test_links_between_classes_join_the_components(documents):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:50], *(f"x{k % 5}y{j}" for j in range(k % 5))])) for k in range(12)] + [(20, "one two three four five six seven")]
    links = [(r.doc_id, r.linked_id) for r in ngram_join.class_links(documents(rows)).collect()]
    nodes = {x for pair in links for x in pair}
    assert nodes == {0, 1, 2, 3, 4} and all(a < b for a, b in links)
    assert {r[2] for r in run(documents(rows))} == {0, 20}
