"""Deleted lines against windows compared one by one."""

import random

from gridproof.llm import line_dedup

BLANK = " \t\n\v\f\r"


def brute(rows, window):
    keyed = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: r[:2])
    seen, gone = set(), {}
    for none, i, t in keyed:
        kept = [(k, x.strip(BLANK)) for k, x in enumerate(t.split("\n")) if x.strip(BLANK)]
        out = set()
        for p in range(max(1, len(kept) - window + 1) if kept else 0):
            part = kept[p : p + window]
            key = (len(kept) < window, *(x for _, x in part))
            if key in seen:
                out |= {k for k, _ in part}
            seen.add(key)
        gone[none, i, t] = out
    result = []
    for i, t in rows:
        if t is None:
            result.append((i, None, 0, 0))
        else:
            g = gone[i is None, i or 0, t]
            lines = t.split("\n")
            result.append((i, "\n".join(x for k, x in enumerate(lines) if k not in g), len(lines), len(g)))
    return sorted(result, key=str)


def run(df, window):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df, window).collect()), key=str)


def test_random_runs(documents):
    rng = random.Random(9)
    for window in (1, 2, 3):
        rows = [(k, "\n".join(rng.choice(["", " ", "a", "b ", "c", "d", f"u{k}{j}"]) for j in range(rng.randrange(1, 14)))) for k in range(60)]
        assert run(documents(rows), window) == brute(rows, window)


def test_odd_rows(documents, odd):
    rows = [*odd, (50, "l1\nl2\nl3"), (51, "x\nl1 \n\n l2\ny"), (52, "l1\nl2\nl3")]
    assert run(documents(rows), 2) == brute(rows, 2)


def test_many_lines(documents):
    lines = [f"line {k}" for k in range(30_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[100:25_000], "end"]))]
    got = {r[0]: r[3] for r in run(documents(rows), 2)}
    assert got == {1: 0, 2: 24_900}


def test_keep_rest_drops_emptied_texts_only(documents):
    df = documents([(1, "a\nb"), (2, "a\nb"), (3, ""), (4, None), (5, "a\nb\nc")])
    kept = line_dedup.keep_rest(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect() if r.text is not None) == [(1, "a\nb", 3), (3, "", 0), (5, "c", 1)]
    assert kept.where("text is null").count() == 1


def test_empty_table_and_own_names(documents):
    from pyspark.sql import functions as F

    assert run(documents([]), 2) == []
    df = documents([(1, "a\nb")]).withColumn("n_lines", F.lit("mine"))
    assert line_dedup.dedup_lines(df).first().n_lines == 2
    assert line_dedup.keep_rest(df).first().n_lines == "mine"
    assert "Python" not in line_dedup.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()


def brute_with_lines(rows, window, words):
    """As brute(), and every line of so many words against all lines before it."""
    seen, gone = set(), {}
    for none, i, t in sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: r[:2]):
        kept = [(k, x.strip(BLANK)) for k, x in enumerate(t.split("\n")) if x.strip(BLANK)]
        parts = [((len(kept) < window, *(x for _, x in kept[p : p + window])), {k for k, _ in kept[p : p + window]}) for p in range(max(1, len(kept) - window + 1) if kept else 0)]
        parts += [(x, {k}) for k, x in kept if len(x.encode().split()) >= words]
        gone[none, i, t] = set()
        for key, numbers in parts:
            gone[none, i, t] |= numbers if key in seen else set()
            seen.add(key)
    result = []
    for i, t in rows:
        lines, g = [] if t is None else t.split("\n"), gone.get((i is None, i or 0, t), set())
        result.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in g), len(lines), len(g)))
    return sorted(result, key=str)


def test_long_lines_meet_all_lines(documents):
    """Between other neighbours, in documents of one line, and with blanks around; lines of 19 words stay."""
    long, short = " ".join(f"w{k}" for k in range(20)), " ".join(f"v{k}" for k in range(19))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n {long}\t\n\nd"), (3, long), (4, short), (5, f"{short}\ne"), (6, f"{long}\n{long}"), (None, f"f\n{long}\ng"), (7, None)]
    got = run(documents(rows), 2)
    assert got == brute_with_lines(rows, 2, 20)
    assert {r[0]: r[3] for r in got} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 2, None: 1, 7: 0}


def test_random_long_lines(documents):
    rng = random.Random(4)
    pool = [" ".join(f"p{n}w{k}" for k in range(rng.choice([19, 20, 21, 50]))).replace(" ", rng.choice([" ", "  ", " \t"])) for n in range(25)]
    rows = [(k, "\n".join(rng.choice([*pool, f"u{k}{j}", "", "a"]) for j in range(rng.randrange(1, 8)))) for k in range(80)]
    for window in (1, 2, 3):
        assert run(documents(rows), window) == brute_with_lines(rows, window, 20)


def test_both_queries_give_their_sql(spark):
    import duckdb

    from gridproof.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    rows = {}
    for name in ("op9_line_dedup", "op9_long_line_dedup"):
        rows[name] = sorted(tuple(r) for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect())
        assert rows[name] == sorted(con.execute(ORACLE_SQL[name]).fetchall())
    assert sum(r[2] for r in rows["op9_long_line_dedup"]) > sum(r[2] for r in rows["op9_line_dedup"])


def test_selected_lines_are_window_minima_once(documents):
    """Every window has its first least line among the selected ones, no line is selected twice, and not all are."""
    rows = [(1, "\n".join(f"line {k % 37}" for k in range(200)))]
    got = line_dedup.fingerprints(documents(rows), 4, None).collect()
    chosen = {r.pos: r for r in got}
    assert len(chosen) == len(got) < 110
    h = {r.pos - r.at + k: x for r in got for k, x in enumerate(r.h)}
    want = {min(range(s, s + 4), key=lambda k: (h[k], k)) for s in range(197)}
    assert set(chosen) == want
    assert all(r.fingerprint == h[r.pos] for r in got)


def test_a_line_in_most_documents(documents):
    """A fingerprint and a run that are hot take the other way; results agree with brute force."""
    rows = [(k, f"menu\nlogin\nown {k}\nmenu\nend {k % 7}") for k in range(400)]
    assert run(documents(rows), 2) == brute(rows, 2)


def test_without_selection_or_extension_nothing_is_found(documents, monkeypatch):
    df = documents([(1, "a\nb\nc"), (2, "a\nb\nd")])
    assert sum(r[3] for r in run(df, 2)) == 2
    whole = line_dedup.fingerprints
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "fingerprints", lambda *a: whole(*a).limit(0))
        assert sum(r[3] for r in run(df, 2)) == 0
    with monkeypatch.context() as m:
        extended = line_dedup._extended
        m.setattr(line_dedup, "_extended", lambda *a: extended(*a).limit(0))
        assert sum(r[3] for r in run(df, 2)) == 0


def test_keep_rest_drops_what_keeps_too_little(documents):
    """With a least share: a near copy goes, at exactly the share a document stays, one with a long own part stays, untouched and null ones too."""
    lines = [" ".join(f"l{k}w{j}" for j in range(8)) for k in range(10)]
    own = [f"own{k}" for k in range(40)]
    rows = [
        (1, "\n".join(lines)),
        (2, "\n".join([*lines[:9], " ".join(own[:8])])),
        (3, "\n".join([*lines[:4], " ".join(own[:8])])),
        (4, "\n".join([*lines[:4], " ".join(own[:7])])),
        (5, "\n".join([*lines[:4], *own])),
        (6, None),
        (7, ""),
    ]
    df = documents(rows)
    assert sorted(r.doc_id for r in line_dedup.keep_rest(df, least_percent=20).collect()) == [1, 3, 5, 6, 7]
    assert sorted(r.doc_id for r in line_dedup.keep_rest(df).collect()) == [1, 2, 3, 4, 5, 6, 7]
