"""Cheapest edits against all edits of short conversations and a table of costs for long ones; the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from gridproof.llm import conversation_repair as cr
from gridproof.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, n long, key string, code int, piece int"


def initials(codes, edits):
    """(cost, initials) of all ways to read edits, or None where they break a rule."""
    cost, ways, at = 0, [""], 0
    for e in edits:
        if e in "IR":
            ways = [w + r for w in ways for r in "ua"]
        role, fault = divmod(codes[at], 4) if e != "I" else (0, 0)
        if e in "KR" and fault >= cr.BLANK:
            return None
        if e == "K":
            ways = [w + "suao"[role] if role < 4 else w for w in ways]
        cost += {"D": 4, "I": 3, "K": 0, "R": 3}[e] + (3 if e in "KR" and fault == cr.CUT else 0)
        at += e != "I"
    return cost, ways


def every(codes, inserts):
    best = None
    for kinds in itertools.product("DKR", repeat=len(codes)):
        for gaps in itertools.product(range(inserts + 1), repeat=len(codes) + 1):
            if sum(gaps) > inserts:
                continue
            edits = "".join("I" * g + k for g, k in zip(gaps, [*kinds, ""], strict=True))
            got = initials(codes, edits)
            if got and any(re.fullmatch("(s?(ua)+)?", w) for w in got[1]):
                best = min(best or (got[0], edits), (got[0], edits))
    return best


def table(codes, enter=0, leave=(0, 3)):
    """Best (cost, edits) to each state after each turn."""
    best = {enter: (0, "")}
    for c in [*codes, None]:
        for _ in range(4):
            for q, (cost, e) in list(best.items()):
                way = (cost + 3, e + "I")
                best[cr._AFTER[q]] = min(way, best.get(cr._AFTER[q], way))
        if c is None:
            return min((best[q] for q in leave if q in best), default=None)
        role, fault = divmod(c, 4)
        after = {}
        for q, (cost, e) in best.items():
            ways = [(q, (cost + 4, e + "D"))]
            if fault < cr.BLANK:
                more = 3 * (fault == cr.CUT)
                ways.append((cr._AFTER[q], (cost + 3 + more, e + "R")))
                if (q, role) in cr._NEXT:
                    ways.append((cr._NEXT[q, role], (cost + more, e + "K")))
            for r, w in ways:
                after[r] = min(w, after.get(r, w))
        best = after
    return None


def test_short_ones_against_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        codes = [4 * rng.choice([0, 1, 1, 2, 2, 3, 4]) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randrange(5))]
        assert cr.cheapest(codes) == every(codes, 4), codes


def test_long_ones_and_pieces_against_a_table():
    rng = random.Random(2)
    for n in [5, 12, 30, 60]:
        for _ in range(25):
            codes = [4 * rng.choice([1, 2, 1, 2, 0, 3, 4]) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)] if rng.random() < 0.5 else [4 * (1 + k % 2) + rng.choice([0] * 9 + [1, 2, 3]) for k in range(n)]
            assert cr.cheapest(codes) == table(codes)
            if n <= 12:
                for q, r in cr.reachable(codes):
                    assert cr.cheapest(codes, q, (r,)) == table(codes, q, (r,))
                for q, r in set(itertools.product(range(4), range(4))) - set(cr.reachable(codes)):
                    assert table(codes, q, (r,)) is None


def test_estimates_are_lower_bounds():
    rng = random.Random(3)
    for _ in range(200):
        codes = [4 * rng.randrange(5) + rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        for q, r in cr.reachable(codes):
            assert cr.estimates(codes, (r,))[0] <= table(codes, q, (r,))[0]


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def expected(rows):
    convs, left = {r[0] for r in rows}, damaged(rows)
    out = []
    for c in convs:
        own = [r for r in left if r[0] == c]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2]}\0{r[3]}".encode()).digest()))
        seen, codes = set(), []
        for _, _, role, text in own:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            fault = cr.BLANK if not end else cr.DUPLICATE if (role, text) in seen else cr.SOUND if end in ".!?" else cr.CUT
            seen.add((role, text))
            codes.append(4 * cr._class(role) + fault)
        known = [t for _, t, _, _ in own if t is not None]
        cost, audit = table(codes)
        done, at = [], 0
        for e in audit:
            text = "" if e == "I" else own[at][3]
            if e in "IR":
                done.append(("assistant" if "".join(d[0][:1] for d in done).endswith("u") else "user", text))
            if e == "K":
                done.append((own[at][2], text))
            at += e != "I"
        count = lambda f: sum(x % 4 == f for x in codes)  # noqa: E731, B023
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        text = "\n".join(f"{a}:{b}" for a, b in done)
        out.append((c, max(known) - min(known) + 1 - len(set(known)) if known else 0, count(cr.BLANK), count(cr.DUPLICATE), count(cr.CUT), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, piece=cr.PIECE):
    return sorted(map(tuple, cr.digest(cr.repair(cr.with_damage(df), piece)).collect()), key=str)


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("piece", [256, 3])
def test_random_conversations(spark, piece):
    rng = random.Random(piece)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2], rng.choice(["yes.", "no!", "why?", "cut off", " ", "a. b", "end.\n"]) + str(rng.randrange(4)) * (rng.random() < 0.5) + "." * (rng.random() < 0.8)))
    # without ties of turns but for repeats, as the damage repeats rows anyway
    assert got(make(spark, rows), piece) == expected(rows)


@pytest.mark.parametrize("piece", [256, 2])
def test_odd_rows(spark, piece):
    rows = [(None, None, None, None), (None, 1, "user", "x."), (None, 1, "user", "x."), (1, None, "user", "a."), (1, None, "", "b."), (1, 5, "assistant", None), (2, 3, None, "t."), (3, 7, "system", "only system."), (4, -5, "user", "é  "), (4, 9, "assistant", "y" * 100_000 + "!"), (5, 2**62, "user", "z."), (6, 1, "\U0001f600", "q?")]
    rows += [(7, t, "user", "same.") for t in range(40)]
    assert got(make(spark, rows), piece) == expected(rows)
    assert got(make(spark, [])) == []


def test_all_rows_dropped(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert got(make(spark, [(c, 1, "user", "a.")])) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(4)
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t}" + rng.choice(".!?...  ")) for t in range(1500)] + [(2, 1, "user", "a."), (2, 2, "assistant", "b.")]
    assert got(make(spark, rows), 64) == expected(rows)


def test_messages_come_out(spark):
    r = cr.repair(make(spark, [(1, 1, "user", "a."), (1, 2, "user", "b.")])).first()
    assert (r.edits, r.cost, [tuple(m) for m in r.messages]) == ("KR", 3, [("user", "a."), ("assistant", "b.")])


def test_whole_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_conversation_repair(spark, folder).collect()), key=str) == expected(rows)
