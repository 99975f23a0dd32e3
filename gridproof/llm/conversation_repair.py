"""Repair of damaged conversations by the cheapest edits, found by iterative-deepening A*.

Turns are reduced to one code each: class of the role and first fault.  Codes
are sorted over the whole table by (conversation, turn) and cut into pieces of at
most PIECE turns, so a conversation of any length spreads over tasks.  A piece
that is a whole conversation is repaired at once.  Any other piece is repaired
for each pair of states of the grammar in which it can be entered and left; the
results, a few bytes a turn, are put together in order.  That is exact: of two
edit sequences of equal cost over the same turns to the same state neither is
the beginning of the other, as more edits would cost more, so the ASCII-least
sequence of a whole is made of ASCII-least sequences of its pieces.

Texts travel once, to the row of their conversation, which is the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 256
#: Costs of the edits, and of a truncated turn that stays.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 4, 3, 0, 3, 3
#: Classes of roles by their initial, and faults; a code is 4 * class + fault.
SYSTEM, USER, ASSISTANT, OTHER, NONE = range(5)
SOUND, CUT, BLANK, DUPLICATE = range(4)
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

#: Grammar s?(ua)+ or nothing.  States: nothing yet, after s, after u, after a.
_ACCEPT = (0, 3)
_NEXT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2} | {(q, NONE): q for q in range(4)}
#: The only role that an insertion or a change of role can bring in each state, and the state after it.
_WANTED = ("user", "user", "assistant", "user")
_AFTER = (2, 2, 3, 2)

_WHITE = " \t\n\v\f\r"


def estimates(codes: Sequence[int], leave: Sequence[int]) -> list[int]:
    """For each turn a lower bound of the cost of the turns from it on.

    Blank and repeated turns must go, and a truncated one costs 3 at least.
    Beyond that, in disjoint pairs of neighbours that the grammar forbids, one of
    both is changed or deleted or something is inserted between: 3, or 1 where one
    is truncated, as its deletion costs 1 more than its fault.  Where the piece is
    left before any user turn, all but one system turn go.
    """
    n, early = len(codes), all(q < 2 for q in leave)
    bound, system = [0] * (n + 1), 0
    single, pair, last = 0, 0, None  # best over disjoint pairs from the last turn on, from the one after it, and that turn
    base = 0
    for i in range(n - 1, -1, -1):
        role, fault = divmod(codes[i], 4)
        if fault in (BLANK, DUPLICATE):
            base += DELETE
        elif early:
            base += (TRUNCATED if fault == CUT else 0) if role == NONE else DELETE
            system |= role == SYSTEM
        else:
            base += TRUNCATED if fault == CUT else 0
            weight = 0
            if last is not None and NONE not in (role, last[0]) and (role, last[0]) not in _LEGAL:
                weight = 1 if CUT in (fault, last[1]) else 3
            single, pair = max(single, pair + weight), single
            last = (role, fault)
        bound[i] = base + single - (DELETE if early and system and 1 in leave else 0)
    return bound


def cheapest(codes: Sequence[int], enter: int = 0, leave: Sequence[int] = _ACCEPT) -> tuple[int, str]:
    """(cost, edits) of the ASCII-least cheapest edits that lead from one state to one of others.

    Depth first in the order D, I, K, R under a cost bound, which rises to the least
    estimate beyond it.  A state that failed with some budget isn't tried
    again with that or less.  The first path that ends well is the answer.
    """
    n, least = len(codes), estimates(codes, leave)
    limit = least[0] if n else 0
    while True:
        failed: dict[int, int] = {}
        beyond = None
        path: list[str] = []
        stack = [(0, enter, 0, 0)]
        while stack:
            at, state, cost, option = stack.pop()
            if not option:
                if cost + least[at] > limit:
                    beyond = cost + least[at] if beyond is None else min(beyond, cost + least[at])
                    path and path.pop()
                    continue
                if at == n and state in leave:
                    return cost, "".join(path)
                if failed.get(4 * at + state, -1) >= limit - cost:
                    path and path.pop()
                    continue
            role, fault = divmod(codes[at], 4) if at < n else (NONE, BLANK)
            stays = at < n and fault in (SOUND, CUT)
            extra = TRUNCATED if fault == CUT else 0
            if option < 1 and at < n:
                step = (1, "D", (at + 1, state, cost + DELETE, 0))
            elif option < 2:
                step = (2, "I", (at, _AFTER[state], cost + INSERT, 0))
            elif option < 3 and stays and (state, role) in _NEXT:
                step = (3, "K", (at + 1, _NEXT[state, role], cost + KEEP + extra, 0))
            elif option < 4 and stays:
                step = (4, "R", (at + 1, _AFTER[state], cost + REROLE + extra, 0))
            else:
                failed[4 * at + state] = max(failed.get(4 * at + state, -1), limit - cost)
                path and path.pop()
                continue
            stack.append((at, state, cost, step[0]))
            path.append(step[1])
            stack.append(step[2])
        limit = beyond


def reachable(codes: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs of states between which any edits of these turns lead."""
    system = any(c in (4 * SYSTEM + SOUND, 4 * SYSTEM + CUT) for c in codes)
    return [(0, 0), (1, 1), *[(0, 1)] * system, *((q, r) for q in range(4) for r in (2, 3))]


_PLAN = "struct<enter:int,leave:int,cost:long,edits:string>"
PIECES = f"conv_id long, at long, n long, illegal long, faults array<long>, first int, last int, low long, high long, first_turn long, last_turn long, turns long, plans array<{_PLAN}>"
_PLAN_ARROW = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
_PIECES_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("illegal", pa.int64()), ("faults", pa.list_(pa.int64())), ("first", pa.int32()), ("last", pa.int32())]
    + [(c, pa.int64()) for c in ("low", "high", "first_turn", "last_turn", "turns")]
    + [("plans", pa.list_(_PLAN_ARROW))]
)


def _piece(conv, at: int, codes: list[int], turns: list, whole: bool) -> dict:
    roles, known = [c // 4 for c in codes], [t for t in turns if t is not None]
    pairs = [(0, -1)] if whole else reachable(codes)
    plans = []
    for enter, leave in pairs:
        cost, edits = cheapest(codes, enter, _ACCEPT if leave < 0 else (leave,))
        plans.append({"enter": enter, "leave": leave, "cost": cost, "edits": edits})
    return {
        "conv_id": conv, "at": at, "n": len(codes), "illegal": sum(p not in _LEGAL for p in zip(roles, roles[1:], strict=False)), "faults": [sum(c % 4 == f for c in codes) for f in (BLANK, DUPLICATE, CUT)], "first": roles[0], "last": roles[-1],
        "low": min(known, default=None), "high": max(known, default=None), "first_turn": turns[0], "last_turn": turns[-1], "turns": len(set(known)), "plans": plans,
    }


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES from sorted (conv_id, turn, code, more, n): a turn and n - 1 further copies of it with the code ``more``."""
    part, number = TaskContext.get().partitionId() << 33, 0
    conv, codes, turns = None, [], []
    started = False  # whether the piece at hand surely starts its conversation

    def done(whole: bool):
        nonlocal number, codes, turns
        number += 1
        row = _piece(conv, part + number, codes, turns, whole)
        codes, turns = [], []
        return row

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if codes and row["conv_id"] != conv:
                out.append(done(started))
                started = True
            conv = row["conv_id"]
            for code in [row["code"]] if row["n"] == 1 else [row["code"], *[row["more"]] * (row["n"] - 1)]:
                if len(codes) == most:
                    out.append(done(False))
                    started = False
                codes.append(code)
                turns.append(row["turn"])
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECES_ARROW)
    if codes:
        yield pa.RecordBatch.from_pylist([done(False)], _PIECES_ARROW)


def put_together(pieces: list[dict]) -> dict:
    """Cost, edits and counts of a conversation from its pieces in order."""
    best, illegal, distinct, before = {0: (0, "")}, 0, 0, None
    for p in pieces:
        if p["plans"][0]["leave"] < 0:
            best = {0: (p["plans"][0]["cost"], p["plans"][0]["edits"])}
        else:
            ways: dict[int, tuple[int, list]] = {}
            for plan in p["plans"]:
                if plan["enter"] in best:
                    way = (best[plan["enter"]][0] + plan["cost"], best[plan["enter"]][1] + plan["edits"])
                    ways[plan["leave"]] = min(way, ways.get(plan["leave"], way))
            best = ways
        illegal += p["illegal"] + (before is not None and (before["last"], p["first"]) not in _LEGAL)
        distinct += p["turns"] - (before is not None and p["first_turn"] is not None and before["last_turn"] == p["first_turn"])
        before = p
    cost, edits = min(best[q] for q in _ACCEPT if q in best)
    low, high = (f((p[c] for p in pieces if p[c] is not None), default=None) for f, c in ((min, "low"), (max, "high")))
    return {
        "cost": cost, "edits": edits, "gaps": 0 if low is None else high - low + 1 - distinct, "illegal": illegal,
        **{name: sum(p["faults"][k] for p in pieces) for k, name in enumerate(("blank", "duplicate", "truncated"))},
    }


def repaired(messages: list[dict], edits: str) -> list[dict]:
    """The messages that the edits leave, with the roles that they give."""
    out, state, at = [], 0, 0
    for e in edits:
        if e in "IR":
            out.append({"role": _WANTED[state], "text": "" if e == "I" else messages[at]["text"]})
            state = _AFTER[state]
        elif e == "K":
            out.append({"role": messages[at]["role"], "text": messages[at]["text"]})
            state = _NEXT[state, _class(messages[at]["role"])]
        at += e != "I"
    return out


def _class(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT, "": NONE}.get(role[:1], OTHER)


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, edits string, messages array<struct<role:string,text:string>>"
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPAIRED_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("edits", pa.string()), ("messages", _MESSAGES)])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            told = put_together(row["pieces"]) if row["pieces"] else dict.fromkeys(_COUNTS, 0) | {"edits": ""}
            out.append({"conv_id": row["conv_id"], **told, "messages": repaired(row["messages"], told["edits"])})
        yield pa.RecordBatch.from_pylist(out, _REPAIRED_ARROW)


def _code(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).when(initial == "", NONE).otherwise(OTHER)
    return (4 * kind + fault).cast("int")


def repair(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """Each conversation of (conv_id, turn, role, text) with its faults, its cheapest edits and the messages that they leave.

    Turns go by turn, nulls first; ties by a hash of role and text.  A turn's first
    fault counts: blank (no text but white space), duplicate (role and text seen
    earlier), truncated (the last other character is none of ``.!?``).  Edits are
    letters, a turn or insertion each: D deletes (4; a must for blank and duplicate
    turns), I inserts an empty user or assistant turn (3), K keeps (0), R sets the
    role to user or assistant (3); a truncated turn that stays costs 3 more.  They
    make the initials of the roles ``(s?(ua)+)?``; of the cheapest the ASCII-least counts.

    Columns: conv_id, gaps (turn numbers missing between least and greatest), blank,
    duplicate, truncated, illegal (neighbouring initials other than su, ua, au), cost,
    edits, messages (role, text).

    Nulls: null role or text is one space; null turns come first and make no gap; the
    null conv_id is a conversation.  Repeated rows are duplicates.  A row whose
    ``dropped`` is true, where there is such a column, is no turn, but its
    conversation is listed.  An empty role has no initial and fits anywhere.  A
    conversation's messages stand in one row, so they must be below 2 GB.  Empty
    input gives no rows; other columns are ignored.
    """
    gone = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("dropped"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))))
    end = F.substring(F.rtrim("text", F.lit(_WHITE)), -1, 1)
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(CUT)
    # equal turns become one row before the shuffle; all but the first are duplicates, unless blank
    units = rows.where("not dropped").groupBy("conv_id", "turn", "key").agg(F.count("*").alias("n"), F.first(_code(F.col("role"), fault)).alias("own"))
    seen = units.groupBy("conv_id", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))).alias("first"), F.count("*").alias("_k")).where("_k > 1")
    seen = seen.select(F.col("conv_id").alias("_c"), F.col("key").alias("_key"), "first")
    more = F.when(F.col("own") % 4 == BLANK, F.col("own")).otherwise(F.col("own") - F.col("own") % 4 + DUPLICATE)
    later = F.col("first").isNotNull() & (F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")) != F.col("first"))
    coded = units.join(seen, F.expr("conv_id <=> _c") & (F.col("key") == F.col("_key")), "left")
    coded = coded.select("conv_id", "turn", "key", F.when(later, more).otherwise(F.col("own")).alias("code"), more.alias("more"), "n")
    ordered = coded.sort(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "key").select("conv_id", "turn", "code", "more", "n")
    pieces = ordered.mapInArrow(lambda batches: _pieces(batches, piece), PIECES)
    names = [c for c in pieces.columns if c not in ("conv_id", "at")]
    planned = pieces.select("conv_id", F.struct("at", *names).alias("piece"), F.lit(None).cast("struct<known:boolean,turn:bigint,key:binary,role:string,text:string>").alias("message"))
    message = F.when(~F.col("dropped"), F.struct(F.col("turn").isNotNull().alias("known"), "turn", "key", "role", "text"))
    told = rows.select("conv_id", F.lit(None).cast(planned.schema["piece"].dataType).alias("piece"), message.alias("message"))
    # one shuffle brings texts and plans of a conversation together; no row is null in both columns but dropped ones
    every = told.unionByName(planned).groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.sort_array(F.collect_list("message")).alias("messages"))
    return every.mapInArrow(_apply, REPAIRED)


def with_damage(conversations: DataFrame) -> DataFrame:
    """Test damage by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it a user's.

    Nulls are one space.  Dropped rows stay, marked ``dropped``.
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("h") == 0).alias("dropped"), F.when(F.col("h") == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("_", "n")


def digest(found: DataFrame) -> DataFrame:
    """conv_id, the counts, the edits and a hash of the repaired conversation."""
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    return found.select("conv_id", *_COUNTS[:-1], "cost", F.col("edits").alias("audit"), F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
