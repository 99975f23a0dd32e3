"""Periodic runs of words: suffix trees, constant-time extensions, Lyndon roots.

A run is a stretch of words with smallest period q, at least ``times`` periods
and ``least`` words long, that no neighbouring word extends.

Each stretch of a document that can hold a run is handled alone:

1. Ukkonen's construction makes the suffix trees of the stretch and of its
   reversal.  A walk around the tree gives the leaves in order and, between
   neighbours, the depth of their lowest common ancestor; the least of a range of
   these, from a table of ranges of powers of two, is the common extension of
   two places in constant time.
2. The longest Lyndon word from each place, under the order of the words and under
   its reverse, ends where the next smaller suffix starts.  Each run has such a
   word as its root, so these words are all candidates.
3. A candidate is extended to the right by the tree of the stretch and to the left
   by the tree of the reversal; it is a run if it is long enough.

Which stretches can hold a run is found for many documents at once: a run's first
``least * (times - 1) / times`` words are met again one period later, and so
are all its windows of that size up to a period before its end.

Documents are independent: nothing is shuffled, and a task holds one batch of
documents and the trees of one stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridproof.llm import textops

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("kept", pa.binary())])


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
    """Ukkonen's suffix tree of ``s``, whose last symbol is met nowhere else: label starts, label stops, children (None at leaves); node 0 is the root."""
    n = len(s)
    start, stop, link, child = [0], [0], [0], [{}]
    node = edge = length = rest = 0
    for i, c in enumerate(s):
        rest += 1
        last = 0
        while rest:
            if not length:
                edge = i
            kids = child[node]
            down = kids.get(s[edge])
            if down is None:
                kids[s[edge]] = len(start)
                start.append(i)
                stop.append(n)
                link.append(0)
                child.append(None)
                if last:
                    link[last] = node
                    last = 0
            else:
                size = min(stop[down], i + 1) - start[down]
                if length >= size:
                    node = down
                    edge += size
                    length -= size
                    continue
                if s[start[down] + length] == c:
                    if last:
                        link[last] = node
                    length += 1
                    break
                split = len(start)
                kids[s[edge]] = split
                start += (start[down], i)
                stop += (start[down] + length, n)
                link += (0, 0)
                start[down] += length
                child.append({c: split + 1, s[start[down]]: down})
                child.append(None)
                if last:
                    link[last] = split
                last = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return start, stop, child


def leaves(tree: tuple[list[int], list[int], list[dict | None]], reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each the depth of its lowest common ancestor with the one before.

    Children go by symbol, or by falling symbol; symbol 0, the end, comes first either way.
    """
    start, stop, child = tree
    n = stop[1] if len(stop) > 1 else 0
    order, meet = [], []
    stack = [(0, 0, 0)]
    while stack:
        node, above, shared = stack.pop()
        kids = child[node]
        depth = above + stop[node] - start[node]
        if kids is None:
            order.append(n - depth)
            meet.append(shared)
            continue
        # the last one is visited first
        names = sorted(kids, reverse=not reverse)
        if reverse and 0 in kids:
            names.remove(0)
            names.append(0)
        stack += [(kids[c], depth, depth) for c in names[:-1]]
        stack.append((kids[names[-1]], depth, shared))
    return np.array(order, np.int64), np.array(meet, np.int64)


class Extensions:
    """Longest common extensions of pairs of places, by least values of ranges."""

    def __init__(self, order: np.ndarray, meet: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [meet.astype(np.int32)]
        while 2 ** len(self.table) <= len(meet):
            t, half = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common start of the suffixes at a and b, for a != b."""
        ra, rb = self.rank[a], self.rank[b]
        lo, hi = np.minimum(ra, rb) + 1, np.maximum(ra, rb) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - 2**k])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one with a smaller suffix; the last place is the end."""
    out, stack = [0] * len(rank), []
    for i in range(len(rank) - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1] if stack else i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """All runs (start, length, period) of a sequence of numbers, by start, then period."""
    n = len(symbols)
    if n < max(least, times):
        return np.zeros((0, 3), np.int64)
    s = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree = suffix_tree([*s, 0])
    order, meet = leaves(tree)
    right = Extensions(order, meet)
    falling = np.empty(n + 1, np.int64)
    falling[leaves(tree, True)[0]] = np.arange(n + 1)
    del tree
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(right.rank.tolist())[:n], next_smaller(falling.tolist())[:n]])
    fits = (j - i) * times <= n
    i, j = i[fits], j[fits]
    stop = j + right.of(i, j)
    # enough room only where the left part can make up the rest
    fits = (stop >= times * (j - i)) & (stop >= least)
    i, j, stop = i[fits], j[fits], stop[fits]
    left = Extensions(*leaves(suffix_tree([*s[::-1], 0])))
    start = i - left.of(n - i, n - j)
    length, period = stop - start, j - i
    good = (length >= least) & (length >= times * period)
    return np.unique(np.stack([start[good], length[good], period[good]], 1), axis=0)


def stretches(words: np.ndarray, doc: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Ranges of words outside which no run of a document has a word; words are numbers that tell equal ones of a document.

    Windows of ``k`` words of a run up to a period before its end are met again at
    most a period q later, and there are at least (times - 1) * q - k + 1 of them.
    So a window is of no use if it isn't met again, or only further on than
    its streak of windows that are met again allows.
    """
    k = max(1, least * (times - 1) // times)
    h, size = textops.mix(words.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 1
    if len(h) < k:
        return []
    out, at, n = np.zeros(len(h) - k + 1, np.uint64), 0, len(h) - k + 1
    while size <= k:
        if k & size:
            out, at = textops.mix(out) * np.uint64(0x9E3779B97F4A7C15) + h[at : at + n], at + size
        h, size = textops.mix(h[:-size], size) * np.uint64(0x9E3779B97F4A7C15) + h[size:], 2 * size
    own = np.flatnonzero(doc[:n] == doc[k - 1 :])
    order = own[np.argsort(out[own], kind="stable")]
    again = np.flatnonzero((out[order[1:]] == out[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]))
    gap = np.zeros(n + 1, np.int64)
    gap[order[again]] = order[again + 1] - order[again]
    met = gap > 0
    # windows of different documents never touch in one streak, as the last words of a document start none
    turn = np.flatnonzero(np.diff(np.concatenate([[False], met]).astype(np.int8)))
    streak, each = np.zeros(n + 1, np.int64), turn[1::2] - turn[::2]
    streak[met] = np.repeat(each, each)
    use = np.flatnonzero(met & (gap * (times - 1) <= streak + k - 1))
    if not len(use):
        return []
    lo, hi = use, use + gap[use] + k
    reach = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] >= reach[:-1]])
    return list(zip(lo[new].tolist(), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])].tolist(), strict=True))


def _found(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textops.column_bytes(batch.column(1))
        ids = batch.column(0).to_pylist()
        for a, b in textops.slices(offsets):
            texts = [data[offsets[d] : offsets[d + 1]].tobytes().split() for d in range(a, b)]
            numbers: dict[bytes, int] = {}
            words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
            at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            doc = np.repeat(np.arange(len(texts)), np.diff(at))
            runs: list[list[np.ndarray]] = [[] for _ in texts]
            for lo, hi in stretches(words, doc, least, times):
                found = runs_of(words[lo:hi], least, times)
                if len(found):
                    runs[doc[lo]].append(found + np.array([lo - at[doc[lo]], 0, 0]))
            out = []
            for d, (t, r) in enumerate(zip(texts, runs, strict=True)):
                rows, kept = [], t
                if r:
                    every = np.concatenate(r)
                    edge = np.zeros(len(t) + 1, np.int64)
                    np.add.at(edge, every[:, 0] + every[:, 2], 1)
                    np.add.at(edge, every[:, 0] + every[:, 1], -1)
                    kept = [w for w, gone in zip(t, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone]
                    rows = [{"start": x, "length": y, "period": z} for x, y, z in every.tolist()]
                out.append({"doc_id": ids[a + d], "n_words": len(t), "runs": rows, "kept": b" ".join(kept)})
            yield pa.RecordBatch.from_pylist(out, _ARROW)


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """The periodic runs of each document's words, and its text without the repeats in them.

    Columns: doc_id, n_words, runs (start, length, period; numbered from word 0, by
    start, then period), kept (the words that no run contains after its first
    period, joined by one space; UTF-8).

    Nulls: a null text has no words and no runs; a null doc_id is kept.  Repeated
    rows are documents of their own.  A text has to fit a task's memory, at some
    hundred bytes for each word of a stretch that can hold a run.  Empty input
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _found(batches, least, times), SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Test damage: (doc_id, text) where documents whose crc32 is divisible by ten repeat a part of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    hit = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
    n = F.size("_words")
    a = (F.col("_g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    hit = hit.withColumns({"_n": n, "_a": F.when(n > 0, a), "_p": F.when(n > 0, p)})
    # no function of each word: Spark could work out the words again for each
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int"))), F.lit(1), F.col("_n") - F.col("_a"))
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")
    return hit.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with most periods, and hashes of all runs and of the words left."""

    def before(x: Column, y: Column) -> Column:
        more, less = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(more > less, -1).when(more < less, 1).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int"))

    best = F.get(F.array_sort("runs", before), F.lit(0))
    line = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    runs = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    out = found.withColumn("_best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(runs.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
