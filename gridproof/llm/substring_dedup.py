"""Removal of words covered by a window of words that also starts earlier.

1. Sketch.  Documents are dealt by ranges of doc_id into packs, so the order of
   packs is that of the documents.  Each pack makes its own count-min sketch of
   its windows: for each row of the sketch the touched cells and their counts.
   The sketches are merged by adding cells, one slice of cells to a task.  A row
   has CELLS cells a word of the corpus, so the sketch grows with the corpus
   and its slices do not.
2. Estimate.  A window's estimate is the least of its cells, never below its true
   count.  Only windows estimated at two or more go on; documents without such a
   window are settled.
3. Group.  The windows left are grouped exactly, by 96 bits of hashes over 62-bit
   hashes of words.  Each pack sends a window once; its group's first pack is
   where it starts first.

A window that a third of all documents hold is one cell and one key for each
pack.  Answers return as one byte for each key before compression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm import packs as pk
from gridproof.llm import textops
from gridproof.sources.scratch import written

#: Rows of the sketch, and cells of a row for each word of the corpus.
ROWS, CELLS = 2, 4
PACK_BYTES = 4 << 20
#: Cells, or windows, that one task merges.
KEYS = 2 << 20
SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPAN), ("kept", pa.binary())])
#: Either a settled document (doc_id, n_words, kept), or a pack of the others with a bit for each word that starts a window of the second pass.
_CUT = "settled boolean, doc_id long, n_words long, kept binary, pack_id long, ids array<long>, sizes binary, data binary, open binary"
_CUT_ARROW = pa.schema([("settled", pa.bool_()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.binary()), ("pack_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("data", pa.binary()), ("open", pa.binary())])
_ASKED = pa.schema([("pack_id", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_FOUND = pa.schema([("pack_id", pa.int64()), ("bucket", pa.int32()), ("found", pa.binary())])


def window_hash(words: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Hash of each ``width`` neighbouring hashes, from those of powers of two."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, size, at, out = words, 1, 0, np.full(n, salt, np.uint64)
    while True:
        if width & size:
            out = textops.mix(out, salt) * np.uint64(0x9E3779B97F4A7C15) + part[at : at + n]
            at += size
        if 2 * size > width:
            return textops.mix(out, salt)
        part = textops.mix(part[:-size], size) * np.uint64(0x9E3779B97F4A7C15) + part[size:]
        size *= 2


class Windows:
    """Windows of one pack: the words of each document, and where windows start."""

    def __init__(self, pack: pk.Pack, width: int):
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, data, offsets in pack.slices():
            starts, ends, doc = textops.spans(data, offsets)
            hashes.append(textops.range_hash(textops.prefix_hash(data), starts, ends))
            docs.append(doc + first)
        self.hashes, doc = np.concatenate(hashes), np.concatenate(docs)
        #: First word of each document, and the number of words.
        self.at = np.searchsorted(doc, np.arange(len(pack.ids) + 1), "left")
        self.width = width
        self.starts = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)

    def hash(self, starts: np.ndarray, salt: int) -> np.ndarray:
        return window_hash(self.hashes, self.width, salt)[starts]


def cells(windows: Windows, bits: int) -> np.ndarray:
    """Cell of each window in each row of a sketch of 2**bits cells a row; rows lie one behind the other."""
    h = windows.hash(windows.starts, 1)
    return np.stack([(textops.mix(h, 10 + r) >> np.uint64(64 - bits)) + np.uint64(r << bits) for r in range(ROWS)])


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each distinct pair in order of the pairs, which pair each place holds, whether a place is its pair's first)."""
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    first, of = order[new], np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    leads = np.zeros(len(h), bool)
    leads[first] = True
    return first, of, leads


def _pairs(windows: Windows, open_: np.ndarray):
    """(starts, upper 64 bits, further 32 bits) of the windows of the second pass."""
    starts = windows.starts[open_[windows.starts]]
    return starts, windows.hash(starts, 2), (windows.hash(starts, 3) >> np.uint64(32)).astype(np.uint32)


def _cut(pack: pk.Pack, windows: Windows, open_: np.ndarray):
    sums = np.concatenate([[0], np.cumsum(open_)])
    has = sums[windows.at[1:]] > sums[windows.at[:-1]]
    for d in np.flatnonzero(~has):
        words = pack.data[pack.offsets[d] : pack.offsets[d + 1]].tobytes().split()
        yield {"settled": True, "doc_id": pack.ids[d], "n_words": len(words), "kept": b" ".join(words)}
    if has.any():
        size = np.diff(pack.offsets)
        sizes = np.concatenate([[0], np.cumsum(size[has])]).astype(np.int64)
        own = open_[np.repeat(has, np.diff(windows.at))]
        ids = [i for i, h in zip(pack.ids, has, strict=True) if h]
        yield {"settled": False, "pack_id": pack.pack_id, "ids": ids, "sizes": sizes.tobytes(), "data": pk.squeeze(pack.data[np.repeat(has, size)].tobytes()), "open": pk.squeeze(np.packbits(own).tobytes())}


def _opened(row: dict, width: int) -> tuple[pk.Pack, Windows, np.ndarray]:
    pack = pk.Pack(row)
    windows = Windows(pack, width)
    return pack, windows, np.unpackbits(np.frombuffer(pk.expand(row["open"]), np.uint8), count=len(windows.hashes)).astype(bool)


def _first_pack(asked: DataFrame, parts: int) -> DataFrame:
    """For each key of a pack, whether no pack before it has the key: exact groups, a bucket of keys at a time."""

    def bucket(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pack_id").to_pylist()
        high = np.concatenate([pk.join_keys(r, 64, parts) for r in rows])
        low = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
        leads = distinct(high, low)[2].astype(np.uint8)
        ends = np.cumsum([r["n"] for r in rows])
        found = [pk.squeeze(leads[e - r["n"] : e].tobytes()) for r, e in zip(rows, ends, strict=True)]
        return pa.Table.from_pylist([{"pack_id": r["pack_id"], "bucket": r["bucket"], "found": f} for r, f in zip(rows, found, strict=True)], _FOUND)

    return asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(bucket, "pack_id long, bucket int, found binary")


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """Each document without the words covered by a window of ``width`` words whose words also start a window earlier.

    Earlier is in a document with a smaller doc_id or further up in the same one.
    Windows never cross documents, may overlap, and are judged on the input.
    Columns: doc_id, n_words, spans (maximal removed runs of words, numbered from
    0), kept (the other words, joined by one space; UTF-8).

    Nulls: a null text has no words; rows with a null doc_id come after all others.
    Repeated rows and ties of doc_id are documents of their own, ordered by the
    text's hash, so of two equal rows one keeps its words.  Texts of fewer than
    ``width`` words stay whole.  One text must fit a task's memory, and hold less
    than 2 GB.  Empty input gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    packs = pk.packed(docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order), PACK_BYTES)
    pk.release(spark)
    size = pk.sizes(packs)
    bits = min(62, max(10, (CELLS * size.words).bit_length()))
    tasks = pk.buckets(spark, size.packs, pk.PACKS)

    def sketch(pack: pk.Pack):
        # rows of the sketch follow each other, so the sorted cells of each row, in order, are sorted
        each = [np.unique(row, return_counts=True) for row in cells(Windows(pack, width), bits)]
        return np.concatenate([c for c, _ in each]), np.concatenate([n for _, n in each])

    def twice(totals: np.ndarray) -> np.ndarray:
        return (totals > 1).astype(np.uint8)

    merged = pk.ask(packs, sketch, bits + (ROWS - 1).bit_length(), twice, parts=pk.buckets(spark, size.words * ROWS, KEYS))
    merged = written(merged.select("pack_id", "bucket", "found"))
    pk.release(spark)

    def estimate(pack: pk.Pack, met: np.ndarray):
        windows = Windows(pack, width)
        repeated, used = np.ones(len(windows.starts), bool), 0
        for row in cells(windows, bits):
            own, index = np.unique(row, return_inverse=True)
            repeated &= met[used + index] > 0
            used += len(own)
        open_ = np.zeros(len(windows.hashes), bool)
        open_[windows.starts[repeated]] = True
        yield from _cut(pack, windows, open_)

    left = written(pk.answered(packs, merged, estimate, _CUT, _CUT_ARROW, tasks=tasks))
    pk.discard(packs, merged)
    pk.release(spark)
    cut = left.where("not settled")
    parts = pk.buckets(spark, size.words, KEYS)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pack, windows, open_ = _opened(batch.slice(i, 1).to_pylist()[0], width)
                _, high, low = _pairs(windows, open_)
                first = distinct(high, low)[0]
                at, rows = 0, []
                for row in pk.cut(pack.pack_id, high[first], None, 64, parts):
                    rows.append(row | {"counts": low[first[at : at + row["n"]]].tobytes()})
                    at += row["n"]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ASKED)

    answers = written(_first_pack(cut.mapInArrow(send, pk.ASKED), parts))
    pk.release(spark)

    def finish(row: dict, got: np.ndarray):
        pack, windows, open_ = _opened(row, width)
        starts, high, low = _pairs(windows, open_)
        _, of, leads = distinct(high, low)
        later = starts[~(leads & (got[of] > 0))] if len(starts) else starts
        edge = np.zeros(len(windows.hashes) + 1, np.int32)
        np.add.at(edge, later, 1)
        np.add.at(edge, later + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for d, i in enumerate(pack.ids):
            mask = gone[windows.at[d] : windows.at[d + 1]]
            words = pack.data[pack.offsets[d] : pack.offsets[d + 1]].tobytes().split()
            turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2)
            kept = b" ".join(w for w, g in zip(words, mask.tolist(), strict=True) if not g)
            yield {"doc_id": i, "n_words": len(words), "spans": [{"start": int(a), "stop": int(b)} for a, b in turn], "kept": kept}

    settled = left.where("settled").select("doc_id", "n_words", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"), "kept")
    return pk.met(cut, answers, finish, SCHEMA, _ARROW, tasks=tasks).unionByName(settled)


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS content
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM texts WHERE len(ws) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), marked AS (
  SELECT w.doc_id, w.i, w.w,
         count(l.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.i = w.i
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
