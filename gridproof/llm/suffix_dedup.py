"""Removal of bytes covered by a long string that starts twice or more.

Difference-cover blockwise construction, to the depth that the question needs.
A cover of period v holds residues whose differences give every residue, so
any two places i and j have a d < v with both i + d and j + d at cover
places.  Two equal strings of ``match`` bytes thus agree on the first
``match - v + 1`` bytes after such a pair.

1. The suffixes at cover places (12 of 133) are sorted to that depth, one
   bucket of keys at a time, and named: is this key met elsewhere?
2. Only places with a named cover suffix in reach can repeat; all others are
   settled without a sort.  These are sorted to the full depth, again a
   bucket at a time and in ``blocks`` rounds, so that what is on disk or in
   memory at once is a fixed share of the input.  Documents without such a
   place are settled and leave the work.

A sort key is the 64-bit hash of the string of that depth.  The answers, one
byte a key before compression, go back in the asker's order; texts never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm import packs as pk
from gridproof.llm import textops
from gridproof.sources.scratch import written

#: Perfect difference sets (Singer) by period.
COVERS = {
    1: (0,),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPAN), ("kept", pa.binary())])


def cover_for(match: int) -> tuple[int, tuple[int, ...]]:
    """The largest known period that leaves a third of the length to compare."""
    period = max(v for v in COVERS if v == 1 or 3 * v <= 2 * match)
    return period, COVERS[period]


class _Work:
    def __init__(self, match: int, bits: int, blocks: int):
        self.match, self.bits, self.blocks = match, bits, blocks
        self.period, cover = cover_for(match)
        self.depth = match - self.period + 1
        self.at_cover = np.zeros(self.period, bool)
        self.at_cover[list(cover)] = True

    def samples(self, pack: pk.Pack):
        """(places in the pack, shortened keys) of the cover suffixes."""
        places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for first, data, offsets in pack.slices():
            size = np.diff(offsets)
            at = np.arange(len(data))
            inner = at - np.repeat(offsets[:-1], size)
            p = at[self.at_cover[inner % self.period] & (inner + self.depth <= np.repeat(size, size))]
            places.append(p + pack.offsets[first])
            keys.append(textops.range_hash(textops.prefix_hash(data), p, p + self.depth) >> np.uint64(64 - self.bits))
        return np.concatenate(places), np.concatenate(keys)

    def candidates(self, pack: pk.Pack, met: np.ndarray) -> np.ndarray:
        """Which places of the pack may start a repeated string. met: of each distinct sample key."""
        places, keys = self.samples(pack)
        hit = places[met[np.unique(keys, return_inverse=True)[1]] > 0] if len(places) else places
        start = pack.offsets[np.searchsorted(pack.offsets, hit, "right") - 1]
        edge = np.zeros(len(pack.data) + 1, np.int32)
        np.add.at(edge, np.maximum(hit - self.period + 1, start), 1)
        np.add.at(edge, hit + 1, -1)
        open_ = np.cumsum(edge[:-1]) > 0
        size = np.diff(pack.offsets)
        stop = np.repeat(pack.offsets[1:], size)
        return open_ & (np.arange(len(pack.data)) + self.match <= stop)

    def strings(self, pack: pk.Pack, open_: np.ndarray, block: int):
        """(places, keys) of the candidates whose key falls in the block."""
        places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for first, data, _ in pack.slices():
            lo = pack.offsets[first]
            p = np.flatnonzero(open_[lo : lo + len(data)])
            if len(p):
                k = textops.range_hash(textops.prefix_hash(data), p, p + self.match)
                own = (k % np.uint64(self.blocks)) == block
                places.append(p[own] + lo)
                keys.append(k[own])
        return np.concatenate(places), np.concatenate(keys)


#: Either a settled document (doc_id, text), or a pack of the documents with candidates and a bit for each place.
_CUT = "settled boolean, doc_id long, text binary, pack_id long, ids array<long>, sizes binary, data binary, open binary"
_CUT_ARROW = pa.schema([("settled", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.binary()), ("pack_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("data", pa.binary()), ("open", pa.binary())])


def _cut(pack: pk.Pack, open_: np.ndarray):
    sums = np.concatenate([[0], np.cumsum(open_)])
    has = sums[pack.offsets[1:]] > sums[pack.offsets[:-1]]
    for d in np.flatnonzero(~has):
        yield {"settled": True, "doc_id": pack.ids[d], "text": pack.data[pack.offsets[d] : pack.offsets[d + 1]].tobytes()}
    if has.any():
        size = np.diff(pack.offsets)
        own = np.repeat(has, size)
        sizes = np.concatenate([[0], np.cumsum(size[has])]).astype(np.int64)
        ids = [i for i, h in zip(pack.ids, has, strict=True) if h]
        yield {"settled": False, "pack_id": pack.pack_id, "ids": ids, "sizes": sizes.tobytes(), "data": pk.squeeze(pack.data[own].tobytes()), "open": pk.squeeze(np.packbits(open_[own]).tobytes())}


def _opened(row: dict) -> tuple[pk.Pack, np.ndarray]:
    pack = pk.Pack(row)
    return pack, np.unpackbits(np.frombuffer(pk.expand(row["open"]), np.uint8), count=len(pack.data)).astype(bool)


def remove_repeats(docs: DataFrame, match: int = 200, blocks: int = 4) -> DataFrame:
    """Each document without the bytes covered by a ``match``-byte string that also starts elsewhere.

    Columns: doc_id, n_bytes, spans (maximal removed runs of bytes, in order),
    kept (remaining bytes, concatenated).  Matches never cross documents, may
    overlap, and are judged on the input; the first occurrence goes too.

    Nulls: a null text is empty; a null doc_id is kept.  Repeated rows are
    documents of their own, so equal rows of at least ``match`` bytes lose
    everything.  Texts shorter than ``match`` stay whole.  Empty input gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    packs = pk.packed(docs, 4 << 20)
    size = pk.sizes(packs)
    # shortened keys of the cover suffixes only open candidates; equal ones by chance open a few more
    work = _Work(match, min(64, max(32, size.bytes.bit_length() + 8)), blocks)
    parts = pk.buckets(spark, size.bytes / blocks)
    tasks = pk.buckets(spark, size.packs, pk.PACKS)

    def sample_keys(pack):
        return np.unique(work.samples(pack)[1], return_counts=True)

    def seen(totals):
        return (totals > 1).astype(np.uint8)

    named = written(pk.ask(packs, sample_keys, work.bits, seen, parts=pk.buckets(spark, size.bytes * int(work.at_cover.sum()) / work.period)).select("pack_id", "bucket", "found"))
    pk.release(spark)

    left = written(pk.answered(packs, named, lambda pack, met: _cut(pack, work.candidates(pack, met)), _CUT, _CUT_ARROW, tasks=tasks))
    pk.discard(packs, named)
    pk.release(spark)

    schema = pa.schema([("pack_id", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    cut = left.where("not settled")
    answers = None
    for block in range(blocks):

        def send(batches, block=block):
            for batch in batches:
                for i in range(batch.num_rows):
                    pack, open_ = _opened(batch.slice(i, 1).to_pylist()[0])
                    keys, counts = np.unique(work.strings(pack, open_, block)[1], return_counts=True)
                    if rows := list(pk.cut(pack.pack_id, keys, counts, 64, parts)):
                        yield pa.RecordBatch.from_pylist(rows, schema)

        found = pk.counted(cut.mapInArrow(send, pk.ASKED), 64, parts, seen)
        found = written(found.select("pack_id", (F.col("bucket") + block * parts).cast("int").alias("bucket"), "found"))
        answers = found if answers is None else answers.unionByName(found)
        pk.release(spark)

    def finish(row, got):
        pack, open_ = _opened(row)
        used, edge = 0, np.zeros(len(pack.data) + 1, np.int32)
        for block in range(blocks):
            places, keys = work.strings(pack, open_, block)
            names, index = np.unique(keys, return_inverse=True)
            hit = places[got[used + index] > 0] if len(names) else places
            used += len(names)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + match, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for d, i in enumerate(pack.ids):
            lo, hi = pack.offsets[d], pack.offsets[d + 1]
            mask = gone[lo:hi]
            turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2)
            yield {"doc_id": i, "n_bytes": int(hi - lo), "spans": [{"start": int(a), "stop": int(b)} for a, b in turn], "kept": pack.data[lo:hi][~mask].tobytes()}

    settled = left.where("settled").select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"), F.col("text").alias("kept"))
    return pk.met(cut, answers, finish, SCHEMA, _ARROW, tasks=tasks).unionByName(settled)
