"""Packs of documents, and questions about keys asked over all packs.

A pack is one row with some megabytes of whole documents.  Packs are written
once to the shared checkpoint folder, so every later step sees the same packs
in the same order, also after an executor was lost.

``ask`` answers, for many keys of each pack, how often a key occurs in all
packs.  Sorted keys are cut into buckets by value, travel as gaps of a fixed
byte width, are summed one bucket at a time, and the answers go back in the
asker's order.  No locator travels with a key, and a key that many documents
hold counts once for each pack, so a hot key makes no large group.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.llm import textops
from gridproof.sources.scratch import written

PACK_BYTES = 8 << 20
#: Keys, counting a key once for each pack, that one task sorts; the number of buckets follows from it.  With ever more
#: packs and buckets a row holds ever fewer keys, but never are there more rows than keys.
KEYS = 4 << 20
#: Packs whose answers one task brings back.
PACKS = 16
PACK = "pack_id long, ids array<long>, keys array<long>, sizes binary, n_words long, n_bytes long, data binary"
_PACK = pa.schema([("pack_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.binary()), ("n_words", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary())])
ASKED = "pack_id long, bucket int, n long, width int, keys binary, counts binary"
ANSWER = "pack_id long, bucket int, found binary, held long, total double, stats binary"


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps now rather than at some later collection."""
    spark.sparkContext._jvm.System.gc()


def buckets(spark: SparkSession, n: float = 0, each: int = KEYS) -> int:
    """How many parts ``n`` things fall into, ``each`` to a part, and at least as many as the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n) // each))


@dataclass(frozen=True)
class Sizes:
    """Packs, words and bytes (before compression) of a table of packs."""

    packs: int
    words: int
    bytes: int


def sizes(packs: DataFrame) -> Sizes:
    return Sizes(*packs.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first())


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def text_slices(data: np.ndarray, offsets: np.ndarray):
    """(first document, bytes, offsets) of parts of some megabytes."""
    for a, b in textops.slices(offsets):
        lo = offsets[a]
        yield a, data[lo : offsets[b]], offsets[a : b + 1] - lo


class Pack:
    """Documents of one pack: ids (None where null), hashes of the texts (where the pack has them), bytes and offsets."""

    def __init__(self, row: dict):
        self.pack_id, self.ids, self.keys = row["pack_id"], row["ids"], row.get("keys")
        self.offsets = np.frombuffer(row["sizes"], np.int64)
        self.data = np.frombuffer(expand(row["data"]), np.uint8)

    def slices(self):
        return text_slices(self.data, self.offsets)


def texts(data: bytes, sizes: np.ndarray) -> dict:
    """Columns of a pack that hold its texts, given as bytes and offsets."""
    words = sum(len(textops.spans(d, o)[0]) for _, d, o in text_slices(np.frombuffer(data, np.uint8), sizes))
    return {"n_words": words, "data": squeeze(data)}


def _build(batches: Iterator[pa.RecordBatch], size: int, columns: Callable[[bytes, np.ndarray], dict], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids, keys, found, sizes = [], [], [], [0]

    def pack():
        data, offsets = b"".join(found), np.array(sizes, np.int64)
        row = {"pack_id": (part << 24) + number, "ids": list(ids), "keys": list(keys), "sizes": offsets.tobytes(), "n_bytes": len(data)} | columns(data, offsets)
        return pa.RecordBatch.from_pylist([row], arrow)

    for batch in batches:
        for i, key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True):
            text = (text.as_py() or "").encode()
            if ids and sizes[-1] + len(text) > size:
                yield pack()
                number, ids, keys, found, sizes = number + 1, [], [], [], [0]
            ids.append(i)
            keys.append(key)
            found.append(text)
            sizes.append(sizes[-1] + len(text))
    if ids:
        yield pack()


def packed(docs: DataFrame, size: int = PACK_BYTES, part_bytes: int | None = None, columns: Callable[[bytes, np.ndarray], dict] = texts, schema: str = PACK, arrow: pa.Schema = _PACK) -> DataFrame:
    """All documents in written packs of about ``size`` bytes; a null text is empty.

    ``columns`` gives n_words and what a pack holds in place of its texts; of
    the other columns those of ``schema`` are kept.

    With ``part_bytes`` documents are first dealt to parts of about that size by a
    hash of id and text, in order of it, so packs depend on the documents alone
    and not on how the input is partitioned.
    """
    if part_bytes:
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"), F.xxhash64("text").alias("k"), F.xxhash64("doc_id", "text").alias("h"))
        rows = rows.repartition(max(1, -(-int(total) // part_bytes)), "h").sortWithinPartitions("h", "i", "k").drop("h")
        return written(rows.mapInArrow(lambda batches: _build(batches, size, columns, arrow), schema), "none")
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"), F.xxhash64("text").alias("k"))
    return written(rows.mapInArrow(lambda batches: _build(batches, size, columns, arrow), schema), "none")


@functools.lru_cache(maxsize=16)
def limits(bits: int, parts: int, low: int = 0) -> np.ndarray:
    """First key of each bucket, and the last possible one; worked out once for a worker, however many packs it cuts."""
    first = (np.arange(parts + 1, dtype=object) << bits) // parts >> low << low
    return np.array([min(int(x), 2**64 - 1) for x in first], np.uint64)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: their width, then each in as few bytes (1, 2, 4 or 8) as the largest needs."""
    most = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return np.concatenate([np.array([width], np.uint8), np.ascontiguousarray(counts.reshape(-1), f"<u{width}").view(np.uint8)])


def widened(data: bytes) -> np.ndarray:
    """The counts of ``narrow``, in one row."""
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def cut(pack_id: int, keys: np.ndarray, counts: np.ndarray | None, bits: int, parts: int, low: int = 0) -> Iterator[dict]:
    """Rows of ASKED for sorted distinct keys of ``bits`` bits; keys equal but for their ``low`` last bits share a bucket."""
    first = limits(bits, parts, low)
    at = np.searchsorted(keys, first, "left")
    at[0], at[-1] = 0, len(keys)
    for b in np.flatnonzero(at[1:] > at[:-1]):
        k = keys[at[b] : at[b + 1]]
        gaps = np.empty_like(k)
        gaps[0], gaps[1:] = k[0] - first[b], k[1:] - k[:-1]
        width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
        c = b"" if counts is None else squeeze(narrow(counts[at[b] : at[b + 1]]).tobytes())
        yield {"pack_id": pack_id, "bucket": int(b), "n": len(k), "width": width, "keys": gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), "counts": c}


def join_keys(row: dict, bits: int, parts: int) -> np.ndarray:
    """The keys of a row made by ``cut``, less their bucket's first value."""
    gaps = np.zeros((row["n"], 8), np.uint8)
    gaps[:, : row["width"]] = np.frombuffer(row["keys"], np.uint8).reshape(-1, row["width"])
    return np.cumsum(gaps.reshape(-1).view(np.uint64), dtype=np.uint64)


Finding = Callable[[np.ndarray], np.ndarray]


def grouped(keys: np.ndarray, sums: np.ndarray, low: int) -> np.ndarray:
    """For sorted distinct keys: count, sum of the counts of all keys equal but for their ``low`` last bits, and how many of these are counted."""
    group = keys >> np.uint64(low)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    first, of = np.flatnonzero(new), np.cumsum(new) - 1
    return np.stack([sums, np.add.reduceat(sums, first)[of], np.add.reduceat((sums > 0).astype(np.int64), first)[of]], 1)


def counted(asked: DataFrame, bits: int, parts: int, found: Finding, stats: Callable[[int, np.ndarray, np.ndarray], bytes] | None = None, low: int = 0) -> DataFrame:
    """Answers for rows of ASKED: ``found`` maps the total counts, or with ``low`` the rows of ``grouped``, to a small array; sent zipped.

    held and total are the bucket's number of distinct keys with a count and
    the sum of counts, told in the bucket's first row only.
    """

    def bucket(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pack_id").to_pylist()
        keys = [join_keys(r, bits, parts) for r in rows]
        counts = [widened(expand(r["counts"])) if r["counts"] else np.ones(r["n"], np.int64) for r in rows]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        sums = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))
        told = grouped(ranked[new], sums, low) if low else sums
        total = np.empty((len(every), *told.shape[1:]), np.int64)
        total[order] = told[np.cumsum(new) - 1]
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        firsts = {"held": int((sums > 0).sum()), "total": float(sums.sum())}
        base = np.uint64((rows[0]["bucket"] << bits) // parts >> low << low)
        more = stats(rows[0]["bucket"], ranked[new] + base, sums) if stats else None
        out = [{"pack_id": r["pack_id"], "bucket": r["bucket"], "found": squeeze(found(total[at[i] : at[i + 1]]).tobytes()), "held": firsts["held"] if not i else 0, "total": firsts["total"] if not i else 0.0, "stats": more if not i else None} for i, r in enumerate(rows)]
        return pa.Table.from_pylist(out, pa.schema([("pack_id", pa.int64()), ("bucket", pa.int32()), ("found", pa.binary()), ("held", pa.int64()), ("total", pa.float64()), ("stats", pa.binary())]))

    return asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(bucket, ANSWER)


def ask(packs: DataFrame, keys: Callable[[Pack], tuple[np.ndarray, np.ndarray | None]], bits: int, found: Finding, stats=None, *, parts: int, low: int = 0, kind: Callable[[dict], Pack] = Pack) -> DataFrame:
    """Rows of ANSWER, for ``keys(pack)``: sorted distinct keys and their counts in the pack, made from its row by ``kind``."""
    schema = pa.schema([("pack_id", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pack = kind(batch.slice(i, 1).to_pylist()[0])
                rows = list(cut(pack.pack_id, *keys(pack), bits, parts, low))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return counted(packs.mapInArrow(send, ASKED), bits, parts, found, stats, low)


def as_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def met(packs: DataFrame, answers: DataFrame, then: Callable[[dict, np.ndarray], Iterator[dict]], schema: str, arrow: pa.Schema, read: Callable[[bytes], np.ndarray] = as_bytes, *, tasks: int) -> DataFrame:
    """Rows that ``then(row of packs, answers in the order of its keys)`` gives for each pack."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.sort_by("bucket").column("found").to_pylist()
        got = np.concatenate([read(expand(x)) for x in found]) if found else np.zeros(0, np.uint8)
        rows = [r for x in left.to_pylist() for r in then(x, got)]
        return pa.Table.from_pylist(rows, arrow)

    asked = packs.repartition(tasks, "pack_id").groupBy("pack_id")
    return asked.cogroup(answers.select("pack_id", "bucket", "found").repartition(tasks, "pack_id").groupBy("pack_id")).applyInArrow(both, schema)


def answered(packs: DataFrame, answers: DataFrame, then: Callable[[Pack, np.ndarray], Iterator[dict]], schema: str, arrow: pa.Schema, read: Callable[[bytes], np.ndarray] = as_bytes, *, tasks: int) -> DataFrame:
    """``met`` for packs of ``packed``."""
    return met(packs, answers, lambda row, got: then(Pack(row), got), schema, arrow, read, tasks=tasks)
