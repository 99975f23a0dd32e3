"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Quotas.  Documents fall into blocks of their source by a hash.  A source takes
   all its blocks a whole number of times, then its first blocks up to its
   target, then documents of one last block: an exact number of units (a block in
   one pass over its source).
2. Tree.  The root of a binary tree over the output shards holds every source's
   number of units; each node draws its left half's numbers from a multivariate
   hypergeometric distribution, and a leaf says which range of each source's
   permuted units its shard gets.  A shard walks from the root to its leaf by
   itself, with draws that depend on the seed and the node alone.
3. Draw.  A shard maps its range through a keyed permutation of the source's
   units, so shards draw disjoint blocks, and all are drawn.
4. Shuffle.  Rows are shuffled within their shard by a keyed hash.

What a document's mix takes is counted from the drawn blocks.  All draws come
from hashes and the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridproof.llm.packs import buckets
from gridproof.llm.textops import mix
from gridproof.sources.scratch import written

WEIGHTS = (3, 1, 2)
#: Blocks are first summed in this many ranges of a source, then within one range.
_RANGES = 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, by: str) -> DataFrame:
    """Rank of each row by a column, nulls last, without sorting all rows in one task."""
    parts = max(1, min(200, sources.sparkSession.sparkContext.defaultParallelism))
    ranged = written(sources.repartitionByRange(parts, F.col(by).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(F.col(by).asc_nulls_last())
    # one row for each of the few parts
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(total)]
        total += sizes[part]
    offset = F.create_map(*starts)[F.col("part")] if starts else F.lit(0)
    return ranged.withColumn("rank", F.row_number().over(own) - 1 + offset).drop("part")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) of the documents (source, size).

    Sources in code point order, null last, weigh ``weights``, repeating; they
    share ``share`` of all sizes, and none gets over ``most`` times its size:
    the excess is shared again by weight among the others.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    each = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written(_ranked(sources, "source").withColumn("weight", F.element_at(each, (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank"))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = None
    while True:
        # a source stops where its most is below the level; the level only rises
        stops = F.lit(False) if level is None else F.col("source_size") * most < F.lit(level) * F.col("weight")
        spent, open_ = ranked.agg(F.sum(F.when(stops, F.col("source_size") * most).otherwise(0.0)), F.sum(F.when(stops, 0.0).otherwise(F.col("weight")))).first()
        if not open_ or (new := max(0.0, total - spent) / open_) == level:
            break
        level = new
    target = F.least(F.col("source_size") * most, F.lit(level or 0.0) * F.col("weight"))
    return ranked.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


class Mix:
    """A plan: how often each document is taken, and the shard of each copy."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_docs: int = 256, seed: int = 7):
        self.docs, self.seed = docs, seed
        text, key = F.col("text"), F.xxhash64("doc_id", "text", F.lit(seed))
        self.sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(text).alias("size"), key.alias("key")))
        plan = source_targets(self.sized, weights, share, most)
        size = F.greatest(F.lit(1), F.col("source_size"))
        plan = plan.withColumn("full", F.floor(F.col("target") / size).cast("int")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        self.plan = written(plan.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_docs)).cast("long")))
        placed = self.sized.join(self.plan.withColumnRenamed("source", "own"), F.expr("source <=> own")).drop("own")
        # a block is what a hash of the document says, so the blocks of a source stand in no order already
        self.placed = placed.withColumn("rank", F.pmod("key", "n_blocks"))
        self.chosen = written(self._chosen())

    def _chosen(self) -> DataFrame:
        """placed and taken_rest: whether the last, partial pass takes the document."""
        blocks = self.placed.groupBy("source", "rank").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("n_blocks").alias("n_blocks"))
        wide = F.greatest(F.lit(1), F.ceil(F.col("n_blocks") / _RANGES)).cast("long")
        blocks = written(blocks.withColumn("range", F.floor(F.col("rank") / wide)))
        order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = blocks.groupBy("source", "range").agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"), F.max("rank").alias("end"))
        ranges = written(ranges.withColumn("before", F.coalesce(F.sum("sum").over(order), F.lit(0))))
        # a whole range is in, out, or cut; only cut ones are looked into
        cut = ranges.where("before < rest and before + sum > rest").select(F.col("source").alias("s"), F.col("range").alias("r"), "before")
        inner = Window.partitionBy("source", "range").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        inside = blocks.join(cut, F.expr("source <=> s and range = r")).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
        cut_block = F.expr("start < rest and start + size > rest")
        inside = inside.select("source", F.when(F.expr("start + size <= rest"), F.col("rank")).alias("end"), F.when(cut_block, F.col("rank")).alias("last"), F.when(cut_block, F.col("start")).alias("start"))
        whole = ranges.where("before + sum <= rest and sum > 0").select("source", "end", F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("start"))
        # whole blocks go up to taken_to, and one block from start on is cut
        ends = written(whole.unionByName(inside).groupBy(F.col("source").alias("s")).agg(F.max("end").alias("taken_to"), F.max("last").alias("last"), F.max("start").alias("start")))
        out = self.placed.join(ends, F.expr("source <=> s"), "left").drop("s")
        cut_docs = Window.partitionBy("source", "rank").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        edge = out.where("rank = last").withColumn("begin", F.col("start") + F.coalesce(F.sum("size").over(cut_docs), F.lit(0)))
        edge = edge.withColumn("taken_rest", F.expr("begin + size / 2 <= rest")).drop("begin")
        plain = out.where("not (rank <=> last)").withColumn("taken_rest", F.expr("rest > 0 and rank <= coalesce(taken_to, -1)"))
        return edge.unionByName(plain).drop("start")

    def draws(self, shards: int | None = None) -> DataFrame:
        """(source, copy, rank, shard) of every unit: the blocks that each shard draws, one row each.

        By default there are as many shards as shuffle partitions, so a shard stays within a task.
        """
        spark = self.docs.sparkSession
        shards = shards or buckets(spark)
        rest = self.chosen.where("taken_rest").groupBy("source").agg((F.max("rank") + 1).alias("r")).select(F.col("source").alias("s"), "r")
        units = self.plan.join(rest, F.expr("source <=> s"), "left").select("source", "n_blocks", (F.col("full") * F.col("n_blocks") + F.coalesce("r", F.lit(0))).alias("n"))
        # two numbers for each source, not for each document
        rows = sorted(units.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        names, blocks, counts = [r["source"] for r in rows], [r["n_blocks"] for r in rows], np.array([r["n"] for r in rows], np.int64)
        seed, schema = self.seed, pa.schema([("source", pa.string()), ("copy", pa.int32()), ("rank", pa.int64()), ("shard", pa.int32())])

        def draw(batches):
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    first, n = leaf(counts, shards, shard, seed)
                    for k in np.flatnonzero(n):
                        unit = permuted(np.arange(first[k], first[k] + n[k]), int(counts[k]), seed * 1_000_003 + int(k))
                        copy, rank = unit // blocks[k] + 1, unit % blocks[k]
                        yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(unit), pa.string()), pa.array(copy, pa.int32()), pa.array(rank, pa.int64()), pa.array(np.full(len(unit), shard), pa.int32())], schema=schema)

        return spark.range(shards, numPartitions=min(shards, buckets(spark))).mapInArrow(draw, "source string, copy int, rank long, shard int")

    def drawn(self, shards: int | None = None) -> DataFrame:
        """chosen with draws, the (copy, shard) of all units that hold the document.

        The units of a block, at most ``most`` and one, travel to its documents
        in one row.  A block that is cut keeps its last copy for the documents taken.
        """
        block = self.draws(shards).groupBy(F.col("source").alias("s"), F.col("rank").alias("r")).agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("units"))
        out = self.chosen.join(block, F.expr("source <=> s and rank = r"), "left").drop("s", "r")
        units = F.coalesce("units", F.array().cast("array<struct<copy:int,shard:int>>"))
        return out.withColumn("draws", F.filter(units, lambda u: (u["copy"] <= F.col("full")) | F.col("taken_rest"))).drop("units")

    def taken(self, shards: int | None = None) -> DataFrame:
        """doc_id, size, source_size, target, taken, source of each row; taken sums the sizes of the copies that shards drew."""
        taken = F.size("draws") * F.col("size")
        return self.drawn(shards).select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", taken.cast("long").alias("taken"), "source")

    def mixed(self, shards: int | None = None) -> DataFrame:
        """Copies of the rows of ``docs`` in their shards: its columns, and copy, shard, position in place of any of these names.

        Null texts and sources are mixed like others.  Repeated rows have the same
        copies in the same shards, but those in a cut block may get one copy more
        than the plan says.  Empty input gives no rows.
        """
        shards = shards or buckets(self.docs.sparkSession)
        # repeated rows have the same copies, so each is placed once
        placed = self.drawn(shards).where(F.size("draws") > 0).groupBy("doc_id", "source", "key").agg(F.array_distinct(F.flatten(F.collect_list("draws"))).alias("to"))
        rows = self.docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("i"), F.col("source").cast("string").alias("s"), F.xxhash64("doc_id", "text", F.lit(self.seed)).alias("k"))
        rows = rows.join(placed, F.expr("k = key and i <=> doc_id and s <=> source")).select("d", "k", F.explode("to").alias("c"))
        rows = rows.select("d", F.col("c.copy").alias("copy"), F.col("c.shard").alias("shard"), F.xxhash64("k", "c.copy", F.lit(self.seed)).alias("position"))
        own = [F.col(f"d.`{c}`") for c in self.docs.columns if c not in ("copy", "shard", "position")]
        return rows.repartition(shards, "shard").sortWithinPartitions("shard", "position", "d.doc_id").select(*own, "copy", "shard", "position")


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of numbers below n under a keyed permutation of 0 to n - 1.

    A Feistel network of four rounds over the next even number of bits; an image
    outside goes through it again until it is inside.
    """
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for turn in range(4):
            left, right = right, left ^ (mix(right, key * 4 + turn) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _left(counts: np.ndarray, first: int, stop: int, seed: int) -> np.ndarray:
    """What the left half of a node over shards first to stop - 1 gets of ``counts``."""
    middle, total = (first + stop) // 2, int(counts.sum())
    draw = total * (middle - first) // (stop - first)
    return np.random.default_rng([seed, first, stop]).multivariate_hypergeometric(counts, draw, method="marginals") if total else counts * 0


def leaf(units: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each source where the shard's range of units begins and how many it has, by a walk from the root."""
    first, stop, counts, begin = 0, shards, units, units * 0
    while stop - first > 1:
        middle, left = (first + stop) // 2, _left(counts, first, stop, seed)
        if shard < middle:
            stop, counts = middle, left
        else:
            first, begin, counts = middle, begin + left, counts - left
    return begin, counts


def split_tree(units: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Units of each source for each shard: rows sum to near equal shares, columns to ``units``."""
    return np.stack([leaf(units, shards, k, seed)[1] for k in range(shards)])


def mix_plan(docs: DataFrame, **options) -> Mix:
    """The mix of ``docs`` (doc_id, text, source, and any other columns).

    Nulls: a null text has size 0, a null source is a source of its own, the
    last; a null doc_id is kept.  Rows that repeat doc_id and text stand in the
    same block and are taken alike but for the cut block.  Empty input gives no
    rows; documents of size 0 are taken 0 words.
    """
    return Mix(docs, **options)
