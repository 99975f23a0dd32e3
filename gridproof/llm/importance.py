"""Importance resampling: how much likelier a text is under a target model than under the raw one.

Both models are bags of hashed word n-grams (one and two words) with smoothed
bucket shares.  The raw model counts all documents; the target model a bounded
sample of documents labelled good.  A document's weight is the sum of the log
ratios of its n-grams; with Gumbel noise drawn from a hash of doc_id added,
the k largest are a sample without replacement by weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm import textops
from gridproof.sources.scratch import written


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every one- and two-word gram."""
    data = textops.lower_ascii(data)
    starts, ends, doc = textops.spans(data, offsets)
    h = textops.range_hash(textops.prefix_hash(data), starts, ends)
    two = textops.runs_hash(h, 2)
    whole = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    grams = np.concatenate([h, two[whole]]) % np.uint64(buckets)
    return grams.astype(np.int64), np.concatenate([doc, doc[: len(two)][whole]])


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, most: int = 20_000) -> tuple[np.ndarray, float, int]:
    """(log ratio of each bucket, share of good documents, number of documents).

    ``most`` bounds the labelled sample, which a hash of doc_id picks.  Labels
    with a null doc_id or quality are ignored; of contradicting ones the lower counts.
    The share is an upper bound at three standard deviations.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = {r["doc_id"]: r["quality"] > 0 for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}

    def count(batches):
        raw, good, n = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), 0
        for batch in batches:
            data, offsets = textops.column_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            n += len(ids)
            for a, b in textops.slices(offsets):
                grams, doc = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                raw += np.bincount(grams, minlength=buckets)
                mask = np.array([sample.get(i, False) for i in ids[a:b]], bool)
                good += np.bincount(grams[mask[doc]], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(buckets + 1, dtype=np.int32), "raw": np.append(raw, n), "good": np.append(good, 0)})

    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good, n = np.zeros(buckets), np.zeros(buckets), 0
    # one row a bucket
    for r in counts.collect():
        if r["bucket"] == buckets:
            n = r["raw"]
        else:
            raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    ratio = np.zeros(buckets)
    if good.sum():
        ratio = np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    m = len(sample)
    p = sum(sample.values()) / m if m else 1.0
    return ratio, min(1.0, p + 3 * math.sqrt(max(p * (1 - p), 1 / max(m, 1)) / max(m, 1))), n


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight) of every row."""
    buckets = len(ratio)

    def run(batches):
        for batch in batches:
            data, offsets = textops.column_bytes(batch.column(1))
            sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for a, b in textops.slices(offsets):
                grams, doc = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                sums.append(np.bincount(doc, ratio[grams], minlength=b - a))
                sizes.append(np.bincount(doc, minlength=b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(sums))], ["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def _threshold(ranks: DataFrame, k: int) -> int:
    """The k-th largest of a non-negative long column, by counts in ever narrower ranges."""
    low, width = 0, 1 << 63
    while width > 1:
        step = max(1, width >> 12)
        inside = F.col("rank").between(low, low + width - 1)
        # at most 4096 rows a round
        rows = ranks.where(inside).groupBy(F.floor((F.col("rank") - F.lit(low)) / F.lit(step)).cast("long").alias("b") if step > 1 else (F.col("rank") - F.lit(low)).alias("b")).agg(F.count("*").alias("n")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if k <= r["n"]:
                low, width = low + r["b"] * step, step
                break
            k -= r["n"]
        else:
            return 0
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = 10_000, most: int = 20_000, seed: int = 1) -> DataFrame:
    """All rows with log_weight, noisy key, and kept: whether the row is among the k largest keys.

    k is ``share`` of the rows; by default the share of good documents among
    those labelled, at three standard deviations above.

    Nulls: a null text has no n-grams and weight 0; a null doc_id draws its noise
    as a value of its own.  Rows with equal keys at the threshold are all kept.
    Empty input gives no rows; without labels every row is kept; other columns
    are ignored.
    """
    ratio, good, n = fit(docs, labels, buckets, most)
    k = math.ceil((good if share is None else share) * n)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    key = F.col("log_weight") - F.log(-F.log(uniform))
    # 2**20 steps to one; the offset keeps ranks above zero
    rank = F.greatest(F.lit(0), F.least(F.lit((1 << 62) - 1), F.floor(F.col("key") * float(1 << 20)).cast("long") + F.lit(1 << 61)))
    keyed = written(weigh(docs, ratio).withColumn("key", key).withColumn("rank", rank))
    least = _threshold(keyed, k) if 0 < k < n else (1 << 62 if k <= 0 else 0)
    return keyed.select("doc_id", "n_grams", "log_weight", "key", (F.col("rank") >= F.lit(least)).alias("kept"))
