"""Questions about keys: counts beyond 32 bits, limits of very many buckets, and sums over buckets by levels."""

import time

import numpy as np
import pyarrow as pa
import pytest

from gridproof.llm import maxent_lm
from gridproof.llm import packs as pk


def test_counts_beyond_32_bits_survive(spark):
    schema = pa.schema([("pack_id", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    keys = np.array([3, 2**40, 2**63 + 5], np.uint64)
    counts = [np.array([2**32 + 5, 1, 0]), np.array([2**33, 0, 2**45])]

    def send(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(list(pk.cut(i, keys, counts[i], 64, 4)), schema)

    answers = pk.counted(spark.range(2).mapInArrow(send, pk.ASKED), 64, 4, pk.narrow).collect()
    for i in range(2):
        got = np.concatenate([pk.widened(pk.expand(r.found)) for r in sorted(answers, key=lambda r: r.bucket) if r.pack_id == i])
        assert got.tolist() == [3 * 2**32 + 5, 1, 2**45]
    assert sum(r.total for r in answers) == 3 * 2**32 + 5 + 1 + 2**45
    assert sum(r.held for r in answers) == 3


@pytest.mark.parametrize("shape", [(0,), (5,), (4, 3)])
def test_narrow_counts_come_back(shape):
    x = np.random.default_rng(1).integers(0, 2**50, shape)
    assert pk.widened(pk.narrow(x).tobytes()).tolist() == x.reshape(-1).tolist()


def test_cutting_into_many_buckets_is_quick():
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 400_000, np.uint64))
    pk.limits(64, 42_000)
    at = np.searchsorted(keys, pk.limits(64, 42_000), "left")
    began = time.time()
    for _ in range(5):
        pk.limits(64, 42_000)
        np.searchsorted(keys, pk.limits(64, 42_000), "left")
    assert (time.time() - began) / 5 < 0.05
    rows = list(pk.cut(0, keys, None, 64, 42_000))
    assert sum(r["n"] for r in rows) == len(keys)
    for r in rows[::4000]:
        assert (pk.join_keys(r, 64, 42_000) + np.uint64((r["bucket"] << 64) // 42_000)).tolist() == keys[at[r["bucket"]] : at[r["bucket"] + 1] if r["bucket"] < 41_999 else None].tolist()


def test_bucket_sums_by_levels(spark):
    rng = np.random.default_rng(3)
    rows, every = [], []
    for b in range(70):
        names, sums = rng.integers(0, 2**64, 9, np.uint64), rng.integers(1, 2**40, 9)
        part = maxent_lm.told(np.stack([np.full(maxent_lm.TAILS, b), np.ones(maxent_lm.TAILS)]), names, sums, 5)
        every.append(part)
        rows.append((b, 9, float(sums.sum()), bytearray(part)))
    got = maxent_lm.merged(spark.createDataFrame(rows, "bucket int, held long, total double, stats binary"), 5, 4)
    assert len(got) <= 4
    assert sum(r["held"] for r in got) == 630
    for a, b in zip(maxent_lm.untold([r["stats"] for r in got], 5), maxent_lm.untold(every, 5), strict=True):
        assert a.tolist() == b.tolist()
