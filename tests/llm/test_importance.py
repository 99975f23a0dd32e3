"""Importance resampling: separation on labelled texts, thresholds and odd tables."""

from pyspark.sql import functions as F

from gridproof.llm import importance


def test_keeps_good_and_drops_bad(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = importance.resample(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rates = {r.quality: r.k for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.6


def test_threshold_is_the_kth_largest(spark):
    values = [(k * 7919 % 1009 * 10**9,) for k in range(500)]
    df = spark.createDataFrame(values, "`rank` long")
    ranked = sorted((v[0] for v in values), reverse=True)
    for k in (1, 2, 250, 500):
        assert importance._threshold(df, k) == ranked[k - 1]


def test_share_and_reruns(documents, spark):
    labels = spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(100)], "doc_id long, quality int, toxic int")
    rows = [(k, " ".join(f"{'good' if k % 2 == 0 else 'bad'}{j}" for j in range(30))) for k in range(100)]
    got = importance.resample(documents(rows), labels, share=0.5)
    assert {r.doc_id for r in got.where("kept").collect()} == set(range(0, 100, 2))
    again = importance.resample(documents(rows[::-1]).repartition(5), labels, share=0.5)
    assert {(r.doc_id, r.key) for r in got.collect()} == {(r.doc_id, r.key) for r in again.collect()}


def test_odd_rows(documents, odd, spark):
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None), (6, 0)], "doc_id long, quality int")
    got = importance.resample(documents(odd), labels).collect()
    assert len(got) == len(odd)
    assert [r.log_weight for r in got if r.n_grams == 0] == [0.0] * 4
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in importance.resample(documents(odd), none).collect())
    assert importance.resample(documents([]), labels).count() == 0


def test_weights_against_plain_python(spark, documents):
    """Log weights from n-grams counted in dictionaries; buckets so many that none is shared."""
    import math
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    import pytest

    from gridproof.llm import textops

    buckets = 1 << 16
    rows = [(k, " ".join(f"{'good' if k % 3 else 'Bad'}{j * k % 7}" for j in range(k % 11))) for k in range(40)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 40, 2)], "doc_id long, quality int")

    def grams(text):
        w = text.lower().split()
        return [(x,) for x in w] + list(zip(w, w[1:], strict=False))

    raw = Counter(g for _, t in rows for g in grams(t))
    good = Counter(g for k, t in rows if k % 2 == 0 and k % 3 for g in grams(t))
    bucket, _ = importance._grams(*textops.column_bytes(pa.array([" ".join(g) for g in raw if len(g) == 1], pa.large_string())), buckets)
    assert len(np.unique(bucket)) == sum(len(g) == 1 for g in raw)
    n, m = sum(raw.values()), sum(good.values())
    got = {r.doc_id: r.log_weight for r in importance.resample(documents(rows), labels, buckets=buckets).collect()}
    for k, t in rows:
        assert got[k] == pytest.approx(sum(math.log((good[g] + 1) / (m + buckets)) - math.log((raw[g] + 1) / (n + buckets)) for g in grams(t)), abs=1e-6)
