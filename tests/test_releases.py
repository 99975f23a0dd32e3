"""Newest releases, as-of look-ups and composites against plain Python."""

import datetime
import random

from pyspark.sql import functions as F

from gridproof.operators import releases

DAY = datetime.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + datetime.timedelta(n)


def test_newest_release_of_a_listing(spark):
    df = spark.createDataFrame([("s3/release/2024-03-12.0/theme",), ("s3/release/2024-11-13.0/theme",), ("s3/other",), (None,)], "path string")
    assert [r.release for r in releases.newest_release(df).collect()] == ["2024-11-13.0"]
    assert [r.release for r in releases.newest_release(df.limit(0)).collect()] == [None]


def test_as_of(spark):
    rng = random.Random(1)
    new = [(rng.choice(["a", "b", None]), day(rng.choice([None, *range(40)])), k) for k in range(60)]
    asked = [(k, rng.choice(["a", "b", "c", None]), day(rng.choice([None, *range(-3, 45)]))) for k in range(100)]
    got = releases.as_of(spark.createDataFrame(asked, "id int, p string, at date"), spark.createDataFrame(new, "p string, when date, n int"), ["p"], "at", "when")
    assert got.columns == ["id", "p", "at", "release"]
    found = {r.id: None if r.release is None else (r.release.when, r.release.n) for r in got.collect()}
    for k, p, at in asked:
        assert found[k] == max(((w, n) for q, w, n in new if q == p and w and at and w <= at), default=None)


def test_composite(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), day(rng.randrange(30)), rng.choice("xyz"), rng.choice([None, 1.0, 2.0, 3.0]), k) for k in range(300)]
    dates = [day(n) for n in (-5, 0, 3, 9, 10, 17, 29, 40)]
    df, asked = spark.createDataFrame(rows, "px int, d date, band string, value double, k int"), spark.createDataFrame([(x,) for x in dates * 2], "at date")
    got = {(r["at"], r.px): (r.value, r.newest) for r in releases.composite(df, asked, ["px"], "d", "at", 4, "band", ("y", "x"), F.col("k")).collect()}
    want = {}
    for at in dates:
        for px in range(5):
            own = [(d, -"yx".index(b), k, v) for p, d, b, v, k in rows if p == px and b in "yx" and v is not None and 0 <= (at - d).days <= 4]
            if own:
                want[at, px] = (max(own)[3], max(own)[0])
    assert got == want
