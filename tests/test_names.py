"""Name matching and tracker strings."""

import pytest
from pyspark.sql import functions as F

from gridproof.functions import names


@pytest.mark.parametrize(
    ("code", "folder", "score"),
    [
        ("Nairobi", "nairobi", 100),
        ("nairobi", "dataset_nairobi_final", 96),
        ("nairobi", "old nairobi south", 90),
        ("data nairobi", "old data nairobi south", 90),
        ("kampala", "xkampalay", 84),
        ("addisababa", "addis", 78),
        ("abc", "xabcx", None),
        ("", "x", None),
        ("São-Tomé", "sao tome", 100),
        ("lagos_v2", "lagos_2021", 96),
        ("ﬁle Ｄelta Ⅳ", "file delta iv", 100),
        ("zone²", "zone2", 100),
    ],
)
def test_ladder(spark, code, folder, score):
    df = spark.createDataFrame([(code, folder)], "c string, f string")
    parts = df.select(names.name_parts("c").alias("c"), names.name_parts("f").alias("f")).repartition(1)
    got, met = parts.select(names.match_score(F.col("c"), F.col("f"))["score"], F.arrays_overlap(names.code_keys(F.col("c")), names.folder_keys(F.col("f")))).first()
    assert got == score and (met or score is None)


def test_wrappers_alone_keep_the_whole_name(spark):
    r = spark.createDataFrame([("data_final",)], "c string").select(names.name_parts("c").alias("p")).first().p
    assert (list(r.core), r.core_norm) == ([], "datafinal")


@pytest.mark.parametrize(("text", "flag"), [("yes", True), ("unsuitable", False), ("unsuitable for use", True), ("highly", True), ("none", False), (None, False), (" N ", False)])
def test_quality(spark, text, flag):
    assert spark.createDataFrame([(text,)], "q string").select(names.quality_flag("q")).first()[0] is flag


@pytest.mark.parametrize(("text", "flag"), [("TRUE", True), (" y", True), ("2.5", True), ("0", False), ("", False), (None, False)])
def test_truthy(spark, text, flag):
    assert spark.createDataFrame([(text,)], "q string").select(names.truthy("q")).first()[0] is flag


def test_lists_and_ids(spark):
    df = spark.createDataFrame([(" a_AOI.geojson |b.x.geojson||",), (None,)], "c string")
    got = df.select(F.transform(names.pipe_values("c"), lambda x: names.sub_area_id(x))).collect()
    assert [list(r[0]) for r in got] == [["a", "b.x"], []]


def test_columns():
    assert names.column_like(["Dataset Code", "x"], "dataset_code") == "Dataset Code"
    assert names.url_column(["a", "tile_href"]) == "tile_href"
    with pytest.raises(KeyError):
        names.column_like(["x"], "y")


def test_all_matches_share_a_key(spark):
    """Names that any rule matches meet on a key, for random short names."""
    import random

    rng = random.Random(2)
    words = ["ab", "abc", "nairobi", "data", "v2", "2021", "lagosport", "c", "final", "é"]
    rows = [("".join(rng.choice(words) + rng.choice(["", "_", " "]) for _ in range(rng.randrange(1, 4))), "".join(rng.choice(words) + rng.choice(["", "_", " "]) for _ in range(rng.randrange(1, 5)))) for _ in range(400)]
    parts = spark.createDataFrame(rows, "c string, f string").select(names.name_parts("c").alias("c"), names.name_parts("f").alias("f")).repartition(2)
    scored = parts.select(names.match_score(F.col("c"), F.col("f")).alias("m"), F.arrays_overlap(names.code_keys(F.col("c")), names.folder_keys(F.col("f"))).alias("met")).collect()
    assert sum(r.m is not None for r in scored) > 40
    assert all(r.met for r in scored if r.m is not None)
