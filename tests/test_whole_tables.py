"""Queries over whole tables, counted against plain Python on a table with few divisible and some large keys."""

import math

from gridproof.queries import QUERIES


def test_boxes_of_all_references_are_split(spark, tmp_path):
    keys = range(1, 131)
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    expected = {}
    for k in keys:
        w, h = 4 + k % 23, 4 + k * 13 % 17
        if w * h >= 20:
            expected[k] = (math.ceil(w / 7) * math.ceil(h / 5), w * h)
    got = {}
    for r in QUERIES["split_bounds_all"](spark, str(tmp_path)).collect():
        n, area = got.get(r.bld_id, (0, 0))
        got[r.bld_id] = (n + 1, area + (r.x1 - r.x0) * (r.y1 - r.y0))
    assert got == expected


def test_tree_holds_all_customers(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1301)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")

    def path(k):
        return f"n{k}" if k <= 3 else f"{path(k // 3)}/n{k}"

    got = {r.id: (r.level, r.path, r.top_folder) for r in QUERIES["file_tree_all"](spark, str(tmp_path)).collect()}
    assert got == {k: (path(k).count("/") + 1, path(k), path(k).split("/")[0]) for k in range(1, 1301)}
