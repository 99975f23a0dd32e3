"""Connected components by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm.hot import hot_keys, join_hot
from gridproof.llm.packs import discard
from gridproof.sources.scratch import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node of its component.

    Each round a node takes the smallest root of its neighbours, then the root of
    that root, so rounds grow with the logarithm of a path's length.  Minima are
    aggregated before the shuffle; a node with very many edges, or a root of very
    many nodes, is no shuffle key, as hot keys are joined apart.  Null ends are
    ignored.
    """
    pairs = edges.where("u <> v").select("u", "v")
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root"), F.count("*").alias("n")).withColumn("moved", F.lit(True)))
    # edges go both ways, so a node is as often an end as a start
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hubs = hot_keys(labels, "node", "n", total)
    while not labels.where("moved").isEmpty():
        near = join_hot(both, labels.select(F.col("node").alias("v"), "root"), "v", hubs).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = written(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        top = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        members = step.groupBy("root").count()
        new = written(join_hot(step, top, "root", hot_keys(members, "root", "count", step.count())).select("node", F.least("root", "top").alias("root"), (F.least("root", "top") != F.col("old")).alias("moved")))
        discard(labels, step)
        labels = new
    return labels.select("node", "root")
