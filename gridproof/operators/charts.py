"""Tables behind the figures: histograms, box plots, sizes and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.functions.exprs import SIZE_EDGES, SIZE_LABELS, quantile, right_closed_bin


def iou_histogram(tiles: DataFrame, matches: DataFrame, bins: int = 30) -> DataFrame:
    """Counts of IoU in equal bins of [0, 1], with a 0 for each false positive and negative; the last bin holds 1.

    The zeros are added as counts, not as rows.
    """
    bin_of = F.least(F.lit(bins - 1), F.floor(F.col("iou") * bins)).cast("int")
    found = matches.groupBy("dataset", bin_of.alias("bin")).agg(F.count("*").alias("n"))
    zeros = tiles.groupBy("dataset").agg(F.sum(F.col("fp") + F.col("fn")).alias("n")).select("dataset", F.lit(0).alias("bin"), "n")
    out = found.unionByName(zeros).groupBy("dataset", "bin").agg(F.sum("n").alias("n"))
    return out.select("dataset", "bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), "n")


def mean_iou(tiles: DataFrame, matches: DataFrame) -> DataFrame:
    """Mean of what ``iou_histogram`` counts, by dataset: IoU of all matches, and 0 for each false positive and negative."""
    found = matches.groupBy("dataset").agg(F.sum("iou").alias("s"), F.count("iou").alias("n"))
    zeros = tiles.groupBy("dataset").agg(F.sum(F.col("fp") + F.col("fn")).alias("z"))
    total = F.coalesce("n", F.lit(0)) + F.coalesce("z", F.lit(0))
    return found.join(zeros, "dataset", "full").select("dataset", total.alias("n"), F.try_divide(F.coalesce("s", F.lit(0.0)), total).alias("mean_iou"))


def iou_by_class(matches: DataFrame, edges: Sequence[float] = SIZE_EDGES, labels: Sequence[str] = SIZE_LABELS) -> DataFrame:
    """IoU and area error by stated classes of reference area, of each dataset; empty classes have no row."""
    size = right_closed_bin("area_ref", edges, labels).alias("size_bin")
    return matches.groupBy("dataset", size).agg(F.count("*").alias("n"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.median("rel_area_error").alias("median_rel_area_error")).where("size_bin is not null")


def box_plot(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, and the extreme values within 1.5 quartile ranges, of each group."""
    q = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), quantile(value, 0.25).alias("q1"), F.median(value).alias("median"), quantile(value, 0.75).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, list(by)).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    ends = inside.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return q.join(ends, list(by), "left")


def iou_by_size(matches: DataFrame, quantiles: int = 4) -> DataFrame:
    """IoU by quantile bins of reference area, (lo, hi], of each dataset; equal edges fall together, so there may be fewer bins."""
    at = F.array(*[F.lit(k / quantiles) for k in range(quantiles + 1)])
    edges = matches.groupBy("dataset").agg(F.array_distinct(F.percentile("area_ref", at)).alias("edges"))
    placed = matches.join(edges, "dataset").withColumn("bin", F.size(F.filter(F.slice("edges", F.lit(2), F.greatest(F.lit(0), F.size("edges") - 2)), lambda e: F.col("area_ref") > e)))
    return placed.groupBy("dataset", "bin").agg(F.count("*").alias("n"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.min("area_ref").alias("min_area"), F.max("area_ref").alias("max_area"))


def pivot(cities: DataFrame, value: str, datasets: Sequence[str]) -> DataFrame:
    """A row for each city and a column for each dataset."""
    return cities.groupBy("city").pivot("dataset", list(datasets)).agg(F.first(value, ignorenulls=True))


def tile_map(tiles: DataFrame, metrics: DataFrame, value: str) -> DataFrame:
    """Every tile with a metric, NULL where it has none."""
    return tiles.join(metrics.select("city", "tile_id", "dataset", value), ["city", "tile_id"], "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))
