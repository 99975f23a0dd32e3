"""Roll-ups of city summaries over datasets, and the best dataset of a city."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridproof.functions.exprs import mean_dropping_missing, mean_missing_as_zero, precision_recall_f1


def weighted(df: DataFrame, values: Sequence[str], weight: str, by: Sequence[str], zero: bool = False) -> DataFrame:
    """Weighted means of columns by group; NULL keys are a group. ``zero`` counts a missing value as 0."""
    mean = mean_missing_as_zero if zero else mean_dropping_missing
    return df.groupBy(*by).agg(*[mean(v, weight).alias(f"{v}_wavg" if zero else f"{v}_weighted_mean") for v in values])


#: Names of the columns that are summed and averaged, in this and the raster roll-up.
VECTOR_SUMS = ("n_sub_areas", "n_tiles", "n_ref_total", "n_cand_total", "tp_total", "fp_total", "fn_total")
VECTOR_MEANS = ("precision_city", "recall_city", "f1_city", "iou_mean_tp", "iou_median_tp", "iou_p25_tp", "iou_p75_tp", "boundary_f_meanpair_tp", "rel_area_error_mean_tp", "rel_area_error_median_tp", "signed_area_bias_tp")


def vector_by_dataset(cities: DataFrame) -> DataFrame:
    """Sums, shares of the sums, medians of city shares, and means weighted by references; NULL datasets are left out.

    Columns that the cities don't have are left out too.
    """
    out = cities.where("dataset is not null").groupBy("dataset").agg(
        F.countDistinct("city").alias("n_cities"),
        *[F.sum(c).alias(c) for c in VECTOR_SUMS if c in cities.columns],
        *[F.median(f"{c}_city").alias(f"{c}_city_median") for c in ("precision", "recall", "f1")],
        *[mean_missing_as_zero(c, "n_ref_total").alias(f"{c}_wavg") for c in VECTOR_MEANS if c in cities.columns],
    )
    p, r, f1 = precision_recall_f1("tp_total", "fp_total", "fn_total", None)
    return out.withColumns({"precision_global": p, "recall_global": r, "f1_global": f1})


RASTER_SUMS = ("n_tiles", "valid_area_total_m2", "ref_area_total_m2", "pred_area_total_m2", "tp_total", "fp_total", "fn_total")
RASTER_MEANS = ("f1_area", "precision_area", "recall_area", "f1_tile_mean", "f1_tile_median", "rel_area_error_mean", "rel_area_error_median", "signed_area_bias", "quantity_disagreement_mean", "allocation_disagreement_mean")


def raster_by_dataset_grid(cities: DataFrame) -> DataFrame:
    """As ``vector_by_dataset``, by dataset, grid and resolution, weighted by valid area; NULL keys are groups."""
    out = cities.groupBy("dataset", "grid", "resolution_m").agg(
        F.countDistinct("city").alias("n_cities"),
        *[F.sum(c).alias(c) for c in RASTER_SUMS],
        *[F.median(f"{c}_area").alias(f"{c}_area_median") for c in ("precision", "recall", "f1")],
        *[mean_missing_as_zero(c, "valid_area_total_m2").alias(f"{c}_wavg") for c in RASTER_MEANS],
    )
    p, r, f1 = precision_recall_f1("tp_total", "fp_total", "fn_total", None)
    return out.withColumns({"precision_global": p, "recall_global": r, "f1_global": f1})


def best_per_group(df: DataFrame, by: Sequence[str], score: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Of each group, each column's first non-null value in order of the score downwards, then the tie column."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    picked = [F.first(c, ignorenulls=True).over(whole).alias(c) for c in (tie, *values)]
    return df.select(*by, *picked, F.row_number().over(order).alias("_k")).where("_k = 1").drop("_k")


def best_vector_per_city(cities: DataFrame) -> DataFrame:
    return best_per_group(cities, ["city"], "f1_city", "dataset", ["f1_city", "precision_city", "recall_city", "iou_mean_tp"])


def best_raster_per_city_grid(cities: DataFrame) -> DataFrame:
    return best_per_group(cities, ["city", "grid", "resolution_m"], "f1_area", "dataset", ["f1_area", "precision_area", "recall_area", "f1_tile_mean"])
