"""Releases of a product over time: the newest one of a date, the file of a window, and composites of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_release(listing: DataFrame, pattern: str = r"(\d{4}-\d{2}-\d{2}(?:\.\d+)?)") -> DataFrame:
    """The greatest release named in the ``path`` of any row, as one row (release); names that sort as they follow in time."""
    found = F.regexp_extract("path", pattern, 1)
    return listing.agg(F.max(F.when(found != "", found)).alias("release"))


def as_of(asked: DataFrame, releases: DataFrame, by: Sequence[str], at: str, when: str) -> DataFrame:
    """asked with ``release``, the struct of its group's newest release not after the date ``at``, or NULL.

    One pass over both tables in order of time, so no pair of rows is ever made
    that isn't in the result; of releases of one time the last in order of all columns counts.
    """
    rest = [c for c in releases.columns if c not in by]
    own, new = F.struct(*[c for c in asked.columns if c not in by]), F.struct(*rest)
    none = releases.select(new.alias("r")).schema["r"].dataType
    every = asked.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_k"), own.alias("_own"), F.lit(None).cast(none).alias("_new"))
    every = every.unionByName(releases.where(F.col(when).isNotNull()).select(*by, F.col(when).alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(asked.select(own.alias("o")).schema["o"].dataType).alias("_own"), new.alias("_new")))
    order = Window.partitionBy(*by).orderBy("_t", "_k", "_new").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("release", F.last("_new", ignorenulls=True).over(order)).where("_k = 1")
    return found.select(*by, "_own.*", F.when(F.col("_t").isNotNull(), F.col("release")).alias("release")).select(*asked.columns, "release")


def composite(pixels: DataFrame, asked: DataFrame, keys: Sequence[str], when: str, at: str, days: int, band: str | None = None, bands: Sequence[str] = (), tie: Column | None = None) -> DataFrame:
    """asked dates by pixel: the newest value of each pixel that is at most ``days`` old on the date, NULL values left out.

    Of one day the first of ``bands`` counts, and bands not in it go; then the
    greatest ``tie``.  Both sides meet by spans of ``days`` days, so a pixel meets
    only the dates that it can serve and those of one span beside.
    """
    rows = pixels.where("value is not null")
    rank = F.lit(0)
    if band is not None:
        rank = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col(band)).cast("int")
        rows = rows.where(rank > 0)
    day = F.unix_date(F.to_date(when))
    rows = rows.select(*keys, "value", day.alias("_d"), (-rank).alias("_r"), (tie if tie is not None else F.lit(0)).alias("_tie")).withColumn("_span", F.floor(F.col("_d") / (days + 1)))
    dates = asked.select(F.col(at), F.unix_date(F.to_date(at)).alias("_at")).distinct()
    dates = dates.withColumn("_span", F.explode(F.array(F.floor(F.col("_at") / (days + 1)), F.floor(F.col("_at") / (days + 1)) - 1)))
    met = rows.join(dates, "_span").where((F.col("_d") <= F.col("_at")) & (F.col("_d") >= F.col("_at") - days))
    return met.groupBy(at, *keys).agg(F.max_by("value", F.struct("_d", "_r", "_tie")).alias("value"), F.date_from_unix_date(F.max("_d")).alias("newest"))
