"""Sinks: idempotent tables, CSV twins and GeoJSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return bool(done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done))


def drop_partitions(spark: SparkSession, path: str, column: str, values: Sequence[str]) -> None:
    """Deletes the folders of a partitioned table for some values of its first partition column."""
    jvm = spark._jvm
    for value in values:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)
        folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = (), csv: bool = False) -> bool:
    """Writes parquet, and CSV beside it, unless the table is complete already; says whether it wrote."""
    spark = df.sparkSession
    if not overwrite and exists(spark, path):
        return False
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    if csv:
        spark.read.parquet(path).write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}_csv")
    return True


def write_geojson(df: DataFrame, path: str, ring: str = "ring", overwrite: bool = False) -> bool:
    """A feature to a line, with all columns but the ring and ``holes`` as properties."""
    if not overwrite and exists(df.sparkSession, path):
        return False

    def points(r):
        return F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"]))

    rings = F.array(points(F.col(ring)))
    if "holes" in df.columns:
        rings = F.concat(rings, F.coalesce(F.transform("holes", points), F.array().cast("array<array<array<double>>>")))
    others = [c for c in df.columns if c not in (ring, "holes")]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"), F.struct(*others).alias("properties"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)
    return True
