"""Incremental matches: files of matches that arrive are folded into running counts of each tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_tables(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tile_counts(matches: DataFrame) -> DataFrame:
    """Running number of matches and mean IoU of each tile; works on streams and tables."""
    return matches.groupBy("city", "dataset", "tile_id").agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"))


def write_counts(matches: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed tiles as parquet below batch=<n>; a batch that is run again replaces its own folder."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return tile_counts(matches).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each tile."""
    every = spark.read.option("basePath", out).parquet(out)
    last = every.groupBy("city", "dataset", "tile_id").agg(F.max_by(F.struct("tp", "mean_iou"), "batch").alias("s"))
    return last.select("city", "dataset", "tile_id", "s.tp", "s.mean_iou")
