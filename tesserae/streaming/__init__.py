"""Scoring of arriving tile files as a stream. An extension: batch functions on an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_stats(tiles: DataFrame) -> DataFrame:
    """count, min, max, mean of the scores of each slide so far."""
    return tiles.groupBy("slide").agg(F.count("score").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def append_scores(stream: DataFrame, path: str, checkpoint: str):
    """Appends a transformed stream to a table, once for each input row, and stops when all is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
