"""Top tiles and best FOVs. Ties are broken by key, so results are stable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, keys: list[str], score: str = "score") -> DataFrame:
    """The k best rows: per-partition heaps, no global sort."""
    return df.orderBy(F.desc(score), *keys).limit(k)


def top_k_by(df: DataFrame, k: int, by: list[str], keys: list[str], score: str = "score") -> DataFrame:
    """The k best rows of each group with their ``rank``; the limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *keys))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_or_none(df: DataFrame, k: int, keys: list[str], score: str = "score") -> DataFrame:
    """The k best rows; none at all where there are fewer than k."""
    best = top_k(df, k, keys, score)
    return best.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where(F.col("__n") >= k).drop("__n")


def best_fov(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Per slide the FOV of the largest mean score over its tiles; of equals, the one seen first. Of rows that repeat
    a tile (pixel_y, pixel_x) the last score counts."""
    fov = ["slide", "fov_y", "fov_x"]
    tiles = df.groupBy(*fov, "pixel_y", "pixel_x").agg(F.max_by("score", pos).alias("score"), F.min(pos).alias("first_pos"))
    means = tiles.groupBy(*fov).agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"), F.min("first_pos").alias("first_pos"))
    best = F.min_by(F.struct("fov_y", "fov_x", "mean_score", "n"), F.struct(-F.col("mean_score"), "first_pos")).alias("b")
    return means.groupBy("slide").agg(best).select("slide", "b.*")
