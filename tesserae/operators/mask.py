"""Filtering tiles and windows by marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmarked_tiles(tiles: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles without any mark; a FOV without marks has none."""
    return tiles.join(marked.select(*keys).distinct(), keys, "left_anti")


def marked_tiles(pixels: DataFrame, tile: int, border: int = 0) -> DataFrame:
    """Tile blocks with a marked pixel, from pixels (slide, fov_y, fov_x, y, x, value)."""
    at = lambda c: F.floor((F.col(c) - border) / tile).cast("int")
    return pixels.where("value > 0").select("slide", "fov_y", "fov_x", at("y").alias("tile_y"), at("x").alias("tile_x")).distinct()


def window_grid(fovs: DataFrame, h: int, w: int, tile: int, stride: int, border: int = 0) -> DataFrame:
    """Top left corners (i, j) of the sliding windows of FOVs."""
    def axis(n: int):
        last = n - border - tile
        return F.explode(F.sequence(F.lit(border), F.lit(last), F.lit(stride)) if last >= border else F.array().cast("array<int>"))

    return fovs.withColumn("i", axis(h)).withColumn("j", axis(w))


def unmarked_windows(windows: DataFrame, marked: DataFrame, tile: int, stride: int, border: int = 0) -> DataFrame:
    """Windows (slide, fov_y, fov_x, i, j) that hold none of the marked pixels (slide, fov_y, fov_x, y, x).

    Each pixel names the bounded number of windows that can hold it, so an equi-join replaces the interval
    join."""
    def holders(c: str):
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - border - tile + 1) / stride)).cast("int")
        last = F.floor((F.col(c) - border) / stride).cast("int")
        return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))

    hit = marked.withColumn("__i", holders("y")).withColumn("__j", holders("x"))
    hit = hit.select("slide", "fov_y", "fov_x", (F.col("__i") * stride + border).alias("i"), (F.col("__j") * stride + border).alias("j")).distinct()
    return windows.join(hit, ["slide", "fov_y", "fov_x", "i", "j"], "left_anti")
