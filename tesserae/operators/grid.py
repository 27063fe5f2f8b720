"""FOV and tile grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fov_grid(slides: DataFrame, rows: str = "n_y", cols: str = "n_x", y_border: int = 2, x_border: int = 2) -> DataFrame:
    """All FOVs of slides (slide, n_y, n_x) inside a border ring."""
    def inner(n: str, border: int):
        stop = F.col(n) - border - 1
        return F.explode(F.when(stop >= border, F.sequence(F.lit(border), stop)).otherwise(F.array().cast("array<int>")))

    return slides.withColumn("fov_y", inner(rows, y_border)).withColumn("fov_x", inner(cols, x_border)).select("slide", "fov_y", "fov_x")


def inside(df: DataFrame, n_y: int, n_x: int, y_border: int = 2, x_border: int = 2) -> DataFrame:
    """Rows in interior FOVs; a plain predicate that reaches the scan."""
    return df.where(F.col("fov_y").between(y_border, n_y - y_border - 1) & F.col("fov_x").between(x_border, n_x - x_border - 1))


def tile_grid(fovs: DataFrame, tiles_y: int, tiles_x: int) -> DataFrame:
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return fovs.withColumn("tile_y", axis(tiles_y)).withColumn("tile_x", axis(tiles_x))


def dense_scores(scores: DataFrame, tiles_y: int, tiles_x: int, scale: int = 1) -> DataFrame:
    """Scores (slide, fov_y, fov_x, tile_y, tile_x, score; one row per tile) on the dense tile grid of each FOV
    that has any, absent tiles 0; ``scale`` repeats each cell along both axes."""
    keys = ["slide", "fov_y", "fov_x", "tile_y", "tile_x"]
    held = scores.where(F.col("tile_y").between(0, tiles_y - 1) & F.col("tile_x").between(0, tiles_x - 1))
    # the grid is laid per FOV group, so the same partitioning serves both steps
    cells = held.groupBy("slide", "fov_y", "fov_x").agg(F.map_from_entries(F.collect_list(F.struct(F.col("tile_y") * tiles_x + F.col("tile_x"), F.col("score")))).alias("m"))
    out = tile_grid(cells, tiles_y, tiles_x).withColumn("score", F.coalesce(F.try_element_at("m", F.col("tile_y") * tiles_x + F.col("tile_x")), F.lit(0.0)))
    if scale > 1:
        step = lambda: F.explode(F.sequence(F.lit(0), F.lit(scale - 1)))
        out = out.withColumn("__a", step()).withColumn("__b", step())
        out = out.withColumn("tile_y", F.col("tile_y") * scale + F.col("__a")).withColumn("tile_x", F.col("tile_x") * scale + F.col("__b"))
    return out.select(*keys, "score")


def fov_maps(scores: DataFrame) -> DataFrame:
    """Per FOV the map from tile to score (a FOV has a bounded number of tiles)."""
    entry = F.struct(F.struct("tile_y", "tile_x").alias("k"), F.col("score").alias("v"))
    return scores.groupBy("slide", "fov_y", "fov_x").agg(F.map_from_entries(F.collect_list(entry)).alias("scores"))
