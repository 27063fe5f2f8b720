"""Averages of overlapping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FOV = ["slide", "fov_y", "fov_x"]


def score_map(windows: DataFrame, h: int, w: int, tile: int, stride: int, border: int = 0) -> DataFrame:
    """Mean score of the windows (slide, fov_y, fov_x, i, j, score; i, j in pixels) over each cell of
    stride x stride pixels, anchored at the border: cell_y, cell_x, score, n. Cells that no window covers have
    score 0 and n 0.

    A window covers ``tile/stride`` cells along each axis, so its sum is separable: a range frame over y,
    then one over x. Where the stride does not divide the tile, windows are spread over pixels (stride 1)."""
    if tile % stride:
        cell = lambda c: F.explode(F.sequence(F.col(c) - border, F.col(c) - border + tile - 1))
        spread = windows.withColumn("cell_y", cell("i")).withColumn("cell_x", cell("j"))
        sums = spread.groupBy(*_FOV, "cell_y", "cell_x").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
        rows, cols = h - 2 * border, w - 2 * border
        fovs = windows.select(*_FOV).distinct()
        cells = _cells(fovs, rows, cols).join(sums, [*_FOV, "cell_y", "cell_x"], "left")
    else:
        reach = tile // stride - 1
        steps = lambda n: max(0, (n - 2 * border - tile) // stride + 1)
        rows, cols = (steps(n) + reach if steps(n) else 0 for n in (h, w))
        own = windows.select(*_FOV, ((F.col("i") - border) / stride).cast("int").alias("cell_y"), ((F.col("j") - border) / stride).cast("int").alias("cell_x"), "score")
        own = own.groupBy(*_FOV, "cell_y", "cell_x").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
        cells = _cells(windows.select(*_FOV).distinct(), rows, cols).join(own, [*_FOV, "cell_y", "cell_x"], "left")
        # one shuffle on the FOV serves both passes
        for run, along in (("cell_x", "cell_y"), ("cell_y", "cell_x")):
            frame = Window.partitionBy(*_FOV, run).orderBy(along).rangeBetween(-reach, 0)
            cells = cells.withColumn("__s", F.sum("s").over(frame)).withColumn("__n", F.sum("n").over(frame)).drop("s", "n").withColumnsRenamed({"__s": "s", "__n": "n"})
    n = F.coalesce("n", F.lit(0).cast("long"))
    return cells.select(*_FOV, "cell_y", "cell_x", F.when(n > 0, F.col("s") / n).otherwise(0.0).alias("score"), n.alias("n"))


def _cells(fovs: DataFrame, rows: int, cols: int) -> DataFrame:
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>"))
    return fovs.withColumn("cell_y", axis(rows)).withColumn("cell_x", axis(cols))
