"""Jobs on pixels: scans to kept tiles, patches, dense re-scores and mosaics. FOVs come in Arrow batches of bounded
bytes; everything that can be decided by key is decided before pixels are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patch_name
from ..functions.image import block_mean, bound_batches, contour, demosaic
from ..operators import grid, overlap, rank

FOV_KEY = ["slide", "fov_y", "fov_x"]

#: Pixels of FOVs that are demosaiced at once, one FOV at least; bytes of patches after which they are passed on.
BLOCK_PX, PASS_BYTES = 1 << 20, 16 << 20


def _interior(scans: DataFrame, y_border: int, x_border: int, shape: tuple[int, int] | None) -> DataFrame:
    """FOVs inside the border ring. With a known shape the bounds reach the scan; else each slide's own is looked up
    first, from its keys."""
    if shape is not None:
        return grid.inside(scans, *shape, y_border, x_border)
    ends = scans.groupBy("slide").agg((F.max("fov_y") + 1).alias("__y"), (F.max("fov_x") + 1).alias("__x"))
    inner = (F.col("fov_y") >= y_border) & (F.col("fov_y") < F.col("__y") - y_border) & (F.col("fov_x") >= x_border) & (F.col("fov_x") < F.col("__x") - x_border)
    return scans.join(ends, "slide").where(inner).drop("__y", "__x")


def _with_masks(scans: DataFrame, masks: DataFrame | None) -> DataFrame:
    """scans with ``mask``; null where a FOV has none."""
    rows = scans.select(*FOV_KEY, "h", "w", "raw")
    if masks is None:
        return rows.withColumn("mask", F.lit(None).cast("binary"))
    return rows.join(masks.select(*FOV_KEY, "mask"), FOV_KEY, "left")


def _mask(r) -> np.ndarray | None:
    return None if r.mask is None else np.frombuffer(r.mask, np.uint8).reshape(r.h, r.w) > 0


def kept_tiles(scans: DataFrame, tile: int = 256, pixel_border: int = 0, masks: DataFrame | None = None, y_border: int = 2, x_border: int = 2, shape: tuple[int, int] | None = None) -> DataFrame:
    """The unmarked tiles (slide, fov_y, fov_x, pixel_y, pixel_x, pixels: RGB) of the interior FOVs of scans.

    Each FOV is cut to the largest region inside ``pixel_border`` that tiles fill, and only then demosaiced; a FOV
    whose tiles are all marked is not demosaiced at all. A FOV without a mask is unmarked."""
    bound_batches(scans.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ny, nx = (max(0, (n - 2 * pixel_border) // tile) for n in (r.h, r.w))
                cut = (slice(pixel_border, pixel_border + ny * tile), slice(pixel_border, pixel_border + nx * tile))
                marks = _mask(r)
                keep = np.ones((ny, nx), bool) if marks is None else ~marks[cut].reshape(ny, tile, nx, tile).any((1, 3))
                if not keep.any():
                    continue
                rgb = demosaic(np.frombuffer(r.raw, np.uint8).reshape(r.h, r.w)[cut])
                blocks = rgb.reshape(ny, tile, nx, tile, 3).swapaxes(1, 2)
                at = np.argwhere(keep)
                out = pd.DataFrame({"slide": r.slide, "fov_y": r.fov_y, "fov_x": r.fov_x, "pixel_y": at[:, 0] * tile + pixel_border, "pixel_x": at[:, 1] * tile + pixel_border})
                yield out.assign(pixels=[blocks[a, b].tobytes() for a, b in at])

    inner = _with_masks(_interior(scans, y_border, x_border, shape), masks)
    return inner.mapInPandas(rows, "slide string, fov_y int, fov_x int, pixel_y int, pixel_x int, pixels binary")


def cut_patches(annotations: DataFrame, scans: DataFrame, size: int = 256) -> DataFrame:
    """Annotated patches with pixels: (filepath, label, h, w, pixels, and the annotation's top_left_px_x, top_left_px_y).

    Annotations are in the view turned a quarter clockwise: ``top_left_px_x`` is the row and ``top_left_px_y`` the
    column of the raw FOV, and the cut patch is turned back. Patches that cross the FOV's edge are smaller. Labels
    other than 0 and 1 are left out. A FOV is demosaiced once, small ones of one shape together; patches travel in
    batches of bounded bytes."""
    bound_batches(scans.sparkSession)
    wanted = annotations.where(F.col("label").isin(0, 1)).withColumn("filepath", patch_name(*map(F.col, ("slide", "fov_r", "fov_c", "patch_r", "patch_c"))))
    corner = [F.col(c).cast("int").alias(c) for c in ("top_left_px_x", "top_left_px_y")]
    each = F.collect_list(F.struct("filepath", F.col("label").cast("int").alias("label"), *corner)).alias("patches")
    wanted = wanted.groupBy("slide", F.col("fov_r").alias("fov_y"), F.col("fov_c").alias("fov_x")).agg(each)
    names = ["filepath", "label", "h", "w", "pixels", "top_left_px_x", "top_left_px_y"]
    schema = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()))))

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray]]:
        """(lists of patches, RGB of their FOVs): consecutive FOVs of one shape."""
        h, w, raw, patches = (batch.column(k) for k in range(4))
        shapes, begin = list(zip(h.to_pylist(), w.to_pylist())), 0
        while begin < len(shapes):
            (y, x), end = shapes[begin], begin + 1
            while end < len(shapes) and shapes[end] == (y, x) and (end + 1 - begin) * y * x <= BLOCK_PX:
                end += 1
            yield patches.slice(begin, end - begin).to_pylist(), demosaic(np.stack([np.frombuffer(raw[k].as_buffer(), np.uint8).reshape(y, x) for k in range(begin, end)]))
            begin = end

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for lists, rgb in blocks(batch):
                for fov, patches in zip(rgb, lists):
                    for p in patches:
                        y, x = p["top_left_px_x"], p["top_left_px_y"]
                        patch = np.rot90(fov[y : y + size, x : x + size])
                        out.append((p["filepath"], p["label"], *patch.shape[:2], patch.tobytes(), y, x))
                        held += patch.nbytes
                        if held >= PASS_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    kinds = "filepath string, label int, h int, w int, pixels binary, top_left_px_x int, top_left_px_y int"
    return scans.join(wanted, FOV_KEY).select("h", "w", "raw", "patches").mapInArrow(rows, kinds)


def window_scores(scans: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int, stride: int, border: int = 0, masks: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """(slide, fov_y, fov_x, i, j, score) of the sliding windows of whole FOVs that hold no marked pixel. The model
    takes a batch of RGB windows (n, tile, tile, 3). Windows overlap, so they are scored where they are cut."""
    bound_batches(scans.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                marks = _mask(r)
                at = [(i, j) for i in range(border, r.h - border - tile + 1, stride) for j in range(border, r.w - border - tile + 1, stride) if marks is None or not marks[i : i + tile, j : j + tile].any()]
                if not at:
                    continue
                rgb = demosaic(np.frombuffer(r.raw, np.uint8).reshape(r.h, r.w))
                scores = [np.asarray(model(np.stack([rgb[i : i + tile, j : j + tile] for i, j in at[k : k + batch]])), float).reshape(-1) for k in range(0, len(at), batch)]
                where = np.array(at)
                yield pd.DataFrame({"slide": r.slide, "fov_y": r.fov_y, "fov_x": r.fov_x, "i": where[:, 0], "j": where[:, 1], "score": np.concatenate(scores)})

    return _with_masks(scans, masks).mapInPandas(rows, "slide string, fov_y int, fov_x int, i int, j int, score double")


def rescore_best(scored: DataFrame, scans: DataFrame, model: Callable[[np.ndarray], np.ndarray], h: int, w: int, tile: int, stride: int, border: int = 0, masks: DataFrame | None = None) -> DataFrame:
    """The best FOV of each slide of scored tiles (with pos), scored again densely and averaged over the cells that
    ``overlap.score_map`` gives. One row per slide decides which FOV that is; a semi join leaves only its pixels to the
    demosaic (of scans on disk, all rows of the slides pass the join)."""
    best = rank.best_fov(scored).select(*FOV_KEY)
    some = scans.join(best, FOV_KEY, "left_semi")
    return overlap.score_map(window_scores(some, model, tile, stride, border, masks), h, w, tile, stride, border)


def thumbnails(scans: DataFrame, out: int) -> DataFrame:
    """(slide, fov_y, fov_x, h, w, pixels) of FOVs, demosaiced and averaged down to out x out."""
    bound_batches(scans.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            small = [block_mean(demosaic(np.frombuffer(r.raw, np.uint8).reshape(r.h, r.w)), out).astype(np.uint8).tobytes() for r in pdf.itertuples(index=False)]
            yield pdf[FOV_KEY].assign(h=out, w=out, pixels=small)

    return scans.select(*FOV_KEY, "h", "w", "raw").mapInPandas(rows, "slide string, fov_y int, fov_x int, h int, w int, pixels binary")


def mosaic(small: DataFrame) -> DataFrame:
    """(slide, h, w, pixels): the thumbnails of each slide side by side, absent ones black. A slide's picture is one
    row, as the thumbnails are small."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["h"].iat[0]), int(pdf["w"].iat[0])
        rows, cols = int(pdf["fov_y"].max()) + 1, int(pdf["fov_x"].max()) + 1
        whole = np.zeros((rows * h, cols * w, 3), np.uint8)
        for r in pdf.itertuples(index=False):
            whole[r.fov_y * h : (r.fov_y + 1) * h, r.fov_x * w : (r.fov_x + 1) * w] = np.frombuffer(r.pixels, np.uint8).reshape(h, w, 3)
        return pd.DataFrame({"slide": [pdf["slide"].iat[0]], "h": [rows * h], "w": [cols * w], "pixels": [whole.tobytes()]})

    return small.groupBy("slide").applyInPandas(build, "slide string, h int, w int, pixels binary")


def slide_arrays(scores: DataFrame, scans: DataFrame, tiles_y: int, tiles_x: int, out: int, scale: int = 1) -> tuple[DataFrame, DataFrame]:
    """(score grid, mosaic) of slides: the dense tile grid with each cell repeated ``scale`` times, and the picture."""
    return grid.dense_scores(scores, tiles_y, tiles_x, scale), mosaic(thumbnails(scans, out))


def mask_contours(masks: DataFrame, h: int, w: int) -> DataFrame:
    """(slide, fov_y, fov_x, y, x) of the contour pixels of masks, for an overlay."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                at = np.argwhere(contour(np.frombuffer(r.mask, np.uint8).reshape(h, w)))
                yield pd.DataFrame({"slide": r.slide, "fov_y": r.fov_y, "fov_x": r.fov_x, "y": at[:, 0], "x": at[:, 1]})

    return masks.select(*FOV_KEY, "mask").mapInPandas(rows, "slide string, fov_y int, fov_x int, y int, x int")
