"""Writers."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import filesystem


def write_scores_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Header ``FOV_y,FOV_x,pixel_y,pixel_x,score``, scores with six decimals."""
    out = df.select(F.col("fov_y").alias("FOV_y"), F.col("fov_x").alias("FOV_x"), "pixel_y", "pixel_x", F.format_string("%.6f", F.col("score").cast("double")).alias("score"))
    (out.coalesce(1) if one_file else out).write.option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").parquet(path)


def replace_column(df: DataFrame, path: str, name: str, values) -> None:
    """Writes df with a replaced or added column over the table at ``path`` that df was read from: to a path
    beside it first, then swapped in by two renames. If the second fails, the old table is put back; a driver
    that dies between them leaves it at ``<path>.old-*``."""
    spark = df.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fresh, old, at = Path(f"{path}.new-{uuid.uuid4().hex}"), Path(f"{path}.old-{uuid.uuid4().hex}"), Path(path)
    df.withColumn(name, values).write.parquet(fresh.toString())
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(at, old):
        raise OSError(f"could not move {path}")
    try:
        swapped = fs.rename(fresh, at)
    except Exception:
        fs.rename(old, at)
        raise
    if not swapped:
        fs.rename(old, at)
        raise OSError(f"could not replace {path}")
    fs.delete(old, True)


def write_patch_images(patches: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Writes one PNG file per row of patches (filepath, h, w, pixels: RGB bytes) below path, named after the file
    name in ``filepath`` with the ending ``.png``; returns the names written (filepath). Files that exist are
    skipped unless ``overwrite`` is set. A file appears under its name only when it is whole."""
    from ..functions.image import png

    named = patches.withColumn("filepath", F.concat(F.regexp_replace(F.element_at(F.split("filepath", "/"), -1), r"\.[^.]*$", ""), F.lit(".png")))
    if not overwrite:
        named = named.join(existing_files(df=patches, path=path), "filepath", "left_anti")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                part = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(png(r.h, r.w, r.pixels))
                fs.move(part, f"{root}/{r.filepath}")
            yield pdf[["filepath"]]

    return named.select("filepath", "h", "w", "pixels").mapInPandas(rows, "filepath string")


def existing_files(df: DataFrame, path: str) -> DataFrame:
    """(filepath) of the PNG files directly below path; none if there is no such folder."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "filepath string")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filepath"))


def write_patch_table(patches: DataFrame, path: str) -> None:
    """The label table (filepath, label) of all annotated patches, those written earlier included."""
    patches.select("filepath", F.col("label").cast("int").alias("label")).write.mode("overwrite").parquet(path)


def write_sidecars(scored: DataFrame, path: str) -> DataFrame:
    """One NPZ file ``<bag>_relevance.npz`` per bag of scored tiles (slide, bag, pos, fov_y, fov_x, pixel_y, pixel_x,
    score) below ``path/<slide>``, with relevance_scores, coords and cams in the order of pos; returns (slide, bag,
    n). A bag is one file, so its rows fit in one task."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        slide, bag = pdf["slide"].iat[0], pdf["bag"].iat[0]
        fs, root = filesystem(path)
        fs.create_dir(f"{root}/{slide}", recursive=True)
        held = io.BytesIO()
        np.savez(held, relevance_scores=pdf["score"].to_numpy(np.float32), coords=pdf[["pixel_y", "pixel_x"]].to_numpy(np.int32), cams=pdf[["fov_y", "fov_x"]].to_numpy(np.int32))
        with fs.open_output_stream(f"{root}/{slide}/{bag}_relevance.npz") as out:
            out.write(held.getvalue())
        return pd.DataFrame({"slide": [slide], "bag": [bag], "n": [len(pdf)]})

    columns = ["slide", "bag", "pos", "fov_y", "fov_x", "pixel_y", "pixel_x", "score"]
    return scored.select(*columns).groupBy("slide", "bag").applyInPandas(write, "slide string, bag string, n long")


def write_run_config(path: str, /, **config) -> None:
    """The settings of a run as sorted JSON in one file."""
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(json.dumps(config, indent=2, sort_keys=True, default=str).encode())


def write_results(frames: dict[str, DataFrame], path: str) -> None:
    """The frames of an evaluation, one Parquet table each below path."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def next_experiment(path: str, prefix: str) -> str:
    """``<prefix>_<number>`` with three digits, one above the largest among the folders below path; 001 without any."""
    from pyarrow import fs as pafs

    fs, root = filesystem(path)
    names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.type == pafs.FileType.Directory]
    taken = [int(n[len(prefix) + 1 :]) for n in names if n.startswith(f"{prefix}_") and n[len(prefix) + 1 :].isdecimal()]
    return f"{prefix}_{max(taken, default=0) + 1:03d}"
