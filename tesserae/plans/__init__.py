"""Whole jobs, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patch_name, slide_of
from ..operators import lookup, rank, split, stats


def attach_scores(features: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Scored tiles onto feature rows: last score per key, 0 where there is none."""
    return lookup.attach(features, tiles.select(*keys, "score", "pos"), keys, "score")


def score_bags(tiles: DataFrame, features: DataFrame, matches: DataFrame, model, tile: int, size: int = 224) -> tuple[DataFrame, DataFrame]:
    """(scored, mapped): tiles of bags (slide, bag, pos, keys, pixels) with their score and without pixels; and
    feature rows (slide, feature, keys) with the score of the bag whose feature file they are in, 0 where that has
    none. matches (bag, feature) as of ``lookup.feature_files``. Persist or write scored before using mapped."""
    from ..functions.image import score_pixels

    keys = ["fov_y", "fov_x", "pixel_y", "pixel_x"]
    scored = score_pixels(tiles, model, tile, size=size).drop("pixels")
    own = features.join(matches, "feature")
    return scored, lookup.attach(own, scored.select("slide", "bag", *keys, "score", "pos"), ["slide", "bag", *keys], "score")


def join_slide_scores(csv: DataFrame, bags: DataFrame, features: DataFrame, matches: DataFrame, name: str = "blurred_rs") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bags, features, skipped): CSV score rows (slide, keys, score, pos) joined onto the tiles of bags (slide, bag, keys)
    and onto the rows of the bags' feature files (slide, feature, keys), all slides at once; and the slides that have
    no scores, whose rows are left out."""
    keys = ["slide", "fov_y", "fov_x", "pixel_y", "pixel_x"]
    known = csv.select("slide").distinct()
    build = csv.select(*keys, F.col("score").alias(name), "pos")
    onto = lambda rows: lookup.attach(rows.join(known, "slide", "left_semi"), build, keys, name)
    skipped = bags.select("slide").distinct().join(known, "slide", "left_anti")
    own = bags.select("slide", "bag").distinct().join(matches, "bag").select("slide", "feature").distinct()
    return onto(bags), onto(features.join(own, ["slide", "feature"], "left_semi")), skipped


def slide_report(tiles: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """What is reported about scored slides. Persist tiles first if they are costly."""
    keys = ["fov_y", "fov_x", "pixel_y", "pixel_x", "pos"]
    return {"stats": stats.score_stats(tiles, ["slide"]), "histogram": stats.histogram(tiles, by=["slide"]), "top": rank.top_k_by(tiles, k, ["slide"], keys), "best_fov": rank.best_fov(tiles)}


def extract_patches(annotations: DataFrame, existing: DataFrame | None = None, slide: str | None = None, fov: tuple[int, int] | None = None) -> DataFrame:
    """Annotated patches to cut: labels 0 and 1 only, named, without those whose file exists. slide and fov
    pick one FOV for a trial."""
    rows = annotations.where(F.col("label").isin(0, 1))
    if slide is not None:
        rows = rows.where(F.col("slide") == slide)
    if fov is not None:
        rows = rows.where((F.col("fov_r") == fov[0]) & (F.col("fov_c") == fov[1]))
    rows = rows.withColumn("filepath", patch_name(*map(F.col, ("slide", "fov_r", "fov_c", "patch_r", "patch_c"))))
    return rows if existing is None else lookup.not_yet(rows, existing, ["filepath"])


def make_splits(patches: DataFrame, mode: str, seed: int, diagnoses: DataFrame | None = None, pinned: list[str] = ()) -> DataFrame:
    """Patches (filepath, label) with slide and split; mode ``slide`` or ``random``."""
    rows = patches.withColumn("slide", slide_of(F.col("filepath")))
    if mode == "random":
        return split.random_split(rows, "filepath", seed)
    if mode != "slide" or diagnoses is None:
        raise ValueError("mode is 'random', or 'slide' with diagnoses")
    return split.slide_split(rows, diagnoses, seed, pinned)


def evaluate(scored: DataFrame, by: list[str] = ("split",)) -> dict[str, DataFrame]:
    """Metrics of a scored table (label, score, and ``by``)."""
    by = list(by)
    return {"metrics": stats.binary_metrics(scored, by), "report": stats.class_report(scored, by), "confusion": stats.confusion(scored, by), "auc": stats.auc(scored, by), "roc": stats.roc_points(scored, by)}


def only_one(**options) -> str:
    """The name of the single option that is given; an error if none or several are."""
    given = [k for k, v in options.items() if v is not None]
    if len(given) != 1:
        raise ValueError(f"give exactly one of {', '.join(options)}")
    return given[0]
