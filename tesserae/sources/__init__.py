"""Readers. Every reader has an explicit schema and fails on what it cannot read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCORE_CSV, TILES


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and number in it (from 1); blank lines are left out but counted. A file
    is read by one task, as its lines are numbered: for lists, not for bulk data."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return raw.select("path", (F.col("line") + 1).alias("line"), "value").where(F.trim(F.translate("value", "\r\t", "  ")) != "")


def slide_diagnoses(spark: SparkSession, path: str) -> DataFrame:
    """(slide, dx) from JSON lines (patient_id, slide, label). The slide's key joins both ids; the last line of
    a slide wins (of several files, that of the last path); blank lines are skipped; a malformed line is an error."""
    kind = "patient_id string, slide string, label int"
    rows = _lines(spark, path).select("path", "line", F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r"))
    return rows.groupBy(F.concat("r.patient_id", "r.slide").alias("slide")).agg(F.max_by("r.label", F.struct("path", "line")).alias("dx"))


def slide_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, patient_id) of JSON lines, duplicates kept. A line without the field is an error that names the
    file and line; so is a list without lines."""
    rows = _lines(spark, path).select("path", "line", F.get_json_object("value", "$.patient_id").alias("patient_id"))
    bad = rows.where("patient_id IS NULL").orderBy("path", "line").first()
    if bad:
        raise ValueError(f"{bad['path']}:{bad['line']}: no patient_id")
    if rows.isEmpty():
        raise ValueError(f"{path}: no slides")
    return rows


def score_csv(spark: SparkSession, path: str, score_column: str) -> DataFrame:
    """Score rows (slide, fov_y, fov_x, pixel_y, pixel_x, score, pos) of CSV files with a header. The slide is the
    file's name up to ``_scores.csv``. ``pos`` orders the rows by file and place in it. Files are read together, so
    each needs the header of the first; another one is an error, not a misread column."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in ("FOV_y", "FOV_x", "pixel_y", "pixel_x", score_column) if c not in header]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    kinds = {f.name: f.dataType.simpleString() for f in SCORE_CSV.fields}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'double' if c == score_column else 'string')}" for c in header)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    at = F.col("_metadata.file_path")
    pos = F.struct(at.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    slide = F.regexp_replace(F.regexp_extract(at, r"([^/]+)$", 1), r"(_scores)?\.csv$", "")
    return rows.select(slide.alias("slide"), F.col("FOV_y").alias("fov_y"), F.col("FOV_x").alias("fov_x"), "pixel_y", "pixel_x", F.col(score_column).alias("score"), pos.alias("pos"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, stem, slide) of the files below path whose name fits the pattern; ``slide`` is their folder's name.
    Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    part = lambda r: F.regexp_extract("path", r, 1)
    return files.select("path", part(r"([^/]+?)(?:\.[^./]*)?$").alias("stem"), part(r"([^/]+)/[^/]*$").alias("slide"))


def discover_bags(spark: SparkSession, root: str, slides: DataFrame, pattern: str = "bag_*.parquet") -> tuple[DataFrame, DataFrame]:
    """(bags, missing): the bag files (slide, path, bag) of the wanted slides (slide) below ``root/<slide>/``, in
    order, and the slides that have none, which a job reports and skips."""
    found = listing(spark, root, pattern).select("slide", "path", F.col("stem").alias("bag")).join(slides.select("slide").distinct(), "slide")
    return found.orderBy("path"), slides.select("slide").distinct().join(found, "slide", "left_anti").orderBy("slide")


def bags(spark: SparkSession, path: str, pattern: str = "bag_*.parquet", tile: int | None = None) -> DataFrame:
    """Tiles of all bag files of a directory, with their ``slide`` (the folder's name where the files have none),
    ``bag`` and ``pos``. No file is an error, and so are files without the columns of a bag, or with ``tile``
    pixels that are no tile x tile x 3 image."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    try:
        rows = rows.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        raise FileNotFoundError(f"{path}: no {pattern}") from e
    if missing := [c for c in TILES.names if c not in rows.columns and c != "slide"]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    at = F.col("_metadata.file_path")
    slide = F.regexp_extract(at, r"([^/]+)/[^/]*$", 1)
    pixels = F.col("pixels").cast("binary")
    if tile is not None:
        size = F.format_string(f"%s: pixels of %d bytes are no {tile} x {tile} x 3 tile", at, F.coalesce(F.octet_length("pixels"), F.lit(0)))
        pixels = F.when(F.octet_length("pixels") == 3 * tile * tile, pixels).otherwise(F.raise_error(size).cast("binary"))
    kept = [F.coalesce("slide", slide) if "slide" in rows.columns else slide]
    kept = [kept[0].alias("slide"), *[F.col(c).cast("int").alias(c) for c in TILES.names if c not in ("slide", "pixels")], pixels.alias("pixels")]
    return rows.select(*kept, F.regexp_extract(at, r"([^/]+)\.[^./]*$", 1).alias("bag"), F.col("_metadata.row_index").alias("pos"))


def features(spark: SparkSession, path: str, columns: tuple[str, ...] = ("cam_yx", "cam_xy")) -> DataFrame:
    """Feature rows with ``file``, fov_y, fov_x from the first FOV column that each file has. ``cam_xy`` is read in
    stored order, as written by older versions. Files with none of the columns are left out: see ``unmapped``."""
    rows = _feature_rows(spark, path, columns)
    return rows.where("__at IS NOT NULL").withColumn("fov_y", F.col("__at")[0].cast("int")).withColumn("fov_x", F.col("__at")[1].cast("int")).drop("__at")


def unmapped(spark: SparkSession, path: str, columns: tuple[str, ...] = ("cam_yx", "cam_xy")) -> DataFrame:
    """(file, rows) of the feature files that ``features`` leaves out, for a job's report."""
    return _feature_rows(spark, path, columns).where("__at IS NULL").groupBy("file").agg(F.count(F.lit(1)).alias("rows"))


def _feature_rows(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)
    found = [c for c in columns if c in rows.columns]
    at = F.coalesce(*found) if found else F.lit(None).cast("array<int>")
    return rows.withColumn("file", F.col("_metadata.file_path")).withColumn("__at", at).drop(*found)


def patch_images(spark: SparkSession, path: str) -> DataFrame:
    """(filepath, h, w, pixels: RGB bytes) of image files, decoded by Spark's reader (which gives BGR)."""
    from ..functions.image import bgr_to_rgb

    rows = spark.read.format("image").load(path)
    return rows.select(F.col("image.origin").alias("filepath"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), bgr_to_rgb(F.col("image.data")).alias("pixels"))


def masks(spark: SparkSession, path: str, h: int, w: int) -> DataFrame:
    """(slide, fov_y, fov_x, mask: 0/255 bytes of h*w) of ``<slide>_<row>_<col>.npy`` and ``.tif`` files in a folder.
    Where a FOV has both, the NPY file counts. A FOV without a file has no row: join left, absent means unmarked."""
    from ..functions.image import load_mask, mask_of_image

    name, keys = r"([^/]+)_(\d+)_(\d+)\.(?:npy|tif)$", ["slide", "fov_y", "fov_x"]

    def named(at: str, mask) -> list:
        return [F.regexp_extract(at, name, 1).alias("slide"), *[F.regexp_extract(at, name, k).cast("int").alias(c) for k, c in ((2, "fov_y"), (3, "fov_x"))], mask.alias("mask")]

    options = {"recursiveFileLookup": True}
    arrays = spark.read.format("binaryFile").options(pathGlobFilter="*.npy", **options).load(path).select(*named("path", load_mask(h, w)("content")))
    images = spark.read.format("image").options(pathGlobFilter="*.tif", **options).load(path)
    pixels = mask_of_image(h, w)("image.height", "image.width", "image.nChannels", "image.data")
    images = images.select(*named("image.origin", pixels))
    return arrays.unionByName(images.join(arrays.select(*keys), keys, "left_anti"))
