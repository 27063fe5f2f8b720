"""The engine's relations, derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patch_name
from ..sources import tables


def _pos(*cols: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 15), 16, 10).cast("long")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored tiles: slide, fov_y, fov_x, pixel_y, pixel_x, score, label, split, pos. Keys repeat."""
    c = F.col
    cents = lambda x: F.round(c(x) * 100).cast("long")
    return tables(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (c("l_suppkey") % 12).cast("string")).alias("slide"), (c("l_partkey") % 27).cast("int").alias("fov_y"), (c("l_orderkey") % 54).cast("int").alias("fov_x"),
        (c("l_linenumber") % 8 * 256).cast("int").alias("pixel_y"), (F.floor("l_quantity").cast("int") % 8 * 256).alias("pixel_x"), F.round(c("l_discount") * 10, 2).alias("score"),
        (c("l_returnflag") == "R").cast("int").alias("label"), c("l_linestatus").alias("split"),
        _pos(c("l_orderkey"), c("l_partkey"), c("l_suppkey"), c("l_linenumber"), cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), c("l_returnflag"), c("l_linestatus")).alias("pos"),
        c("l_linenumber").alias("line"), c("l_orderkey").alias("source_key"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows on the same keys; every seventh order is shifted so that it has no tile."""
    rows = tiles(spark, sf_dir)
    shifted = F.col("pixel_x") + F.when(F.col("source_key") % 7 == 0, 1).otherwise(0)
    return rows.select("slide", "fov_y", "fov_x", "pixel_y", shifted.alias("pixel_x"), "pos")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled patches: doc_id, filepath, label, fov_r, fov_c."""
    rows = tables(spark, sf_dir, "labels").join(tables(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    r, q = (F.col("doc_id") % 27).cast("int"), (F.col("doc_id") % 54).cast("int")
    name = patch_name(F.col("source"), r, q, (F.col("doc_id") % 8).cast("int"), F.col("doc_id"))
    return rows.select("doc_id", F.concat_ws("/", F.lit("patches"), name).alias("filepath"), F.col("quality").alias("label"), r.alias("fov_r"), q.alias("fov_c"))


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "documents").select(F.col("source").alias("slide")).distinct()
    return rows.withColumn("dx", F.regexp_extract("slide", r"(\d+)", 1).cast("int") % 7)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return tables(spark, sf_dir, "events").select(c("user_id").alias("epoch"), c("event_type").alias("split"), F.round(c("value"), 4).alias("loss"), (c("event_id") % 2).cast("int").alias("label"), F.round(c("event_id") % 101 / F.lit(100.0), 2).alias("score"))


def marked(tile_rows: DataFrame) -> DataFrame:
    """Marked tiles: a fixed part of the keys."""
    return tile_rows.where((F.col("fov_y") * 31 + F.col("fov_x") * 17 + F.col("pixel_y") / 256 * 7 + F.col("pixel_x") / 256) % 5 == 0).select("slide", "fov_y", "fov_x", "pixel_y", "pixel_x").distinct()


#: Pixels along a derived FOV's axes, of its tiles, and of the border inside it; rows and columns of a slide's grid.
FOV_PX, TILE_PX, BORDER_PX, GRID = 18, 8, 1, (10, 10)


def _pixels(value) -> Column:
    """Bytes of a FOV from a column function of (y, x)."""
    at = F.sequence(F.lit(0), F.lit(FOV_PX * FOV_PX - 1))
    return F.unhex(F.array_join(F.transform(at, lambda k: F.lpad(F.hex(value(F.floor(k / FOV_PX), k % FOV_PX).cast("long")), 2, "0")), ""))


def _fovs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    slide = F.concat(F.lit("p"), F.floor(k / 100).cast("string"))
    return tables(spark, sf_dir, "part").select(slide.alias("slide"), F.floor(k % 100 / 10).cast("int").alias("fov_y"), (k % 10).cast("int").alias("fov_x"), k.alias("k"), F.col("p_size").alias("s"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FOVs of raw mosaics; every part is one. Pixel (y, x) is (k * 7 + y * 13 + x * 29 + y * x + s) % 256, so a FOV's bytes
    are those of one of 256 offsets, and are looked up. The keys are dealt out first: a file of parts is a few tasks, but
    its pixels are much larger."""
    at = np.arange(FOV_PX)
    place = at[:, None] * 13 + at * 29 + at[:, None] * at
    raw = F.array(*[F.lit(((place + v) % 256).astype(np.uint8).tobytes()) for v in range(256)])
    offset = ((F.col("k") * 7 + F.col("s")) % 256).cast("int")
    rows = _fovs(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "slide", "fov_y", "fov_x")
    return rows.select("slide", "fov_y", "fov_x", F.lit(FOV_PX).alias("h"), F.lit(FOV_PX).alias("w"), F.element_at(raw, offset + 1).alias("raw"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of every fourth size, with one marked pixel."""
    k, s = F.col("k"), F.col("s")
    mask = _pixels(lambda y, x: F.when((y == s % FOV_PX) & (x == k % FOV_PX), 255).otherwise(0))
    return _fovs(spark, sf_dir).where(s % 4 == 0).select("slide", "fov_y", "fov_x", mask.alias("mask"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of each FOV; some cross its edge."""
    k, s = F.col("k"), F.col("s")
    return _fovs(spark, sf_dir).select(
        "slide", F.col("fov_y").alias("fov_r"), F.col("fov_x").alias("fov_c"), (s % 5).cast("int").alias("patch_r"), (k % 7).cast("int").alias("patch_c"),
        (s % 14).cast("int").alias("top_left_px_x"), (k % 13).cast("int").alias("top_left_px_y"), (s % 4 - 1).cast("int").alias("label"),
    )


SQL = {
    "tiles": """tiles AS (SELECT 's' || CAST(l_suppkey % 12 AS VARCHAR) AS slide, CAST(l_partkey % 27 AS INTEGER) AS fov_y, CAST(l_orderkey % 54 AS INTEGER) AS fov_x,
  CAST(l_linenumber % 8 * 256 AS INTEGER) AS pixel_y, CAST(CAST(floor(l_quantity) AS INTEGER) % 8 * 256 AS INTEGER) AS pixel_x, round(l_discount * 10, 2) AS score,
  CAST(l_returnflag = 'R' AS INTEGER) AS label, l_linestatus AS split,
  ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
    CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus)), 1, 15))::BIGINT AS pos,
  l_linenumber AS line, l_orderkey AS source_key FROM lineitem)""",
    "features": "features AS (SELECT slide, fov_y, fov_x, pixel_y, CAST(pixel_x + CASE WHEN source_key % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS pixel_x, pos FROM tiles)",
    "patches": """patches AS (SELECT doc_id, 'patches/' || source || '__fovr' || (doc_id % 27) || '-fovc' || (doc_id % 54) || '__pr' || (doc_id % 8) || '-pc' || doc_id || '.jpg' AS filepath,
  quality AS label, CAST(doc_id % 27 AS INTEGER) AS fov_r, CAST(doc_id % 54 AS INTEGER) AS fov_c, source AS slide FROM labels JOIN documents USING (doc_id))""",
    "diagnoses": "diagnoses AS (SELECT DISTINCT source AS slide, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 7 AS dx FROM documents)",
    "epochs": "epochs AS (SELECT user_id AS epoch, event_type AS split, round(value, 4) AS loss, CAST(event_id % 2 AS INTEGER) AS label, round(event_id % 101 / 100::DOUBLE, 2) AS score FROM events)",
    "marked": "marked AS (SELECT DISTINCT slide, fov_y, fov_x, pixel_y, pixel_x FROM tiles WHERE (fov_y * 31 + fov_x * 17 + pixel_y // 256 * 7 + pixel_x // 256) % 5 = 0)",
    "fovs": """fovs AS (SELECT 'p' || (p_partkey // 100) AS slide, CAST(p_partkey % 100 // 10 AS INTEGER) AS fov_y, CAST(p_partkey % 10 AS INTEGER) AS fov_x, p_partkey AS k, p_size AS s FROM part)""",
    "raw": "raw AS (SELECT f.*, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, (k * 7 + y * 13 + x * 29 + y * x + s) % 256 AS v FROM fovs f CROSS JOIN range(18) a(y) CROSS JOIN range(18) b(x))",
    "kept": """kept AS (SELECT f.*, CAST(1 + 8 * a.i AS INTEGER) AS pixel_y, CAST(1 + 8 * b.i AS INTEGER) AS pixel_x FROM fovs f CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(i)
  WHERE fov_y BETWEEN 2 AND 7 AND fov_x BETWEEN 2 AND 7 AND NOT (s % 4 = 0 AND s % 18 BETWEEN 1 + 8 * a.i AND 8 + 8 * a.i AND k % 18 BETWEEN 1 + 8 * b.i AND 8 + 8 * b.i))""",
    "last": "last AS (SELECT slide, fov_y, fov_x, pixel_y // 256 AS tile_y, pixel_x // 256 AS tile_x, arg_max(score, pos) AS score, max(pos) AS pos FROM tiles GROUP BY ALL)",
}


def with_views(names: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
