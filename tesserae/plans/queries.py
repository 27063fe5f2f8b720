"""One query per operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import grid, lookup, mask, overlap, rank, split, stats
from ..schema import KEY
from ..sources import tables
from . import extract_patches, make_splits, pixels, views
from . import join_slide_scores as join_scores
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROUND = 6


def query(sql: str | None = None, name_views: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(name_views, sql) if name_views else sql
        return f

    return add


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUND) for c in cols})


def _last(spark, d) -> DataFrame:
    """One row per tile, last score wins, with tile indices."""
    t = views.tiles(spark, d)
    rows = t.groupBy(*KEY).agg(F.max_by("score", "pos").alias("score"), F.max("pos").alias("pos"))
    return rows.withColumn("tile_y", fn.tile_index(F.col("pixel_y"), 256)).withColumn("tile_x", fn.tile_index(F.col("pixel_x"), 256))


@query(
    """, lut AS (SELECT slide, fov_y, fov_x, pixel_y, pixel_x, arg_max(score, pos) AS s FROM tiles GROUP BY ALL)
SELECT f.*, CAST(coalesce(s, 0) AS FLOAT) AS score, s IS NOT NULL AS matched FROM features f LEFT JOIN lut USING (slide, fov_y, fov_x, pixel_y, pixel_x)""",
    "tiles features",
)
def score_join(spark, d):
    return _score_join(spark, d)


def _score_join(spark, d):
    build = views.tiles(spark, d).select(*KEY, "score", F.col("pos").alias("build_pos"))
    return lookup.attach(views.features(spark, d), build, KEY, "score", pos="build_pos")


@query(
    """, lut AS (SELECT DISTINCT slide, fov_y, fov_x, pixel_y, pixel_x, true AS hit FROM tiles)
SELECT slide, count(*) AS n, count(hit) AS matched, count(*) - count(hit) AS unmatched FROM features LEFT JOIN lut USING (slide, fov_y, fov_x, pixel_y, pixel_x) GROUP BY slide""",
    "tiles features",
)
def unmatched_counts(spark, d):
    return lookup.match_counts(_score_join(spark, d), ["slide"])


@query("SELECT slide, count(score) AS n, min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS mean_score FROM tiles GROUP BY slide", "tiles")
def slide_stats(spark, d):
    return _r(stats.score_stats(views.tiles(spark, d), ["slide"]), "mean_score")


_HIST = """, b AS (SELECT slide, least(CAST(floor(score * 50) AS INTEGER), 49) AS bin, count(*) AS n FROM tiles WHERE score BETWEEN 0 AND 1 GROUP BY ALL),
a AS (SELECT slide, count(*) AS total FROM tiles GROUP BY slide)
SELECT slide, CAST(g.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, g.bin / 50::DOUBLE AS low{} FROM a CROSS JOIN range(50) AS g(bin) LEFT JOIN b USING (slide, bin)"""


@query(_HIST.format(""), "tiles")
def score_hist(spark, d):
    return stats.histogram(views.tiles(spark, d), by=["slide"])


@query(_HIST.format(", round(coalesce(n, 0) / total::DOUBLE, 6) AS share"), "tiles")
def score_hist_norm(spark, d):
    return _r(stats.histogram(views.tiles(spark, d), by=["slide"], normalise=True), "share")


_ORDER = "score DESC, slide, fov_y, fov_x, pixel_y, pixel_x, pos"


@query(f"SELECT slide, fov_y, fov_x, pixel_y, pixel_x, score, pos FROM tiles ORDER BY {_ORDER} LIMIT 20", "tiles")
def top_tiles(spark, d):
    return rank.top_k(views.tiles(spark, d).select(*KEY, "score", "pos"), 20, [*KEY, "pos"])


@query(f"SELECT slide, fov_y, fov_x, pixel_y, pixel_x, score, pos, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY {_ORDER}) AS rank FROM tiles) WHERE rank <= 20", "tiles")
def top_tiles_per_slide(spark, d):
    return rank.top_k_by(views.tiles(spark, d).select(*KEY, "score", "pos"), 20, ["slide"], [*KEY[1:], "pos"])


@query(f"SELECT slide, fov_y, fov_x, pixel_y, pixel_x, score, pos FROM tiles ORDER BY {_ORDER} LIMIT 8", "tiles")
def top8_poster(spark, d):
    return rank.top_k(top_tiles(spark, d), 8, [*KEY, "pos"])


@query(f"SELECT slide, fov_y, fov_x, pixel_y, pixel_x, score, pos FROM tiles WHERE (SELECT count(*) FROM tiles) >= 6 ORDER BY {_ORDER} LIMIT 6", "tiles")
def top6(spark, d):
    return rank.top_k_or_none(views.tiles(spark, d).select(*KEY, "score", "pos"), 6, [*KEY, "pos"])


@query(
    """, t AS (SELECT slide, fov_y, fov_x, pixel_y, pixel_x, arg_max(score, pos) AS score, min(pos) AS pos FROM tiles GROUP BY ALL),
m AS (SELECT slide, fov_y, fov_x, avg(score) AS mean_score, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY ALL)
SELECT slide, fov_y, fov_x, round(mean_score, 6) AS mean_score, n FROM m QUALIFY row_number() OVER (PARTITION BY slide ORDER BY mean_score DESC, first_pos) = 1""",
    "tiles",
)
def best_fov(spark, d):
    return _r(rank.best_fov(views.tiles(spark, d)), "mean_score")


@query("SELECT slide, fov_y, fov_x, count(*) AS n_tiles, round(sum(score), 6) AS total FROM last GROUP BY ALL", "tiles last")
def fov_map(spark, d):
    maps = grid.fov_maps(_last(spark, d))
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x)
    return maps.select("slide", "fov_y", "fov_x", F.size("scores").cast("long").alias("n_tiles"), F.round(total, ROUND).alias("total"))


@query(
    """SELECT f.slide, f.fov_y, f.fov_x, CAST(y.i AS INTEGER) AS tile_y, CAST(x.i AS INTEGER) AS tile_x, coalesce(l.score, 0) AS score
FROM (SELECT DISTINCT slide, fov_y, fov_x FROM last) f CROSS JOIN range(8) y(i) CROSS JOIN range(8) x(i)
LEFT JOIN last l ON l.slide = f.slide AND l.fov_y = f.fov_y AND l.fov_x = f.fov_x AND l.tile_y = y.i AND l.tile_x = x.i""",
    "tiles last",
)
def tile_grid(spark, d):
    return grid.dense_scores(_last(spark, d), 8, 8)


@query("SELECT 's' || CAST(k AS VARCHAR) AS slide, CAST(y.i AS INTEGER) AS fov_y, CAST(x.i AS INTEGER) AS fov_x FROM (SELECT DISTINCT l_suppkey % 12 AS k FROM lineitem) CROSS JOIN range(2, 25) y(i) CROSS JOIN range(2, 52) x(i)")
def interior_fovs(spark, d):
    slides = views.tiles(spark, d).select("slide").distinct().withColumn("n_y", F.lit(27)).withColumn("n_x", F.lit(54))
    return grid.fov_grid(slides)


@query("SELECT slide, fov_y, fov_x, pixel_y, pixel_x, score, pos FROM tiles WHERE fov_y BETWEEN 2 AND 24 AND fov_x BETWEEN 2 AND 51", "tiles")
def interior_tiles(spark, d):
    return grid.inside(views.tiles(spark, d).select(*KEY, "score", "pos"), 27, 54)


@query("SELECT p_partkey, 3 AS y0, CAST(3 + greatest(0, floor((p_size * 64 - 6) / 256)) * 256 AS INTEGER) AS y1, CAST(greatest(0, floor((p_size * 64 - 6) / 256)) AS INTEGER) AS rows, 3 AS x0, CAST(3 + greatest(0, floor((p_size * 48 - 6) / 256)) * 256 AS INTEGER) AS x1, CAST(greatest(0, floor((p_size * 48 - 6) / 256)) AS INTEGER) AS cols FROM part")
def crop_region(spark, d):
    return tables(spark, d, "part").select("p_partkey", *fn.crop_bounds(F.col("p_size") * 64, F.col("p_size") * 48, 256, 3))


@query("SELECT slide, fov_y, fov_x, pixel_y, pixel_x, score, pos FROM tiles ANTI JOIN marked USING (slide, fov_y, fov_x, pixel_y, pixel_x)", "tiles marked")
def mask_filter(spark, d):
    t = views.tiles(spark, d).select(*KEY, "score", "pos")
    return mask.unmarked_tiles(t, views.marked(t), KEY)


def _windows(spark, d) -> DataFrame:
    return views.tiles(spark, d).select("slide", "fov_y", "fov_x", (F.col("pixel_y") / 256 * 16).cast("int").alias("i"), (F.col("pixel_x") / 256 * 16).cast("int").alias("j"), "score")


@query(
    """, w AS (SELECT slide, fov_y, fov_x, pixel_y // 256 AS a, pixel_x // 256 AS b, score FROM tiles), f AS (SELECT DISTINCT slide, fov_y, fov_x FROM w),
s AS (SELECT slide, fov_y, fov_x, a + y.i AS cell_y, b + x.i AS cell_x, sum(score) AS s, count(*) AS n FROM w CROSS JOIN range(4) y(i) CROSS JOIN range(4) x(i) GROUP BY ALL)
SELECT f.slide, f.fov_y, f.fov_x, CAST(y.i AS INTEGER) AS cell_y, CAST(x.i AS INTEGER) AS cell_x, round(coalesce(s.s / s.n, 0), 6) AS score, CAST(coalesce(s.n, 0) AS BIGINT) AS n
FROM f CROSS JOIN range(11) y(i) CROSS JOIN range(11) x(i) LEFT JOIN s ON s.slide = f.slide AND s.fov_y = f.fov_y AND s.fov_x = f.fov_x AND s.cell_y = y.i AND s.cell_x = x.i""",
    "tiles",
)
def overlap_map(spark, d):
    return _r(overlap.score_map(_windows(spark, d), 176, 176, 64, 16), "score")


@query(
    """SELECT slide, fov_y, fov_x, i, j FROM (SELECT f.*, CAST(y.i * 128 AS INTEGER) AS i, CAST(x.i * 128 AS INTEGER) AS j FROM (SELECT DISTINCT slide, fov_y, fov_x FROM tiles) f CROSS JOIN range(7) y(i) CROSS JOIN range(7) x(i)) w
ANTI JOIN marked m ON m.slide = w.slide AND m.fov_y = w.fov_y AND m.fov_x = w.fov_x AND m.pixel_y BETWEEN w.i AND w.i + 255 AND m.pixel_x BETWEEN w.j AND w.j + 255""",
    "tiles marked",
)
def window_filter(spark, d):
    t = views.tiles(spark, d)
    marks = views.marked(t).select("slide", "fov_y", "fov_x", F.col("pixel_y").alias("y"), F.col("pixel_x").alias("x"))
    return mask.unmarked_windows(mask.window_grid(t.select("slide", "fov_y", "fov_x").distinct(), 1024, 1024, 256, 128), marks, 256, 128)


_CELLS = ", c AS (SELECT split, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn FROM tiles GROUP BY split)\n"


@query(_CELLS + "SELECT split, 0 AS label, 0 AS predicted, tn AS n FROM c UNION ALL SELECT split, 0, 1, fp FROM c UNION ALL SELECT split, 1, 0, fn FROM c UNION ALL SELECT split, 1, 1, tp FROM c", "tiles")
def confusion(spark, d):
    return stats.confusion(views.tiles(spark, d), ["split"])


@query(_CELLS + "SELECT split, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM c", "tiles")
def binary_metrics(spark, d):
    return _r(stats.binary_metrics(views.tiles(spark, d), ["split"]), "accuracy", "precision", "recall", "f1")


@query(
    _CELLS.rstrip() + """, k AS (SELECT split, '0' AS class, tn AS t, fn AS p, fp AS m FROM c UNION ALL SELECT split, '1', tp, fp, fn FROM c),
r AS (SELECT split, class, coalesce(t / nullif(t + p, 0)::DOUBLE, 0) AS precision, coalesce(t / nullif(t + m, 0)::DOUBLE, 0) AS recall, coalesce(2 * t / nullif(2 * t + p + m, 0)::DOUBLE, 0) AS f1, t + m AS support FROM k)
SELECT split, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r
UNION ALL SELECT split, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r GROUP BY split
UNION ALL SELECT split, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r GROUP BY split""",
    "tiles",
)
def class_report(spark, d):
    return _r(stats.class_report(views.tiles(spark, d), ["split"]), "precision", "recall", "f1")


_BY_SCORE = ", g AS (SELECT split, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM tiles GROUP BY ALL)\n"


@query(_BY_SCORE + "SELECT a.split, round(sum(a.p * b.q * CASE WHEN a.score > b.score THEN 1::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / (sum(DISTINCT t.np) * sum(DISTINCT t.nq)), 6) AS auc FROM g a JOIN g b USING (split) JOIN (SELECT split, sum(p)::DOUBLE AS np, sum(q)::DOUBLE AS nq FROM g GROUP BY split) t USING (split) GROUP BY a.split", "tiles")
def auc(spark, d):
    return _r(stats.auc(views.tiles(spark, d), ["split"]), "auc")


@query(
    _BY_SCORE.rstrip() + """, t AS (SELECT split, sum(p)::DOUBLE AS np, sum(q)::DOUBLE AS nq FROM g GROUP BY split),
r AS (SELECT split, score AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp FROM g WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT split, threshold, tp, fp, round(tp / np, 6) AS tpr, round(fp / nq, 6) AS fpr FROM r JOIN t USING (split)
UNION ALL SELECT split, 'inf'::DOUBLE, 0, 0, 0, 0 FROM t""",
    "tiles",
)
def roc_points(spark, d):
    return _r(stats.roc_points(views.tiles(spark, d), ["split"]), "tpr", "fpr")


@query(
    """, b AS (SELECT split, source_key % 64 AS batch, avg(-(label * greatest(-100, CASE WHEN score > 0 THEN ln(score) ELSE -100 END) + (1 - label) * greatest(-100, CASE WHEN score < 1 THEN ln(1 - score) ELSE -100 END))) AS m, count(*) AS c FROM tiles GROUP BY ALL)
SELECT split, round(avg(m), 6) AS loss, round(sum(m * c) / sum(c), 6) AS row_loss, count(*) AS batches FROM b GROUP BY split""",
    "tiles",
)
def bce_by_batch(spark, d):
    return _r(stats.bce_loss(views.tiles(spark, d).withColumn("batch", F.col("source_key") % 64), "batch", ["split"]), "loss", "row_loss")


@query("SELECT slide, label, count(*) AS n, round(label * 0.9::DOUBLE + 0.05::DOUBLE, 6) AS smoothed FROM tiles GROUP BY slide, label", "tiles")
def label_smoothing(spark, d):
    t = views.tiles(spark, d).groupBy("slide", "label").agg(F.count(F.lit(1)).alias("n"))
    return _r(t.withColumn("smoothed", fn.smooth_label(F.col("label"), 0.1)), "smoothed")


@query(
    """, m AS (SELECT epoch, split, avg(loss) AS loss, sum(CASE WHEN (score >= 0.5) = (label = 1) THEN 1 ELSE 0 END) / count(*)::DOUBLE AS accuracy,
  coalesce(sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) / nullif(sum(label), 0)::DOUBLE, 0) AS recall FROM epochs GROUP BY ALL),
a AS (SELECT x.epoch, x.split, avg(CASE WHEN x.score > y.score THEN 1::DOUBLE WHEN x.score = y.score THEN 0.5::DOUBLE ELSE 0 END) AS auc FROM epochs x JOIN epochs y ON x.epoch = y.epoch AND x.split = y.split AND x.label = 1 AND y.label = 0 GROUP BY ALL)
SELECT epoch, split, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(auc, 6) AS auc FROM m LEFT JOIN a USING (epoch, split)""",
    "epochs",
)
def epoch_metrics(spark, d):
    e, by = views.epochs(spark, d), ["epoch", "split"]
    m = stats.binary_metrics(e, by).select(*by, "accuracy", "recall")
    out = e.groupBy(*by).agg(F.avg("loss").alias("loss")).join(m, by).join(stats.auc(e, by), by, "left")
    return _r(out, "loss", "accuracy", "recall", "auc")


@query(
    """, m AS (SELECT epoch, round(max(loss), 4) AS auroc, round(min(loss), 4) AS loss FROM epochs GROUP BY epoch)
SELECT (SELECT epoch FROM m ORDER BY auroc DESC, epoch LIMIT 1) AS best_auroc_epoch, max(auroc) AS best_auroc, (SELECT epoch FROM m ORDER BY loss, epoch LIMIT 1) AS best_loss_epoch, min(loss) AS best_loss, max(epoch) AS last_epoch FROM m""",
    "epochs",
)
def best_checkpoint(spark, d):
    m = views.epochs(spark, d).groupBy("epoch").agg(F.round(F.max("loss"), 4).alias("auroc"), F.round(F.min("loss"), 4).alias("loss"))
    return stats.best_epochs(m)


@query("SELECT doc_id, filepath, split_part(split_part(filepath, '/', -1), '__fovr', 1) AS slide FROM patches", "patches")
def slide_from_path(spark, d):
    return views.patches(spark, d).select("doc_id", "filepath", fn.slide_of(F.col("filepath")).alias("slide"))


@query("SELECT DISTINCT p.slide FROM patches p ANTI JOIN (SELECT * FROM diagnoses WHERE dx <> 3) q USING (slide)", "patches diagnoses")
def missing_diagnoses(spark, d):
    slides = slide_from_path(spark, d).select("slide").distinct()
    return slides.join(views.diagnoses(spark, d).where("dx <> 3"), "slide", "left_anti")


_H = "('0x' || substr(md5(concat_ws(':', {}, '{}')), 1, 8))::BIGINT"


@query(
    f""", r AS (SELECT filepath, label, slide, row_number() OVER (PARTITION BY label ORDER BY {_H.format('filepath', 42)}, filepath) AS r, count(*) OVER (PARTITION BY label) AS n FROM patches)
SELECT filepath, label, slide, CASE WHEN r <= round(n * 0.6::DOUBLE) THEN 'train' WHEN r <= round(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
    "patches",
)
def split_random(spark, d):
    return make_splits(views.patches(spark, d).select("filepath", "label"), "random", 42)


@query(
    f""", r AS (SELECT slide, dx, row_number() OVER (PARTITION BY dx, slide = 'src3' ORDER BY {_H.format('slide', 42)}, slide) AS r FROM diagnoses WHERE slide IN (SELECT slide FROM patches)),
s AS (SELECT slide, CASE WHEN slide = 'src3' THEN 'train' ELSE ['train', 'train', 'train', 'val', 'test'][(r - 1 + dx + 5) % 5 + 1] END AS split FROM r)
SELECT filepath, label, slide, split FROM patches JOIN s USING (slide)""",
    "patches diagnoses",
)
def split_slide(spark, d):
    rows = views.patches(spark, d).select("filepath", "label").withColumn("slide", fn.slide_of(F.col("filepath")))
    return split.slide_split(rows, views.diagnoses(spark, d), 42, ["src3"]).select("filepath", "label", "slide", "split")


def _balanced(anchor: int) -> str:
    return f""", a AS (SELECT doc_id, label, row_number() OVER (ORDER BY {_H.format('doc_id', 44)}, doc_id) - 1 AS z, count(*) OVER () AS n FROM patches WHERE label = {anchor}),
u AS (SELECT * FROM a WHERE z < n // 8 * 8), p AS (SELECT doc_id, label, row_number() OVER (ORDER BY {_H.format('doc_id', 42)}, doc_id) - 1 AS k, count(*) OVER () AS n FROM patches WHERE label = {1 - anchor}),
w AS (SELECT z, {_H.format("2, z", 42)} % (SELECT max(n) FROM p) AS k FROM u)
SELECT 2 AS epoch, z // 8 AS batch, CAST(z % 8 AS INTEGER) AS slot, doc_id, label FROM u UNION ALL SELECT 2, z // 8, CAST(z % 8 + 8 AS INTEGER), doc_id, label FROM w JOIN p USING (k)"""


@query(_balanced(1), "patches")
def balanced_under(spark, d):
    return split.balanced_batches(views.patches(spark, d), "doc_id", 16, 42, 2, "undersample")


@query(_balanced(0), "patches")
def balanced_over(spark, d):
    return split.balanced_batches(views.patches(spark, d), "doc_id", 16, 42, 2, "oversample")


_WEIGHTS = [round(((k * 37) % 64 - 32) / 100, 2) for k in range(64)]


@query(f"SELECT vec_id, label, round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {_WEIGHTS}[i]::DOUBLE)) + 0.1::DOUBLE))), 6) AS score FROM embeddings")
def logistic_score(spark, d):
    e = tables(spark, d, "embeddings")
    return e.select("vec_id", "label", F.round(fn.sigmoid(fn.linear(F.col("embedding"), _WEIGHTS, 0.1)), ROUND).alias("score"))


@query(f"SELECT vec_id, round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {_WEIGHTS}[i]::DOUBLE)) + 0.1::DOUBLE))), 6) AS score FROM embeddings")
def logistic_score_arrow(spark, d):
    from ..functions.image import logistic_scores

    return _r(logistic_scores(tables(spark, d, "embeddings").select("vec_id", "embedding"), _WEIGHTS, 0.1).drop("embedding"), "score")


@query("SELECT slide, fov_y, fov_x, label, pos FROM tiles WHERE label IN (0, 1) AND slide = 's3' AND fov_y = 4 AND fov_x = 7", "tiles")
def patch_filter(spark, d):
    t = views.tiles(spark, d).select("slide", "fov_y", "fov_x", "label", "pos")
    return t.where(F.col("label").isin(0, 1) & (F.col("slide") == "s3") & (F.col("fov_y") == 4) & (F.col("fov_x") == 7))


@query("SELECT pos, slide || '__fovr' || fov_y || '-fovc' || fov_x || '__pr' || pixel_y || '-pc' || pixel_x || '.jpg' AS filepath, label FROM tiles", "tiles")
def patch_names(spark, d):
    t = views.tiles(spark, d).withColumnsRenamed({"fov_y": "fov_r", "fov_x": "fov_c", "pixel_y": "patch_r", "pixel_x": "patch_c"})
    return extract_patches(t).select("pos", "filepath", "label")


@query("SELECT doc_id, filepath FROM patches WHERE doc_id % 3 <> 0", "patches")
def existing_anti(spark, d):
    p = views.patches(spark, d).select("doc_id", "filepath")
    return lookup.not_yet(p, p.where("doc_id % 3 = 0"), ["filepath"]).select("doc_id", "filepath")


@query("SELECT slide, fov_y, fov_x, pixel_y, pixel_x, pos, line FROM tiles WHERE line <= 2 UNION ALL SELECT slide, fov_y, fov_x, pixel_y, pixel_x, pos, line FROM tiles WHERE line > 2", "tiles")
def bag_union(spark, d):
    t = views.tiles(spark, d).select(*KEY, "pos", "line")
    return t.where("line <= 2").unionByName(t.where("line > 2"))


@query("SELECT slide, fov_y FROM tiles WHERE line <= 3 UNION SELECT slide, fov_y FROM tiles WHERE line >= 3", "tiles")
def union_distinct(spark, d):
    t = views.tiles(spark, d)
    return t.where("line <= 3").select("slide", "fov_y").union(t.where("line >= 3").select("slide", "fov_y")).distinct()


@query("SELECT l_partkey AS slide, arg_min('dir' || l_linenumber || '/' || l_partkey, l_linenumber) AS path FROM lineitem GROUP BY l_partkey")
def first_dir(spark, d):
    rows = tables(spark, d, "lineitem").select(F.col("l_partkey").alias("slide"), F.concat(F.lit("dir"), "l_linenumber", F.lit("/"), "l_partkey").alias("path"), F.col("l_linenumber").alias("base_rank"))
    return lookup.first_found(rows, "slide", "path", "base_rank")


_MATCH = ", b AS (SELECT DISTINCT 'bag_' || (s_suppkey % 23) || '_' || (s_suppkey % 3) AS bag FROM supplier), f AS (SELECT DISTINCT 'features_bag_' || (s_suppkey % 29) || '_' || (s_suppkey % 3) AS feature FROM supplier UNION SELECT DISTINCT 'features_bag' || (s_suppkey % 31) || (s_suppkey % 3) FROM supplier)\n"


def _bags(spark, d) -> tuple[DataFrame, DataFrame]:
    k = lambda n: (F.col("s_suppkey") % n).cast("string")
    s = tables(spark, d, "supplier")
    bags = s.select(F.concat(F.lit("bag_"), k(23), F.lit("_"), k(3)).alias("bag")).distinct()
    files = s.select(F.concat(F.lit("features_bag_"), k(29), F.lit("_"), k(3)).alias("feature")).union(s.select(F.concat(F.lit("features_bag"), k(31), k(3)))).distinct()
    return bags, files


@query(_MATCH.replace(", b AS", "WITH b AS", 1) + "SELECT DISTINCT bag, feature FROM b JOIN f ON feature = 'features_' || bag OR feature = 'features_' || replace(bag, '_', '')")
def feature_match(spark, d):
    return lookup.feature_files(*_bags(spark, d))


@query(_MATCH.replace(", b AS", "WITH b AS", 1) + "SELECT DISTINCT bag, feature FROM b JOIN f ON starts_with(feature, 'features_' || bag) OR starts_with(feature, 'features_' || replace(bag, '_', ''))")
def feature_match_prefix(spark, d):
    return lookup.feature_files(*_bags(spark, d), match="prefix")


@query(_MATCH.replace(", b AS", "WITH b AS", 1) + "SELECT DISTINCT bag, feature FROM b JOIN f ON starts_with(feature, 'features_' || bag)")
def feature_match_plain(spark, d):
    return lookup.feature_files(*_bags(spark, d), match="plain")


@query("SELECT p_brand, p_brand || '_' || lpad(CAST(max(p_size) + 1 AS VARCHAR), 3, '0') AS name FROM part GROUP BY p_brand")
def next_name(spark, d):
    names = tables(spark, d, "part").select("p_brand", F.concat("p_brand", F.lit("_"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("dir"))
    own = F.expr("try_cast(substr(dir, length(p_brand) + 2) AS int)")
    return names.where(F.col("dir").startswith(F.concat("p_brand", F.lit("_")))).groupBy("p_brand").agg(F.max(own).alias("k")).select("p_brand", F.concat("p_brand", F.lit("_"), F.lpad((F.col("k") + 1).cast("string"), 3, "0")).alias("name"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    return tables(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT slide, fov_y, fov_x, pixel_y, pixel_x, round(score / 3, 6) AS score, pos FROM tiles", "tiles")
def csv_round(spark, d):
    t = views.tiles(spark, d)
    return t.select(*KEY, F.round(F.format_string("%.6f", F.col("score") / 3).cast("double"), 6).alias("score"), "pos")


@query("SELECT slide, fov_y, fov_x, CAST(7 - pixel_x // 256 AS INTEGER) AS tile_y, CAST(pixel_y // 256 AS INTEGER) AS tile_x, pos FROM tiles", "tiles")
def rotate90(spark, d):
    y, x = fn.rotate90((F.col("pixel_y") / 256).cast("int"), (F.col("pixel_x") / 256).cast("int"), 8)
    return views.tiles(spark, d).select("slide", "fov_y", "fov_x", y.alias("tile_y"), x.alias("tile_x"), "pos")


@query("SELECT split, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM tiles GROUP BY split", "tiles")
def label_counts(spark, d):
    return stats.label_counts(views.tiles(spark, d), ["split"])


@query("SELECT slide, count(DISTINCT fov_y * 54 + fov_x) AS fovs, count(*) AS tiles FROM tiles GROUP BY slide", "tiles")
def distinct_fovs(spark, d):
    return views.tiles(spark, d).groupBy("slide").agg(F.countDistinct(F.col("fov_y") * 54 + F.col("fov_x")).alias("fovs"), F.count(F.lit(1)).alias("tiles"))


@query("SELECT slide, fov_y, fov_x, min(score) AS lo, max(score) AS hi, round(CAST(sum((score - lo0) / (hi0 - lo0 + 1e-8::DOUBLE)) AS DOUBLE), 6) AS total FROM (SELECT *, min(score) OVER (PARTITION BY slide) AS lo0, max(score) OVER (PARTITION BY slide) AS hi0 FROM tiles) GROUP BY slide, fov_y, fov_x", "tiles")
def min_max_normalise(spark, d):
    t = views.tiles(spark, d)
    ends = t.groupBy("slide").agg(F.min("score").alias("lo0"), F.max("score").alias("hi0"))
    x = (F.col("score") - F.col("lo0")) / (F.col("hi0") - F.col("lo0") + 1e-8)
    return t.join(ends, "slide").groupBy("slide", "fov_y", "fov_x").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.round(F.sum(x), ROUND).alias("total"))


# Pixels. The native value of a pixel is that of the channel that its place in the mosaic measures: the raw value.


def _native(rgb):
    """Native values of RGB images (..., h, w, 3) whose first pixel is a green one of a red row."""
    y, x = np.indices(rgb.shape[-3:-1])
    return np.where(y % 2 == x % 2, rgb[..., 1], np.where(y % 2 == 0, rgb[..., 0], rgb[..., 2])).astype(np.int64)


def _green(windows):
    """A model: the mean of the measured greens of RGB windows that begin at a green pixel, as a share of white."""
    y, x = np.indices(windows.shape[1:3])
    return windows[:, y % 2 == x % 2, 1].astype(np.int64).sum(1) / (255.0 * (y % 2 == x % 2).sum())


def _kept(spark, d) -> DataFrame:
    return pixels.kept_tiles(views.scans(spark, d), views.TILE_PX, views.BORDER_PX, views.masks(spark, d), shape=views.GRID)


@query(
    """ SELECT t.slide, t.fov_y, t.fov_x, pixel_y, pixel_x, CAST(sum(v) AS BIGINT) AS native FROM kept t JOIN raw r ON r.k = t.k AND r.y BETWEEN pixel_y AND pixel_y + 7 AND r.x BETWEEN pixel_x AND pixel_x + 7
GROUP BY ALL""",
    "fovs raw kept",
)
def kept_tiles(spark, d):
    @F.pandas_udf("long")
    def native(data: pd.Series) -> pd.Series:
        return data.map(lambda b: int(_native(np.frombuffer(b, np.uint8).reshape(views.TILE_PX, views.TILE_PX, 3)).sum()))

    return _kept(spark, d).select(*KEY, native("pixels").alias("native"))


@query(
    """, p AS (SELECT *, CAST(s % 14 AS INTEGER) AS y0, CAST(k % 13 AS INTEGER) AS x0, least(8, 18 - s % 14) AS ph, least(8, 18 - k % 13) AS pw FROM fovs WHERE s % 4 IN (1, 2))
SELECT p.slide || '__fovr' || p.fov_y || '-fovc' || p.fov_x || '__pr' || (p.s % 5) || '-pc' || (p.k % 7) || '.jpg' AS filepath, CAST(p.s % 4 - 1 AS INTEGER) AS label, CAST(pw AS INTEGER) AS h, CAST(ph AS INTEGER) AS w,
  CAST(sum(v * ((pw - 1 - (x - x0)) * 31 + (y - y0))) AS BIGINT) AS digest
FROM p JOIN raw r ON r.k = p.k AND r.y BETWEEN y0 AND y0 + ph - 1 AND r.x BETWEEN x0 AND x0 + pw - 1 GROUP BY ALL""",
    "fovs raw",
)
def cut_patches(spark, d):
    cut = pixels.cut_patches(views.annotations(spark, d), views.scans(spark, d), 8)

    @F.pandas_udf("long")
    def digest(h: pd.Series, w: pd.Series, y0: pd.Series, x0: pd.Series, data: pd.Series) -> pd.Series:
        out, kinds = np.zeros(len(h), np.int64), [h, w, y0 % 2, x0 % 2]
        for (a, b, y, x), at in pd.DataFrame(dict(enumerate(kinds))).groupby([0, 1, 2, 3]).indices.items():
            turned = np.rot90(np.frombuffer(b"".join(data.iloc[at]), np.uint8).reshape(-1, a, b, 3), -1, (1, 2))
            # rows and columns in front, so that it begins at a green pixel of a red row
            native = np.rot90(_native(np.pad(turned, ((0, 0), (y, 0), (x, 0), (0, 0))))[:, y:, x:], 1, (1, 2))
            i, j = np.indices((a, b))
            out[at] = (native * (i * 31 + j)).sum((1, 2))
        return pd.Series(out)

    return cut.select("filepath", "label", "h", "w", digest("h", "w", "top_left_px_x", "top_left_px_y", "pixels").alias("digest"))


@query(
    """, t AS (SELECT t.slide, t.fov_y, t.fov_x, sum(CASE WHEN (y - pixel_y) % 2 = (x - pixel_x) % 2 THEN v END) AS g FROM kept t JOIN raw r ON r.k = t.k AND r.y BETWEEN pixel_y AND pixel_y + 7 AND r.x BETWEEN pixel_x AND pixel_x + 7
  GROUP BY t.slide, t.fov_y, t.fov_x, pixel_y, pixel_x),
m AS (SELECT slide, fov_y, fov_x, avg(g) AS g FROM t GROUP BY ALL), best AS (SELECT slide, fov_y, fov_x FROM m QUALIFY row_number() OVER (PARTITION BY slide ORDER BY round(g, 4) DESC, fov_y, fov_x) = 1),
w AS (SELECT f.*, 2 + 4 * a.i AS i, 2 + 4 * b.i AS j FROM fovs f SEMI JOIN best USING (slide, fov_y, fov_x) CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(i)
  WHERE NOT (s % 4 = 0 AND s % 18 BETWEEN 2 + 4 * a.i AND 9 + 4 * a.i AND k % 18 BETWEEN 2 + 4 * b.i AND 9 + 4 * b.i)),
ws AS (SELECT w.slide, w.fov_y, w.fov_x, i, j, sum(v) / (255.0::DOUBLE * 32) AS score FROM w JOIN raw r ON r.k = w.k AND r.y BETWEEN i AND i + 7 AND r.x BETWEEN j AND j + 7 AND r.y % 2 = r.x % 2 GROUP BY ALL),
c AS (SELECT f.slide, f.fov_y, f.fov_x, y.i AS cell_y, x.i AS cell_x FROM (SELECT DISTINCT slide, fov_y, fov_x FROM ws) f CROSS JOIN range(3) y(i) CROSS JOIN range(3) x(i))
SELECT c.slide, c.fov_y, c.fov_x, CAST(cell_y AS INTEGER) AS cell_y, CAST(cell_x AS INTEGER) AS cell_x, round(coalesce(avg(score), 0), 6) AS score, count(score) AS n
FROM c LEFT JOIN ws ON ws.slide = c.slide AND ws.fov_y = c.fov_y AND ws.fov_x = c.fov_x AND (ws.i - 2) // 4 BETWEEN cell_y - 1 AND cell_y AND (ws.j - 2) // 4 BETWEEN cell_x - 1 AND cell_x GROUP BY ALL""",
    "fovs raw kept",
)
def rescore_best(spark, d):
    @F.pandas_udf("double")
    def green(data: pd.Series) -> pd.Series:
        return pd.Series(_green(np.stack([np.frombuffer(b, np.uint8).reshape(views.TILE_PX, views.TILE_PX, 3) for b in data])) if len(data) else np.empty(0))

    # whole sums, so that equal means are equal
    scored = _kept(spark, d).withColumn("score", F.round(green("pixels") * 255 * 32).cast("double")).withColumn("pos", F.col("fov_y") * 100 + F.col("fov_x"))
    return _r(pixels.rescore_best(scored, views.scans(spark, d), _green, views.FOV_PX, views.FOV_PX, views.TILE_PX, 4, 2, views.masks(spark, d)), "score")


@query(
    "SELECT slide, fov_y, fov_x, CAST(s % 18 // 6 AS INTEGER) AS tile_y, CAST(k % 18 // 6 AS INTEGER) AS tile_x FROM fovs WHERE s % 4 = 0",
    "fovs",
)
def marked_tiles(spark, d):
    @F.pandas_udf("array<int>")
    def marks(data: pd.Series) -> pd.Series:
        return data.map(lambda b: np.flatnonzero(np.frombuffer(b, np.uint8)).astype(np.int32))

    at = views.masks(spark, d).select("slide", "fov_y", "fov_x", F.explode(marks("mask")).alias("at"))
    return mask.marked_tiles(at.select("slide", "fov_y", "fov_x", F.floor(F.col("at") / views.FOV_PX).alias("y"), (F.col("at") % views.FOV_PX).alias("x"), F.lit(255).alias("value")), 6)


@query(
    "SELECT m.slide, m.fov_y, m.fov_x, CAST(m.s % 18 AS INTEGER) AS y, CAST(m.k % 18 AS INTEGER) AS x FROM fovs m WHERE s % 4 = 0",
    "fovs",
)
def mask_contours(spark, d):
    return pixels.mask_contours(views.masks(spark, d), views.FOV_PX, views.FOV_PX)


@query("SELECT slide, CAST((max(fov_y) + 1) * 6 AS INTEGER) AS h, CAST((max(fov_x) + 1) * 6 AS INTEGER) AS w, count(*) AS fovs FROM fovs GROUP BY slide", "fovs")
def mosaics(spark, d):
    """The size of each slide's picture, and its FOVs by the thumbnails in it that are not black."""
    @F.pandas_udf("long")
    def filled(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(b, np.uint8).reshape(y // 6, 6, x // 6, 6, 3).any((1, 3, 4)).sum()) for y, x, b in zip(h, w, data)])

    return pixels.mosaic(pixels.thumbnails(views.scans(spark, d), 6)).select("slide", "h", "w", filled("h", "w", "pixels").alias("fovs"))


@query(
    """SELECT f.slide, f.fov_y, f.fov_x, count(*) AS n, round(sum(coalesce(l.score, 0)), 4) AS total, round(sum(coalesce(l.score, 0) * (y.i * 16 + x.i)), 4) AS placed
FROM (SELECT DISTINCT slide, fov_y, fov_x FROM last) f CROSS JOIN range(16) y(i) CROSS JOIN range(16) x(i)
LEFT JOIN last l ON l.slide = f.slide AND l.fov_y = f.fov_y AND l.fov_x = f.fov_x AND l.tile_y = y.i // 2 AND l.tile_x = x.i // 2 GROUP BY ALL""",
    "tiles last",
)
def tile_grid_scaled(spark, d):
    """The grid with each cell twice along both axes, as sums by FOV that tell the cells' places."""
    cells = grid.dense_scores(_last(spark, d), 8, 8, scale=2)
    placed = F.sum(F.col("score") * (F.col("tile_y") * 16 + F.col("tile_x")))
    return cells.groupBy("slide", "fov_y", "fov_x").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"), F.round(placed, 4).alias("placed"))


@query("SELECT pos, CAST(3 + pixel_y // 256 * 250 AS INTEGER) AS y, CAST(3 + pixel_x // 256 * 250 AS INTEGER) AS x FROM tiles", "tiles")
def tile_origins(spark, d):
    at = lambda c: fn.tile_origin(fn.tile_index(F.col(c), 256), 250, 3)
    return views.tiles(spark, d).select("pos", at("pixel_y").alias("y"), at("pixel_x").alias("x"))


@query("SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS name, CAST(floor(least(255, greatest(0, p_size * 20 * 0.5::DOUBLE + (p_size - 25) * 0.5::DOUBLE))) AS INTEGER) AS mixed, [p_size, p_size, p_size % 3, p_size % 3] AS cells FROM part")
def text_and_value_functions(spark, d):
    size = F.col("p_size")
    return tables(spark, d, "part").select("p_partkey", fn.capitalise(F.col("p_name")).alias("name"), fn.blend(size * 20, size - 25).alias("mixed"), fn.repeat_cells(F.array(size, size % 3), 2).alias("cells"))


@query(
    """, c AS (SELECT slide, fov_y, fov_x, pixel_y, pixel_x, arg_max(round(score, 6), pos) AS score FROM tiles WHERE slide <> 's0' GROUP BY ALL)
SELECT f.slide, f.fov_y, f.fov_x, f.pixel_y, f.pixel_x, f.pos, CAST(coalesce(c.score, 0) AS FLOAT) AS blurred_rs, c.score IS NOT NULL AS matched
FROM features f LEFT JOIN c USING (slide, fov_y, fov_x, pixel_y, pixel_x) WHERE f.slide <> 's0'""",
    "tiles features",
)
def join_slide_scores(spark, d):
    """Scores of all slides but one, whose bags are skipped."""
    t = views.tiles(spark, d)
    f = views.features(spark, d).withColumn("bag", F.lit("bag_1"))
    matches = spark.createDataFrame([("bag_1", "features_bag_1")], "bag string, feature string")
    return join_scores(t.where("slide <> 's0'").select(*KEY, F.round("score", 6).alias("score"), "pos"), f, f.withColumn("feature", F.lit("features_bag_1")).drop("bag"), matches)[1].drop("feature")
