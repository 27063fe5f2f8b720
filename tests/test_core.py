"""Tile-scoring operators: SQL oracles on the smallest tables, invariants and errors."""

import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import functions as fn
from tesserae import plans, sources, streaming
from tesserae.functions import image
from tesserae.operators import grid, lookup, mask, overlap, rank, split, stats
from tesserae.plans import pixels, training, views
from tesserae.plans.queries import ORACLES, QUERIES
from tesserae.schema import TILES
from tesserae.sources import scan, sinks


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("overlap_map", "window_filter", "tile_grid")])
def test_oracles(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    r = duck.sql(ORACLES[name])
    order = sorted(range(len(r.columns)), key=lambda k: r.columns[k])
    assert sorted(df.columns) == sorted(r.columns)
    assert rows_of(df.select(*sorted(df.columns))) == sorted((tuple(x[k] for k in order) for x in r.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_attach(spark):
    probe = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    build = spark.createDataFrame([(1, 0.5, 1), (1, 0.7, 2), (3, 0.9, 3)], "k int, score double, pos int")
    got = lookup.attach(probe, build, ["k"], "score")
    assert got.count() == 4
    assert {(r.x, round(r.score, 6), r.matched) for r in got.collect()} == {("a", 0.7, True), ("b", 0.7, True), ("c", 0.0, False), ("d", 0.0, False)}
    with pytest.raises(ValueError, match="2"):
        lookup.require_all(probe.where("k IS NOT NULL"), build, "k", "score")


def test_histogram_and_auc(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.999, 1), (1.5, 0), (-0.1, 1), (0.02, 0)], "score double, label int")
    got = {r.bin: r.n for r in stats.histogram(df).collect()}
    assert len(got) == 50 and got[49] == 2 and got[0] == 1 and got[1] == 1 and sum(got.values()) == 4
    a = stats.auc(df).first().auc
    b = stats.auc(df.withColumn("label", 1 - F.col("label"))).first().auc
    pos, neg = [1.0, 0.999, -0.1], [0.0, 1.5, 0.02]
    assert a == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / 9) and a + b == pytest.approx(1)
    assert stats.auc(df.where("label = 1")).first().auc is None
    assert stats.binary_metrics(df.where("score < 0")).first().precision == 0
    assert np.isnan(stats.score_stats(df.where("score > 9"), []).first().mean_score)


@pytest.mark.parametrize("h, w, tile, stride, border", [(40, 52, 16, 4, 0), (40, 52, 16, 4, 3), (41, 53, 12, 5, 2), (32, 32, 8, 8, 0)])
def test_score_map(spark, h, w, tile, stride, border):
    rng = np.random.default_rng(0)
    windows = [(i, j, float(rng.random())) for i in range(border, h - border - tile + 1, stride) for j in range(border, w - border - tile + 1, stride) if rng.random() > 0.2]
    total, n = np.zeros((h, w)), np.zeros((h, w))
    for i, j, s in windows:
        total[i : i + tile, j : j + tile] += s
        n[i : i + tile, j : j + tile] += 1
    want = np.divide(total, n, out=np.zeros((h, w)), where=n > 0)
    df = spark.createDataFrame([("s", 0, 0, *x) for x in windows], "slide string, fov_y int, fov_x int, i int, j int, score double")
    got, size = np.zeros((h, w)), stride if tile % stride == 0 else 1
    for r in overlap.score_map(df, h, w, tile, stride, border).collect():
        y, x = border + r.cell_y * size, border + r.cell_x * size
        got[y : y + size, x : x + size] = r.score
    assert np.allclose(got, want)


def test_windows_without_marks(spark):
    fovs = spark.createDataFrame([("s", 0, 0)], "slide string, fov_y int, fov_x int")
    marks = [(5, 7), (20, 3)]
    pixels = spark.createDataFrame([("s", 0, 0, y, x) for y, x in marks], "slide string, fov_y int, fov_x int, y int, x int")
    got = {(r.i, r.j) for r in mask.unmarked_windows(mask.window_grid(fovs, 24, 24, 8, 3, 1), pixels, 8, 3, 1).collect()}
    every = range(1, 24 - 1 - 8 + 1, 3)
    assert got == {(i, j) for i in every for j in every if not any(i <= y < i + 8 and j <= x < j + 8 for y, x in marks)}


def test_grid(spark):
    slides = spark.createDataFrame([("s", 27, 54), ("t", 3, 9)], "slide string, n_y int, n_x int")
    assert grid.fov_grid(slides).count() == 1150
    row = spark.range(1).select(*fn.crop_bounds(F.lit(10), F.lit(9), 4, 4)).first()
    assert (row.rows, row.cols) == (0, 0)
    scores = spark.createDataFrame([("s", 0, 0, 1, 0, 0.5), ("s", 0, 0, 9, 0, 0.5)], "slide string, fov_y int, fov_x int, tile_y int, tile_x int, score double")
    big = grid.dense_scores(scores, 2, 2, scale=3)
    assert big.count() == 36 and big.where("score > 0").count() == 9


def test_splits(spark):
    rows = [(f"p/{s}__fovr1-fovc2__pr3-pc{k}.jpg", k % 3 == 0) for s in range(20) for k in range(15)]
    p = spark.createDataFrame([(a, int(b)) for a, b in rows], "filepath string, label int")
    got = plans.make_splits(p, "random", 1)
    for label, n in ((1, 100), (0, 200)):
        c = {r.split: r["count"] for r in got.where(f"label = {label}").groupBy("split").count().collect()}
        assert c == {"train": n * 0.6, "val": n * 0.2, "test": n * 0.2}
    assert rows_of(got) == rows_of(plans.make_splits(p, "random", 1)) != rows_of(plans.make_splits(p, "random", 2))
    dx = spark.createDataFrame([(str(s), s % 2 - 1) for s in range(20)], "slide string, dx int")
    by = plans.make_splits(p, "slide", 1, dx, pinned=["3"]).select("slide", "split").distinct().collect()
    assert len(by) == 20 and {r.split for r in by if r.slide == "3"} == {"train"}
    with pytest.raises(ValueError, match="diagnosis"):
        plans.make_splits(p, "slide", 1, dx.where("slide != '4'"))


def test_balanced_batches(spark):
    df = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(203)], "key long, label int")
    with pytest.raises(ValueError, match="even"):
        split.balanced_batches(df, "key", 7, 1)
    for mode, anchor, n in (("undersample", 1, 41), ("oversample", 0, 162)):
        got = split.balanced_batches(df, "key", 8, 1, 3, mode).collect()
        assert len({r.batch for r in got}) == n // 4 and len(got) == n // 4 * 8
        for b in range(n // 4):
            assert sorted(r.label for r in got if r.batch == b) == [0] * 4 + [1] * 4
        own = [r.key for r in got if r.label == anchor]
        assert len(own) == len(set(own))
        assert [r.key for r in split.balanced_batches(df, "key", 8, 1, 4, mode).collect()] != [r.key for r in got]


def test_sources(spark, tmp_path):
    f = tmp_path / "slides.jsonl"
    f.write_text("\n".join(["", *(json.dumps({"patient_id": p, "slide": s, "label": k}) for p, s, k in (("a", "1", 3), ("b", "1", -1), ("a", "1", 5))), " "]))
    assert rows_of(sources.slide_diagnoses(spark, str(f))) == [("a1", 5), ("b1", -1)]
    assert [(r.line, r.patient_id) for r in sources.slide_list(spark, str(f)).orderBy("line").collect()] == [(2, "a"), (3, "b"), (4, "a")]
    f.write_text('{"patient_id": "a"}\r\n\r\n{"x": 1}\r\n')
    with pytest.raises(ValueError, match="slides.jsonl:3: no patient_id"):
        sources.slide_list(spark, str(f))
    f.write_text("\n")
    with pytest.raises(ValueError, match="no slides"):
        sources.slide_list(spark, str(f))


def test_lines_of_several_files(spark, tmp_path):
    """The last line of the last path wins, whatever the sizes of the files."""
    line = lambda s, k: json.dumps({"patient_id": "p", "slide": s, "label": k}) + "\n"
    (tmp_path / "a.jsonl").write_text("".join(line("1", k) for k in range(2000)))
    (tmp_path / "b.jsonl").write_text("\n" + line("1", -7) + line("2", 1))
    (tmp_path / "c.jsonl").write_text("\n\n" + line("2", 5) + '{"patient": 3}\n')
    assert dict(rows_of(sources.slide_diagnoses(spark, f"{tmp_path}/[ab].jsonl"))) == {"p1": -7, "p2": 1}
    with pytest.raises(ValueError, match="c.jsonl:4: no patient_id"):
        sources.slide_list(spark, str(tmp_path))


def test_score_csv(spark, tmp_path):
    scores = spark.createDataFrame([(1, 2, 0, 256, 0.25)], "fov_y int, fov_x int, pixel_y int, pixel_x int, score double")
    sinks.write_scores_csv(scores, f"{tmp_path}/csv", one_file=True)
    assert sources.score_csv(spark, f"{tmp_path}/csv", "score").drop("pos", "slide").collect() == scores.collect()
    with pytest.raises(ValueError, match="smoothed"):
        sources.score_csv(spark, f"{tmp_path}/csv", "smoothed")
    for name, rows in (("s1", "1,2,0,0,0.5\n1,2,0,0,0.75\n"), ("s2", "1,2,0,0,0.125\n")):
        os.makedirs(f"{tmp_path}/more/{name}")
        (tmp_path / "more" / name / f"{name}_scores.csv").write_text("FOV_y,FOV_x,pixel_y,pixel_x,score\n" + rows)
    csv = sources.score_csv(spark, f"{tmp_path}/more/*", "score")
    last = lookup.last_wins(csv, ["slide", "fov_y", "fov_x", "pixel_y", "pixel_x"], "score", "pos")
    assert {(r.slide, r.score) for r in last.collect()} == {("s1", 0.75), ("s2", 0.125)}
    (tmp_path / "more" / "s2" / "s2_scores.csv").write_text("FOV_x,FOV_y,pixel_y,pixel_x,score\n1,2,0,0,0.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        sources.score_csv(spark, f"{tmp_path}/more/*", "score").collect()


def test_masks(spark, tmp_path):
    """NPY before TIFF, first channel, padded and cropped; a slide's name may hold underscores."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(3, 2, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    image.setRGB(1, 1, 0xFF0000)
    image.setRGB(2, 0, 0x0000FF)
    for name in ("a_b_0_1", "a_b_2_3"):
        assert jvm.javax.imageio.ImageIO.write(image, "tif", jvm.java.io.File(f"{tmp_path}/{name}.tif"))
    np.save(tmp_path / "a_b_2_3.npy", np.array([[0, 0.5], [2, 0]]))
    np.save(tmp_path / "c_10_11.npy", np.ones((9, 9, 3), np.uint8))
    got = {(r.slide, r.fov_y, r.fov_x): np.frombuffer(r.mask, np.uint8).reshape(3, 4) for r in sources.masks(spark, str(tmp_path), 3, 4).collect()}
    assert {k: np.argwhere(v).tolist() for k, v in got.items() if k[0] == "a_b"} == {("a_b", 0, 1): [[1, 1]], ("a_b", 2, 3): [[0, 1], [1, 0]]}
    assert (got["c", 10, 11] == 255).all() and len(got) == 3


def test_fov_scan(spark, tmp_path):
    """Only the FOVs that pushed filters leave are read."""
    rng = np.random.default_rng(0)
    arrays = {s: rng.integers(0, 256, (5, 7, 4, 6) if s == "s1" else (3, 2, 4, 6, 1), dtype=np.uint8) for s in ("s1", "s2")}
    for s, a in arrays.items():
        os.makedirs(tmp_path / s)
        np.save(tmp_path / s / "scan.npy", a)
    os.makedirs(tmp_path / "empty")
    rows = scan.scans(spark, str(tmp_path))
    got = {(r.slide, r.fov_y, r.fov_x): np.frombuffer(r.raw, np.uint8).reshape(r.h, r.w) for r in rows.collect()}
    assert len(got) == 35 + 6 and all(np.array_equal(v, arrays[s][y, x].reshape(4, 6)) for (s, y, x), v in got.items())
    some = rows.where("slide = 's1' AND fov_y >= 2 AND fov_x IN (1, 3) AND fov_x + fov_y > 3")
    assert {(r.fov_y, r.fov_x) for r in some.collect()} == {(y, x) for y in (2, 3, 4) for x in (1, 3) if x + y > 3}
    reader = scan.FovScanReader(str(tmp_path))
    left = list(reader.pushFilters([scan.EqualTo(("slide",), "s1"), scan.GreaterThanOrEqual(("fov_y",), 2), scan.In(("fov_x",), (1, 3)), scan.EqualTo(("h",), 4)]))
    assert [f.attribute for f in left] == [("h",)] and [p.fovs for p in reader.partitions()] == [tuple((y, x) for y in (2, 3, 4) for x in (1, 3))]
    chosen = scan.gather(rows, spark.createDataFrame([("s2", 1, 1), ("s2", 1, 1), ("s3", 0, 0)], "slide string, fov_y int, fov_x int"))
    assert [(r.slide, r.fov_y, r.fov_x) for r in chosen.collect()] == [("s2", 1, 1)]
    np.save(tmp_path / "s2" / "scan.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="C-ordered"):
        scan.scans(spark, str(tmp_path)).collect()


def test_bags_and_replace(spark, tmp_path, monkeypatch):
    tile = spark.createDataFrame([("s", 0, 0, 0, 0, bytearray(12))], TILES)
    with pytest.raises(FileNotFoundError):
        os.makedirs(f"{tmp_path}/empty")
        sources.bags(spark, f"{tmp_path}/empty").count()
    tile.coalesce(1).write.parquet(f"{tmp_path}/b")
    part = next(x for x in os.listdir(f"{tmp_path}/b") if x.startswith("part"))
    os.makedirs(f"{tmp_path}/bags/s1")
    os.rename(f"{tmp_path}/b/{part}", f"{tmp_path}/bags/s1/bag_1.parquet")
    assert [(r.slide, r.bag, r.pos) for r in sources.bags(spark, f"{tmp_path}/bags", tile=2).collect()] == [("s", "bag_1", 0)]
    with pytest.raises(Exception, match="are no 3 x 3 x 3 tile"):
        sources.bags(spark, f"{tmp_path}/bags", tile=3).collect()
    spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="no column fov_y"):
        sources.bags(spark, f"{tmp_path}/other", "*.parquet")
    wanted = spark.createDataFrame([("s1",), ("s9",)], "slide string")
    found, missing = sources.discover_bags(spark, f"{tmp_path}/bags", wanted)
    assert [(r.slide, r.bag) for r in found.collect()] == [("s1", "bag_1")] and rows_of(missing) == [("s9",)]
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    sinks.replace_column(spark.read.parquet(path), path, "y", F.col("id") * 2)
    assert rows_of(spark.read.parquet(path)) == [(0, 0), (1, 2), (2, 4)] and os.listdir(tmp_path).count("t") == 1


def test_features(spark, tmp_path):
    """Each file's own FOV column; files without any are left out and reported."""
    for name, kind in (("a", "cam_yx array<int>, k int"), ("b", "cam_xy array<int>, k int"), ("c", "k int")):
        row = ([1, 2], 7) if name != "c" else (7,)
        spark.createDataFrame([row], kind).coalesce(1).write.parquet(f"{tmp_path}/f/{name}.parquet")
    got = sources.features(spark, f"{tmp_path}/f")
    assert [(r.fov_y, r.fov_x, r.k) for r in got.collect()] == [(1, 2, 7)] * 2
    assert [("c.parquet" in r.file, r.rows) for r in sources.unmapped(spark, f"{tmp_path}/f").collect()] == [(True, 1)]


def fovs_of(spark, arrays):
    return spark.createDataFrame([(s, y, x, *a.shape, bytearray(a.tobytes())) for (s, y, x), a in arrays.items()], "slide string, fov_y int, fov_x int, h int, w int, raw binary")


def test_kept_tiles(spark):
    """Every tile and pixel against a plain loop, with masks: none, one pixel, all, and a border."""
    rng = np.random.default_rng(1)
    arrays = {("s", y, x): rng.integers(0, 256, (10, 15), dtype=np.uint8) for y in range(5) for x in range(6)}
    marks = {("s", 2, 2): np.zeros((10, 15), np.uint8), ("s", 2, 3): np.full((10, 15), 255, np.uint8)}
    marks["s", 2, 2][5, 6] = 9
    masks = spark.createDataFrame([(*k, bytearray(m.tobytes())) for k, m in marks.items()], "slide string, fov_y int, fov_x int, mask binary")
    for shape in (None, (5, 6)):
        got = {(r.fov_y, r.fov_x, r.pixel_y, r.pixel_x): r.pixels for r in pixels.kept_tiles(fovs_of(spark, arrays), 4, 1, masks, shape=shape).collect()}
        want = {}
        for y, x in ((2, 2), (2, 3)):
            rgb = image.demosaic(arrays["s", y, x][1:9, 1:13])
            for a in range(2):
                for b in range(3):
                    if not marks["s", y, x][1 + 4 * a : 5 + 4 * a, 1 + 4 * b : 5 + 4 * b].any():
                        want[y, x, 1 + 4 * a, 1 + 4 * b] = rgb[4 * a : 4 * a + 4, 4 * b : 4 * b + 4].tobytes()
        assert {k: bytes(v) for k, v in got.items()} == want and len(want) == 5
    assert pixels.kept_tiles(fovs_of(spark, arrays), 4, 5).count() == 0


def test_patches_to_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    arrays = {("s", 0, x): rng.integers(0, 256, (12, 16), dtype=np.uint8) for x in range(2)}
    rows = [("s", 0, 0, 1, 2, 3, 4, 1), ("s", 0, 0, 1, 3, 9, 13, 0), ("s", 0, 1, 0, 0, 0, 0, 1), ("s", 0, 1, 0, 1, 0, 0, 2)]
    notes = spark.createDataFrame(rows, "slide string, fov_r int, fov_c int, patch_r int, patch_c int, top_left_px_x int, top_left_px_y int, label int")
    cut = pixels.cut_patches(notes, fovs_of(spark, arrays), 5)
    got = {r.filepath: r for r in cut.collect()}
    assert len(got) == 3
    for s, fr, fc, pr, pc, y, x, label in rows[:3]:
        r, want = got[f"{s}__fovr{fr}-fovc{fc}__pr{pr}-pc{pc}.jpg"], np.rot90(image.demosaic(arrays[s, fr, fc])[y : y + 5, x : x + 5])
        assert (r.label, r.h, r.w) == (label, *want.shape[:2]) and bytes(r.pixels) == want.tobytes()
    assert sinks.write_patch_images(cut, f"{tmp_path}/out").count() == 3
    assert sinks.write_patch_images(cut, f"{tmp_path}/out").count() == 0 and sinks.write_patch_images(cut, f"{tmp_path}/out", overwrite=True).count() == 3
    read = {r.filepath.split("/")[-1]: (r.h, r.w, bytes(r.pixels)) for r in sources.patch_images(spark, f"{tmp_path}/out").collect()}
    assert read == {k.replace(".jpg", ".png"): (r.h, r.w, bytes(r.pixels)) for k, r in got.items()}
    sinks.write_patch_table(cut, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 3


def test_patches_of_many_fovs(spark):
    """FOVs of one shape are demosaiced together, others apart; many patches of a FOV pass in several batches."""
    rng = np.random.default_rng(5)
    shapes = [(12, 16)] * 40 + [(9, 7), (12, 16), (7, 9)] * 5 + [(300, 280)]
    arrays = {("s", 0, k): rng.integers(0, 256, shape, dtype=np.uint8) for k, shape in enumerate(shapes)}
    same = np.stack([arrays["s", 0, k] for k in range(40)])
    assert np.array_equal(image.demosaic(same), np.stack([image.demosaic(a) for a in same]))
    rows = [("s", 0, k, p, 0, (k * 5 + p) % 7, (k * 3 + p * 2) % 7, p % 3) for k in range(len(shapes)) for p in range(150 if shapes[k][0] == 300 else 3)]
    notes = spark.createDataFrame(rows, "slide string, fov_r int, fov_c int, patch_r int, patch_c int, top_left_px_x int, top_left_px_y int, label int")
    got = {r.filepath: r for r in pixels.cut_patches(notes, fovs_of(spark, arrays).coalesce(1)).collect()}
    wanted = [r for r in rows if r[-1] < 2]
    assert len(got) == len(wanted) and sum(len(r.pixels) for r in got.values()) > pixels.PASS_BYTES
    rgb = {k: image.demosaic(a) for k, a in arrays.items()}
    for s, fr, fc, pr, pc, y, x, label in wanted:
        r, want = got[f"{s}__fovr{fr}-fovc{fc}__pr{pr}-pc{pc}.jpg"], np.rot90(rgb[s, fr, fc][y : y + 256, x : x + 256])
        assert (r.label, r.h, r.w, r.top_left_px_x, r.top_left_px_y) == (label, *want.shape[:2], y, x) and bytes(r.pixels) == want.tobytes()


def test_derived_fovs_are_dealt_out(spark, sf):
    """The pixels of a small file of parts are made by all cores, one FOV per part, byte by byte as the formula says."""
    scans = views.scans(spark, sf)
    assert scans.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {(r.slide, r.fov_y, r.fov_x): np.frombuffer(r.raw, np.uint8).reshape(r.h, r.w) for r in scans.collect()}
    parts = sources.tables(spark, sf, "part").select("p_partkey", "p_size").collect()
    y, x = np.indices((views.FOV_PX, views.FOV_PX))
    assert len(got) == len(parts)
    for k, s in parts:
        assert np.array_equal(got[f"p{k // 100}", k % 100 // 10, k % 10], (k * 7 + y * 13 + x * 29 + y * x + s) % 256)


def test_window_scores_and_mosaic(spark):
    rng = np.random.default_rng(3)
    arrays = {("s", y, x): rng.integers(1, 256, (9, 11), dtype=np.uint8) for y in range(2) for x in range(2) if (y, x) != (1, 0)}
    mask = np.zeros((9, 11), np.uint8)
    mask[3, 3] = 1
    masks = spark.createDataFrame([("s", 0, 0, bytearray(mask.tobytes()))], "slide string, fov_y int, fov_x int, mask binary")
    got = {(r.fov_y, r.fov_x, r.i, r.j): r.score for r in pixels.window_scores(fovs_of(spark, arrays), lambda b: b.mean((1, 2, 3)), 4, 2, 1, masks, batch=3).collect()}
    want = {}
    for (_, y, x), a in arrays.items():
        rgb = image.demosaic(a)
        want |= {(y, x, i, j): rgb[i : i + 4, j : j + 4].mean() for i in range(1, 5, 2) for j in range(1, 7, 2) if (y, x) != (0, 0) or not mask[i : i + 4, j : j + 4].any()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    r = pixels.mosaic(pixels.thumbnails(fovs_of(spark, arrays), 3)).first()
    whole = np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w, 3)
    assert (r.h, r.w) == (6, 6) and not whole[3:, :3].any()
    for (_, y, x), a in arrays.items():
        assert np.array_equal(whole[3 * y : 3 * y + 3, 3 * x : 3 * x + 3], image.block_mean(image.demosaic(a), 3).astype(np.uint8))


def test_demosaic_against_a_plain_filter():
    """Each missing channel is the mean of the nearest places that measure it, edges mirrored."""
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 256, (6, 8), dtype=np.uint8)
    rgb = image.demosaic(raw)
    for y in range(1, 5):
        for x in range(1, 7):
            around = lambda *d: sum(int(raw[y + a, x + b]) for a, b in d) / len(d)  # noqa: B023, E731
            side, up, cross, corner = [(0, -1), (0, 1)], [(-1, 0), (1, 0)], [(0, -1), (0, 1), (-1, 0), (1, 0)], [(-1, -1), (-1, 1), (1, -1), (1, 1)]
            here = float(raw[y, x])
            if y % 2 == x % 2:
                want = (around(*side), here, around(*up)) if y % 2 == 0 else (around(*up), here, around(*side))
            else:
                want = (here, around(*cross), around(*corner)) if y % 2 == 0 else (around(*corner), around(*cross), here)
            assert rgb[y, x].tolist() == [int(v + 1e-6) for v in want]


def test_bag_jobs(spark, tmp_path):
    """Bags are scored, written beside, and their scores mapped onto feature files."""
    px = lambda v: bytearray([v] * 12)
    tiles = spark.createDataFrame([("s", "bag_1", 0, 0, 0, 0, 0, px(0)), ("s", "bag_1", 1, 0, 0, 0, 2, px(255)), ("s", "bag_1", 2, 0, 0, 0, 0, px(51)), ("s", "bag_2", 0, 0, 0, 0, 0, px(102))], "slide string, bag string, pos long, fov_y int, fov_x int, pixel_y int, pixel_x int, pixels binary")
    feats = spark.createDataFrame([("s", "features_bag_1", 0, 0, 0, 0), ("s", "features_bag_1", 0, 0, 9, 9), ("s", "features_bag2", 0, 0, 0, 0)], "slide string, feature string, fov_y int, fov_x int, pixel_y int, pixel_x int")
    matches = lookup.feature_files(tiles.select("bag").distinct(), feats.select("feature").distinct())
    np.savez(tmp_path / "model.npz", **{"model.fc.weight": np.full(48, 0.1), "model.fc.bias": np.array([0.5])})
    model = image.Checkpoint(str(tmp_path / "model.npz"))
    scored, mapped = plans.score_bags(tiles, feats, matches, model, 2, size=4)
    want = {v: model(image.preprocess(np.full((2, 2, 3), v, np.uint8), 4)[None])[0] for v in (0, 255, 51, 102)}
    by = {(r.bag, r.pos): r.score for r in scored.collect()}
    assert all(by[k] == pytest.approx(want[v], abs=1e-6) for k, v in ((("bag_1", 0), 0), (("bag_1", 1), 255), (("bag_1", 2), 51), (("bag_2", 0), 102)))
    got = sorted((r.feature, r.pixel_y, round(r.score, 5), r.matched) for r in mapped.collect())
    assert got == [("features_bag2", 0, pytest.approx(want[102], abs=1e-5), True), ("features_bag_1", 0, pytest.approx(want[51], abs=1e-5), True), ("features_bag_1", 9, 0, False)]
    assert rows_of(sinks.write_sidecars(scored, f"{tmp_path}/side")) == [("s", "bag_1", 3), ("s", "bag_2", 1)]
    with np.load(f"{tmp_path}/side/s/bag_1_relevance.npz") as z:
        assert z["coords"].tolist() == [[0, 0], [0, 2], [0, 0]] and z["relevance_scores"].dtype == np.float32 and z["cams"].shape == (3, 2)
    csv = spark.createDataFrame([("s", 0, 0, 0, 0, 0.5, 1), ("s", 0, 0, 0, 0, 0.25, 2)], "slide string, fov_y int, fov_x int, pixel_y int, pixel_x int, score double, pos long")
    more = tiles.drop("pixels").union(spark.createDataFrame([("t", "bag_9", 0, 0, 0, 0, 0)], tiles.drop("pixels").schema))
    bags, features, skipped = plans.join_slide_scores(csv, more, feats, matches)
    assert {(r.bag, r.pos, r.blurred_rs) for r in bags.collect()} == {("bag_1", 0, 0.25), ("bag_1", 1, 0), ("bag_1", 2, 0.25), ("bag_2", 0, 0.25)}
    assert features.count() == 3 and rows_of(skipped) == [("t",)]
    labelled = spark.createDataFrame([(1, px(255)), (0, px(0))], "label int, pixels binary")
    assert {(r.label, round(r.score, 4)) for r in image.infer(labelled, model, 2, size=4).collect()} == {(1, round(float(want[255]), 4)), (0, round(float(want[0]), 4))}


def test_results_and_settings(spark, tmp_path):
    sinks.write_run_config(f"{tmp_path}/run/config.json", seed=3, path=tmp_path)
    assert json.loads((tmp_path / "run" / "config.json").read_text()) == {"seed": 3, "path": str(tmp_path)}
    df = spark.createDataFrame([("val", 1, 0.75), ("val", 0, 0.25)], "split string, label int, score float")
    sinks.write_results(plans.evaluate(df), f"{tmp_path}/results")
    assert spark.read.parquet(f"{tmp_path}/results/auc").first().auc == 1
    assert sinks.next_experiment(f"{tmp_path}/exp", "resnet_a") == "resnet_a_001"
    for name in ("resnet_a_009", "resnet_a_x", "resnet_ab_050", "resnet_a_011"):
        os.makedirs(tmp_path / "exp" / name)
    assert sinks.next_experiment(f"{tmp_path}/exp", "resnet_a") == "resnet_a_012"
    assert stats.throughput(10, 0) == 10_000_000


def test_epoch_metrics(spark, tmp_path):
    m = stats.EpochMetrics(spark, f"{tmp_path}/m")
    rng = np.random.default_rng(5)
    rows = [(int(b), int(rng.random() > 0.5), float(np.float32(rng.random()))) for b in range(3) for _ in range(7 + b)]
    for b in range(3):
        m.update(spark.createDataFrame([r for r in rows if r[0] == b], "batch int, label int, score double"), 4, "val")
    got = m.compute().collect()
    whole = spark.createDataFrame(rows, "batch int, label int, score double")
    assert len(got) == 1 and (got[0].epoch, got[0].split) == (4, "val")
    assert got[0].loss == pytest.approx(stats.bce_loss(whole, "batch").first().loss) and got[0].auroc == pytest.approx(stats.auc(whole).first().auc)
    metrics = stats.binary_metrics(whole).first()
    assert (got[0].acc, got[0].recall) == (pytest.approx(metrics.accuracy), pytest.approx(metrics.recall))
    m.reset()
    assert not os.path.exists(tmp_path / "m")


def test_running_counts_over_ranges(spark):
    """Scores of all sizes and signs, zero, null and NaN, in groups with a null key."""
    rng = np.random.default_rng(6)
    scores = [float(s * 10.0**e) for s, e in zip(rng.choice([-1, 1], 400), rng.uniform(-12, 6, 400))] + [0.0] * 5 + [float("inf"), float("-inf"), 1.0, 1.0]
    rows = [(None if k % 3 else "a", int(rng.random() > 0.5), s) for k, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    got = {r.g: r.auc for r in stats.auc(df, ["g"]).collect()}
    for g in ("a", None):
        pos, neg = ([s for x, y, s in rows if x == g and y == want] for want in (1, 0))
        assert got[g] == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)))
    odd = df.union(spark.createDataFrame([("a", 1, None), ("a", 0, float("nan"))], df.schema))
    points = stats.roc_points(odd, ["g"]).where("g = 'a'").collect()
    assert max(r.tp for r in points) == sum(x == "a" and y == 1 for x, y, _ in rows) + 1 and sum(r.threshold == float("inf") and r.tp + r.fp == 0 for r in points) == 1


def test_images(spark):
    flat = np.full((8, 8), 77, np.uint8)
    assert (image.demosaic(flat) == 77).all()
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, (9, 13), dtype=np.uint8)
    scan = spark.createDataFrame([("s", 1, 2, 9, 13, bytearray(raw.tobytes()))], "slide string, fov_y int, fov_x int, h int, w int, raw binary")
    got = image.explode_tiles(scan, 4, 1).collect()
    rgb = image.demosaic(raw)
    assert {(r.pixel_y, r.pixel_x) for r in got} == {(1, x) for x in (1, 5)} or len(got) == 2
    for r in got:
        assert np.array_equal(np.frombuffer(r.pixels, np.uint8).reshape(4, 4, 3), rgb[r.pixel_y : r.pixel_y + 4, r.pixel_x : r.pixel_x + 4])
    x = image.preprocess(np.full((30, 20, 3), 255, np.uint8), 8)
    assert x.shape == (3, 8, 8) and np.allclose(x[0], (1 - 0.485) / 0.229)
    with pytest.raises(ValueError):
        image.preprocess(np.zeros((3, 3)))
    turned = rgb
    for _ in range(4):
        turned = image.augment(turned, 4)
    assert np.array_equal(turned, rgb)
    assert np.allclose(image.block_mean(np.full((6, 6, 3), 5), 3), 5)
    assert image.train_transform(rgb, 12345, 8, "strong").shape == (3, 8, 8) and np.array_equal(image.jitter(rgb, 0x7F7F7F7F), image.jitter(rgb, 0x7F7F7F7F))
    assert image.jitter(rgb, 0x7F7F7FFF).mean() > rgb.mean() and (image.resize(np.full((9, 5, 3), 66, np.uint8), 4) == 66).all()
    edge = np.zeros((5, 5), np.uint8)
    edge[1:4, 1:4] = 1
    assert image.contour(edge).sum() == 8 and not image.contour(edge)[2, 2]
    tiles = spark.createDataFrame([("a", bytearray(48)), ("b", bytearray(b"\xff" * 48))], "k string, pixels binary")
    scored = image.score_pixels(tiles, lambda b: b.mean(axis=(1, 2, 3)), 4, size=4).orderBy("k").collect()
    assert scored[0].score < scored[1].score


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0.5), ("s", 1.0), ("t", 0.0)], "slide string, score double")
    rows.write.parquet(f"{tmp_path}/in")
    q = streaming.append_scores(streaming.tile_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == rows_of(rows)
    assert {r.slide: r.mean_score for r in streaming.running_stats(rows).collect()} == {"s": 0.75, "t": 0.0}


def test_top(spark):
    df = spark.createDataFrame([("s", k, 0.5) for k in range(5)], "slide string, pos int, score double")
    assert [r.pos for r in rank.top_k(df, 2, ["pos"]).collect()] == [0, 1]
    assert rank.top_k_or_none(df, 6, ["pos"]).count() == 0 and rank.top_k_or_none(df, 5, ["pos"]).count() == 5
    assert plans.only_one(a=None, b=1) == "b"
    with pytest.raises(ValueError):
        plans.only_one(a=1, b=1)


def test_training(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 6))
    y = (x @ [2, -1, 0, 0, 1, 0] + 0.5 + rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "embedding array<double>, label int")
    weights, bias = training.fit_logistic(rows, l2=1e-3)
    z = 1 / (1 + np.exp(-(x @ weights + bias)))
    assert np.abs(x.T @ (z - y) / 400 + 1e-3 * weights).max() < 1e-3 and abs((z - y).mean()) < 1e-3
    training.save_checkpoint(f"{tmp_path}/run/best.npz", weights, bias)
    assert np.allclose(image.Checkpoint(f"{tmp_path}/run/best.npz")(x), z)
    w2, _ = training.fit_logistic(rows.where("label = 1").union(rows.where("label = 0").limit(20)), balance=True)
    assert w2[0] > 0.5
    scored = image.logistic_scores(rows, weights.tolist(), bias).withColumn("split", F.lit("val"))
    frames = plans.evaluate(scored)
    lines = training.metric_lines({"metrics": frames["metrics"], "auc": frames["auc"]})
    assert len(lines) == 2 and lines[0].startswith("metrics: split=val  accuracy=0.") and lines[1].startswith("auc: split=val  auc=0.9")
    assert [training.learning_rate(k, 10, 0.5) for k in (0, 5, 10)] == [0.5, pytest.approx(0.25), pytest.approx(0)] and training.learning_rate(9, 10, 0.5, "constant") == 0.5
    log = training.RunLog(f"{tmp_path}/log")
    log.log(1, loss=0.5, auroc=0.75)
    log.log(2, loss=0.25)
    assert rows_of(log.entries(spark, ["loss", "auroc"])) == [(1, 0.5, 0.75), (2, 0.25, None)]
