"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def slide_of(path: Column) -> Column:
    """The slide in a patch's file name: the stem up to ``__fovr``."""
    return F.substring_index(file_stem(path), "__fovr", 1)


def patch_name(slide: Column, fov_r: Column, fov_c: Column, patch_r: Column, patch_c: Column) -> Column:
    return F.concat(slide, F.lit("__fovr"), fov_r, F.lit("-fovc"), fov_c, F.lit("__pr"), patch_r, F.lit("-pc"), patch_c, F.lit(".jpg"))


def seeded_hash(seed: int, *cols: Column) -> Column:
    """A 32-bit number from the first 8 hex digits of an MD5; other engines can compute it too."""
    text = F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def smooth_label(label: Column, eps: float) -> Column:
    return label.cast("double") * (1.0 - eps) + eps / 2


def bce(score: Column, label: Column) -> Column:
    """Binary cross entropy of a probability; logarithms stop at -100."""
    stop = F.lit(-100.0)
    log = lambda p: F.when(p > 0, F.greatest(F.ln(p), stop)).otherwise(stop)
    y, p = label.cast("double"), score.cast("double")
    return -(y * log(p) + (F.lit(1.0) - y) * log(F.lit(1.0) - p))


def decide(score: Column, threshold: float = 0.5) -> Column:
    return (score >= F.lit(threshold)).cast("int")


def linear(features: Column, weights: list[float], bias: float) -> Column:
    """Dot product of an array column with constant weights, plus a bias."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    terms = F.zip_with(features, w, lambda a, b: a.cast("double") * b)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) + F.lit(float(bias))


def ratio(a: Column, b: Column) -> Column:
    """a/b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def tile_index(pixel: Column, tile: int, border: int = 0) -> Column:
    return F.floor((pixel - border) / tile).cast("int")


def rotate90(r: Column, c: Column, width: Column | int) -> tuple[Column, Column]:
    """Where (r, c) of an image of that width lies after a quarter turn counter-clockwise."""
    return F.lit(width) - 1 - c if isinstance(width, int) else width - 1 - c, r


def crop_bounds(h: Column, w: Column, tile: int, border: int) -> list[Column]:
    """y0, y1, x0, x1, rows, cols of the largest region inside the border that tiles fill."""
    out = []
    for size, axis in ((h, "y"), (w, "x")):
        n = F.greatest(F.lit(0), F.floor((size - 2 * border) / tile)).cast("int")
        out += [F.lit(border).alias(f"{axis}0"), (F.lit(border) + n * tile).cast("int").alias(f"{axis}1"), n.alias("rows" if axis == "y" else "cols")]
    return out


def tile_origin(index: Column, tile: int, border: int = 0) -> Column:
    """The first pixel of a tile along an axis."""
    return (F.lit(border) + index * tile).cast("int")


def capitalise(text: Column) -> Column:
    """First letter in upper case, the others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def min_max(x: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    return (x - low) / (high - low + F.lit(eps))


def blend(a: Column, b: Column, share: float = 0.5) -> Column:
    """Two images' values mixed, clipped to bytes and cut to whole numbers."""
    return F.floor(clip(a * (1.0 - share) + b * share, 0.0, 255.0)).cast("int")


def repeat_cells(values: Column, times: int) -> Column:
    """Each element of an array, ``times`` in a row."""
    return F.flatten(F.transform(values, lambda v: F.array_repeat(v, times)))
