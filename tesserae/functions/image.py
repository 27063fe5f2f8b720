"""Pixels in Arrow batches: demosaic, tiles, preprocessing, augmentation. Images are row-major bytes."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Normalisation of the model's input.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


#: Bytes of an Arrow batch of images; FOVs are megabytes each.
BATCH_BYTES = 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, unless they are bounded more tightly."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).lower().rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def demosaic(raw: np.ndarray) -> np.ndarray:
    """Bilinear RGB of GR Bayer mosaics (..., h, w) (even rows G R, odd rows B G); edges mirror. Sums of at most 16
    bytes are whole 16-bit numbers, so means are rounded down exactly."""
    h, w = raw.shape[-2:]
    y, x = np.indices((h, w))
    red, blue = (y % 2 == 0) & (x % 2 == 1), (y % 2 == 1) & (x % 2 == 0)
    out = np.empty((*raw.shape, 3), np.uint8)

    def around(a: np.ndarray, corners: bool) -> np.ndarray:
        """Sums of 3 x 3 pixels: 4 times the middle, twice the sides and once the corners, or once the sides alone."""
        a = np.pad(a.astype(np.uint16), [(0, 0)] * (a.ndim - 2) + [(1, 1)] * 2, "reflect")
        if corners:
            a = a[..., :-2, :] + 2 * a[..., 1:-1, :] + a[..., 2:, :]
            return a[..., :-2] + 2 * a[..., 1:-1] + a[..., 2:]
        return a[..., :-2, 1:-1] + a[..., 2:, 1:-1] + a[..., 1:-1, :-2] + a[..., 1:-1, 2:] + 4 * a[..., 1:-1, 1:-1]

    for c, where in enumerate((red, ~(red | blue), blue)):
        out[..., c] = around(raw * where, c != 1) // np.maximum(around(where, c != 1), 1)
    return out


def tiles_of(rgb: np.ndarray, tile: int, border: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """(pixel_y, pixel_x, tile) of all whole tiles inside the border."""
    h, w = rgb.shape[:2]
    for y in range(border, border + max(0, (h - 2 * border) // tile) * tile, tile):
        for x in range(border, border + max(0, (w - 2 * border) // tile) * tile, tile):
            yield y, x, rgb[y : y + tile, x : x + tile]


def _cubic(n_in: int, n_out: int) -> np.ndarray:
    """Rows of bicubic weights (a = -0.5), widened for antialiasing when shrinking."""
    scale = max(1.0, n_in / n_out)
    at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    d = np.abs((np.arange(n_in)[None, :] - at[:, None]) / scale)
    k = np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
    return k / k.sum(1, keepdims=True)


def preprocess(rgb: np.ndarray, size: int = 224) -> np.ndarray:
    """float32 CHW of size x size: scaled to [0, 1], resized, normalised."""
    if rgb.ndim != 3 or rgb.shape[2] != 3:
        raise ValueError(f"expected H x W x 3, got {rgb.shape}")
    x = rgb.astype(np.float64) / 255
    x = np.einsum("ah,hwc,bw->abc", _cubic(x.shape[0], size), x, _cubic(x.shape[1], size))
    return ((x - MEAN) / STD).transpose(2, 0, 1).astype(np.float32)


def augment(rgb: np.ndarray, draw: int) -> np.ndarray:
    """Flips and a quarter turn, each by one bit of the draw."""
    if draw & 1:
        rgb = rgb[:, ::-1]
    if draw & 2:
        rgb = rgb[::-1]
    return np.rot90(rgb) if draw & 4 else rgb


def explode_tiles(scans: DataFrame, tile: int = 256, border: int = 0) -> DataFrame:
    """Scans (slide, fov_y, fov_x, h, w, raw) to tiles (slide, fov_y, fov_x, pixel_y, pixel_x, pixels): demosaic
    of the whole FOV, then cropping. Prune FOVs and marked tiles on keys before or after; pixels come last."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rgb = demosaic(np.frombuffer(r.raw, np.uint8).reshape(r.h, r.w))
                out = [(r.slide, r.fov_y, r.fov_x, y, x, t.tobytes()) for y, x, t in tiles_of(rgb, tile, border)]
                yield pd.DataFrame(out, columns=["slide", "fov_y", "fov_x", "pixel_y", "pixel_x", "pixels"])

    return scans.select("slide", "fov_y", "fov_x", "h", "w", "raw").mapInPandas(rows, "slide string, fov_y int, fov_x int, pixel_y int, pixel_x int, pixels binary")


def resize(rgb: np.ndarray, size: int) -> np.ndarray:
    """Bytes of size x size, bicubic with antialiasing."""
    x = np.einsum("ah,hwc,bw->abc", _cubic(rgb.shape[0], size), rgb.astype(np.float64), _cubic(rgb.shape[1], size))
    return np.clip(np.round(x), 0, 255).astype(np.uint8)


# Brightness, contrast, saturation (factors of 1 +- x) and hue (turns, +- x) of the two strengths.
JITTER = {"mild": (0.05, 0.05, 0.05, 0.02), "strong": (0.25, 0.2, 0.3, 0.09)}


def jitter(rgb: np.ndarray, draw: int, strength: str = "mild") -> np.ndarray:
    """Brightness, contrast and saturation scaled, and hue turned, by factors from the draw's bytes."""
    at = [((draw >> (8 * k)) & 255) / 127.5 - 1 for k in range(4)]
    b, c, s, h = (x * a for x, a in zip(JITTER[strength], at))
    grey = np.array([0.299, 0.587, 0.114])
    x = np.clip(rgb.astype(np.float64) * (1 + b), 0, 255)
    x = np.clip((x - (x @ grey).mean()) * (1 + c) + (x @ grey).mean(), 0, 255)
    x = np.clip((x - (x @ grey)[..., None]) * (1 + s) + (x @ grey)[..., None], 0, 255)
    if h:  # a turn about the grey axis
        cos, sin = np.cos(2 * np.pi * h), np.sin(2 * np.pi * h)
        turn = cos * np.eye(3) + (1 - cos) / 3 + sin / np.sqrt(3) * np.array([[0, -1, 1], [1, 0, -1], [-1, 1, 0]])
        x = np.clip(x @ turn.T, 0, 255)
    return np.round(x).astype(np.uint8)


def train_transform(rgb: np.ndarray, draw: int, size: int = 224, strength: str = "mild") -> np.ndarray:
    """Model input of a training patch: resized, flipped and turned, jittered, normalised, all by one draw."""
    return preprocess(jitter(augment(resize(rgb, size), draw), draw >> 3, strength), size)


def png(h: int, w: int, pixels: bytes) -> bytes:
    """A PNG file of RGB bytes."""
    rows = np.frombuffer(pixels, np.uint8).reshape(h, w * 3)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def contour(mask: np.ndarray) -> np.ndarray:
    """The marked pixels with an unmarked neighbour (or the image's edge) beside, above or below."""
    on = np.pad(mask > 0, 1)
    inner = on[1:-1, :-2] & on[1:-1, 2:] & on[:-2, 1:-1] & on[2:, 1:-1]
    return on[1:-1, 1:-1] & ~inner


def block_mean(rgb: np.ndarray, out: int) -> np.ndarray:
    """Area downsample to out x out."""
    h, w = rgb.shape[:2]
    ys, xs = (np.floor(np.arange(n) * out / n).astype(int) for n in (h, w))
    total = np.zeros((out, out, rgb.shape[2]))
    np.add.at(total, (ys[:, None], xs[None, :]), rgb)
    counts = np.bincount(ys, minlength=out)[:, None] * np.bincount(xs, minlength=out)[None, :]
    return total / np.maximum(counts, 1)[..., None]


@F.pandas_udf(BinaryType())
def bgr_to_rgb(data: pd.Series) -> pd.Series:
    return data.map(lambda b: np.frombuffer(b, np.uint8).reshape(-1, 3)[:, ::-1].tobytes())


def fit_mask(a: np.ndarray, h: int, w: int) -> bytes:
    """0/255 bytes of h*w of a mask array: first channel, padded or cropped with zeros; marked means above zero."""
    a = a[..., 0] if a.ndim == 3 else a
    out = np.zeros((h, w), np.uint8)
    part = a[:h, :w] > 0
    out[: part.shape[0], : part.shape[1]] = part * 255
    return out.tobytes()


def load_mask(h: int, w: int) -> Callable:
    """NPY bytes to mask bytes: see ``fit_mask``."""
    @F.pandas_udf(BinaryType())
    def load(content: pd.Series) -> pd.Series:
        return content.map(lambda b: fit_mask(np.load(io.BytesIO(b), allow_pickle=False), h, w))

    return load


def mask_of_image(h: int, w: int) -> Callable:
    """Decoded image columns (height, width, nChannels, data: BGR) to mask bytes; the first channel is red."""
    @F.pandas_udf(BinaryType())
    def load(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([fit_mask(np.frombuffer(d, np.uint8).reshape(y, x, c)[..., : min(c, 3)][..., ::-1], h, w) for y, x, c, d in zip(height, width, channels, data)])

    return load


def score_pixels(tiles: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int, batch: int = 64, size: int = 224) -> DataFrame:
    """tiles with ``score``: the model (on a batch of preprocessed tiles) in input order; the function is shipped
    once per worker."""
    @F.pandas_udf("float")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pixels in parts:
            out = []
            for k in range(0, len(pixels), batch):
                x = np.stack([preprocess(np.frombuffer(b, np.uint8).reshape(tile, tile, 3), size) for b in pixels.iloc[k : k + batch]])
                out.append(np.asarray(model(x), np.float32).reshape(-1))
            yield pd.Series(np.concatenate(out) if out else np.empty(0, np.float32))

    return tiles.withColumn("score", score("pixels"))


def logistic_scores(df: DataFrame, weights: list[float], bias: float, features: str = "embedding") -> DataFrame:
    """df with ``score`` of a logistic model through Arrow; the same numbers as ``functions.linear``."""
    w = np.array(weights, float)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-(np.stack(x.to_numpy()).astype(float) @ w + bias))) if len(x) else np.empty(0))

    return df.withColumn("score", score(features))


@lru_cache(maxsize=4)
def _weights(path: str) -> dict[str, np.ndarray]:
    from ..sources.scan import filesystem

    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        held = np.load(io.BytesIO(f.read()), allow_pickle=False)
        return {k.removeprefix("model."): held[k] for k in held.files}


class Checkpoint:
    """A stored classifier as a model for ``score_pixels``: an NPZ file with ``fc.weight`` and ``fc.bias`` of a logistic
    layer on the flattened input. Only the path is shipped; a worker loads the file once, when it first scores."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, x: np.ndarray) -> np.ndarray:
        held = _weights(self.path)
        z = x.reshape(len(x), -1).astype(np.float64) @ held["fc.weight"].reshape(-1) + float(held["fc.bias"].reshape(-1)[0])
        return 1 / (1 + np.exp(-z))


def infer(patches: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int, batch: int = 64, size: int = 224) -> DataFrame:
    """(label, score, and the other columns but the pixels) of labelled patches."""
    return score_pixels(patches, model, tile, batch, size).drop("pixels")
