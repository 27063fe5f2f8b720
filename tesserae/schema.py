"""Schemas and key columns."""

from __future__ import annotations

from pyspark.sql import types as T

FOV = ["fov_y", "fov_x"]
PIXEL = ["pixel_y", "pixel_x"]
TILE = [*FOV, *PIXEL]
KEY = ["slide", *TILE]


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I, _L, _D, _F, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.FloatType(), T.BinaryType()
ANNOTATIONS = _schema(("slide", _S), *[(c, _I) for c in ("fov_r", "fov_c", "patch_r", "patch_c", "top_left_px_x", "top_left_px_y", "label")])
PATCHES = _schema(("filepath", _S), ("label", _I))
DIAGNOSES = _schema(("patient_id", _S), ("slide", _S), ("label", _I))
SCANS = _schema(("slide", _S), ("fov_y", _I), ("fov_x", _I), ("h", _I), ("w", _I), ("raw", _B))
MASKS = _schema(("slide", _S), ("fov_y", _I), ("fov_x", _I), ("h", _I), ("w", _I), ("mask", _B))
TILES = _schema(("slide", _S), *[(c, _I) for c in TILE], ("pixels", _B))
SCORE_CSV = _schema(("FOV_y", _I), ("FOV_x", _I), ("pixel_y", _I), ("pixel_x", _I), ("score", _D))
SCORED = _schema(("split", _S), ("label", _I), ("score", _F))
EPOCHS = _schema(("epoch", _I), ("split", _S), ("loss", _D), ("auroc", _D), ("acc", _D), ("recall", _D))
