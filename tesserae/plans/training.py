"""Fitting and reporting of the built-in classifier: a logistic layer on feature arrays."""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterable

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scan import filesystem


def fit_logistic(rows: DataFrame, features: str = "embedding", label: str = "label", l2: float = 1e-4, steps: int = 100, balance: bool = False) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression on arrays; ``balance`` weighs the classes alike. Distributed over the
    rows: only gradients of one entry per feature reach the driver."""
    data = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"))
    if balance:
        n = {int(r["y"]): r["count"] for r in data.groupBy("y").count().collect()}
        share = sum(n.values()) / 2
        data = data.withColumn("w", F.when(F.col("y") == 1, F.lit(share / max(1, n.get(1, 0)))).otherwise(F.lit(share / max(1, n.get(0, 0)))))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=l2, maxIter=steps, standardization=False)
    model = model.setWeightCol("w") if balance else model
    fitted = model.fit(data)
    return fitted.coefficients.toArray(), float(fitted.intercept)


def save_checkpoint(path: str, weights: np.ndarray, bias: float) -> None:
    """The file that ``functions.image.Checkpoint`` loads."""
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    held = io.BytesIO()
    np.savez(held, **{"fc.weight": np.asarray(weights, float), "fc.bias": np.array([bias])})
    with fs.open_output_stream(at) as out:
        out.write(held.getvalue())


def learning_rate(step: int, steps: int, base: float, schedule: str = "cosine") -> float:
    """The rate at a step: constant, or half a cosine from base to 0."""
    if schedule == "constant":
        return base
    if schedule != "cosine":
        raise ValueError(f"unknown schedule {schedule!r}")
    return base * (1 + math.cos(math.pi * step / max(1, steps))) / 2


def metric_lines(frames: dict[str, DataFrame]) -> list[str]:
    """The metrics of an evaluation as lines to print, one per row of its small frames."""
    return [f"{name}: " + "  ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in r.asDict().items()) for name, df in frames.items() if name != "roc" for r in df.orderBy(*df.columns[:2]).collect()]


class RunLog:
    """A record of a run: one JSON file per entry below path, so that entries are whole and never overwritten."""

    def __init__(self, path: str) -> None:
        self.path = path

    def log(self, step: int, **metrics) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{step:09d}.json") as out:
            out.write(json.dumps({"step": step, **metrics}, sort_keys=True, default=str).encode())

    def entries(self, spark, names: Iterable[str]) -> DataFrame:
        """(step, and the metrics named) of all entries."""
        schema = "step long, " + ", ".join(f"`{n}` double" for n in names)
        return spark.read.schema(schema).json(self.path)
