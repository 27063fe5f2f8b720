"""Reproducible splits and balanced batches. All draws are hashes of a key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeded_hash

FOLD_NAMES = ("train", "train", "train", "val", "test")


def slide_folds(slides: DataFrame, seed: int, pinned: list[str] = (), folds: tuple[str, ...] = FOLD_NAMES) -> DataFrame:
    """slides (slide, dx) with ``split``: dealt round within each diagnosis in seeded order; pinned slides train.
    The table has one row per slide."""
    order = Window.partitionBy("dx", F.col("slide").isin(list(pinned))).orderBy(seeded_hash(seed, F.col("slide")), "slide")
    fold = (F.row_number().over(order) - 1 + F.col("dx") + len(folds)) % len(folds)
    split = F.element_at(F.array(*map(F.lit, folds)), (fold + 1).cast("int"))
    return slides.withColumn("split", F.when(F.col("slide").isin(list(pinned)), "train").otherwise(split))


def random_split(df: DataFrame, key: str, seed: int, label: str = "label", train: float = 0.6, val: float = 0.2) -> DataFrame:
    """df with ``split``, stratified by label: the seeded order of each label is cut at exact shares.

    A label can hold most rows, so ranks are not taken in one window: rows fall into hash buckets, whose sizes
    give each bucket's first rank."""
    h = seeded_hash(seed, F.col(key))
    rows = df.withColumn("__h", h).withColumn("__bucket", F.shiftright("__h", 22).cast("int"))
    sizes = rows.groupBy(F.col(label).alias("__l"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("__l").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__first", F.coalesce(F.sum("__c").over(before), F.lit(0).cast("long"))).withColumn("__n", F.sum("__c").over(Window.partitionBy("__l"))).drop("__c")
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__bucket").orderBy("__h", key)))
    rows = rows.join(sizes, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__bucket") == F.col("__b")))
    rank = F.col("__first") + F.col("__r")
    split = F.when(rank <= F.round(F.col("__n") * train), "train").when(rank <= F.round(F.col("__n") * (train + val)), "val").otherwise("test")
    return rows.withColumn("split", split).select(*df.columns, "split")


def slide_split(patches: DataFrame, diagnoses: DataFrame, seed: int, pinned: list[str] = (), check: bool = True) -> DataFrame:
    """patches (slide, ...) with their slide's split; diagnoses (slide, dx). A slide without a diagnosis is an
    error, unless check is off, when its patches are left out."""
    from .lookup import require_all

    if check:
        require_all(patches, diagnoses, "slide", "diagnosis")
    slides = patches.select("slide").distinct().join(diagnoses, "slide")
    return patches.join(slide_folds(slides, seed, pinned).select("slide", "split"), "slide")


def numbered(df: DataFrame, h: Column, key: str, name: str) -> DataFrame:
    """df with consecutive numbers from 0 in the order of (h, key), h being a 32-bit hash: ranks are taken within
    1,024 ranges of the hash, and only the ranges' sizes meet in one task."""
    rows = df.withColumn("__h", h).withColumn("__bucket", F.shiftright("__h", 22).cast("int"))
    before = Window.partitionBy(F.lit(1)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    first = first.withColumn("__first", F.coalesce(F.sum("__c").over(before), F.lit(0).cast("long"))).drop("__c")
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("__h", key)) - 1
    # one row per range: at most 1,024
    out = rows.withColumn("__r", rank).join(F.broadcast(first), F.col("__bucket") == F.col("__b"))
    return out.select(*df.columns, (F.col("__first") + F.col("__r")).alias(name))


def balanced_batches(df: DataFrame, key: str, batch_size: int, seed: int, epoch: int = 0, mode: str = "undersample", label: str = "label") -> DataFrame:
    """(epoch, batch, slot, key, label): batches of half positives, half negatives.

    mode ``undersample``: each positive is an anchor once per epoch and negatives are drawn with replacement;
    ``oversample``: the other way round. Anchors that do not fill a half batch are left out of this epoch."""
    if batch_size % 2:
        raise ValueError("batch_size must be even")
    if mode not in ("undersample", "oversample"):
        raise ValueError(f"unknown mode {mode!r}")
    half, anchor = batch_size // 2, 1 if mode == "undersample" else 0
    ids = df.select(key, label)
    first, second = ids.where(F.col(label) == anchor), ids.where(F.col(label) == 1 - anchor)
    n, size = first.count(), second.count()
    anchors = numbered(first, seeded_hash(seed + epoch, F.col(key)), key, "at").where(F.col("at") < n // half * half if size else F.lit(False))
    pool = numbered(second, seeded_hash(seed, F.col(key)), key, "__at")
    slots = anchors.select("at").withColumn("__want", seeded_hash(seed, F.lit(epoch), F.col("at")) % max(1, size))
    drawn = slots.join(pool, F.col("__want") == F.col("__at")).select("at", key, label)
    batch, slot = F.floor(F.col("at") / half), (F.col("at") % half)
    both = anchors.select(key, label, batch.alias("batch"), slot.alias("slot")).unionByName(drawn.select(key, label, batch.alias("batch"), (slot + half).alias("slot")))
    return both.select(F.lit(epoch).alias("epoch"), "batch", F.col("slot").cast("int").alias("slot"), key, label)
