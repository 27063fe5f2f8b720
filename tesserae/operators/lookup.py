"""Attaching scores to other tables by coordinate key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """One row per key: the value at the largest position. Partial aggregation keeps the shuffle to one row
    per key and task."""
    return df.groupBy(*keys).agg(F.max_by(value, pos).alias(value))


def attach(probe: DataFrame, build: DataFrame, keys: list[str], value: str, default: Column | None = None, name: str | None = None, pos: str = "pos") -> DataFrame:
    """probe with the last value of build under its key, or the default, and ``matched``. Rows are neither lost
    nor multiplied. The join's strategy is left to the optimizer: build sides grow with the data."""
    name = name or value
    lut = last_wins(build, keys, value, pos).select(*keys, F.col(value).alias("__value"), F.lit(True).alias("__hit"))
    default = F.lit(0.0).cast("float") if default is None else default
    out = probe.join(lut, keys, "left")
    filled = F.when(F.col("__hit"), F.col("__value").cast("float")).otherwise(default)
    return out.withColumn(name, filled).withColumn("matched", F.col("__hit").isNotNull()).drop("__value", "__hit")


def match_counts(attached: DataFrame, by: list[str]) -> DataFrame:
    return attached.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("matched")).alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))


def feature_files(bags: DataFrame, features: DataFrame, match: str = "exact") -> DataFrame:
    """(bag, feature) for file stems ``bag`` and ``feature``: a feature file is named after its bag's stem with or
    without underscores. match: ``exact``, ``prefix`` (anything may follow) or ``plain`` (prefix, first form only)."""
    bag, plain = F.concat(F.lit("features_"), F.col("bag")), F.concat(F.lit("features_"), F.replace(F.col("bag"), F.lit("_"), F.lit("")))
    if match == "exact":
        named = bags.select("bag", F.explode(F.array_distinct(F.array(bag, plain))).alias("feature"))
        return named.join(features, "feature").select("bag", "feature").distinct()
    forms = [bag] if match == "plain" else [bag, plain]
    named = bags.select("bag", F.explode(F.array_distinct(F.array(*forms))).alias("__prefix"))
    starts = F.transform(F.sequence(F.lit(1), F.length("feature")), lambda n: F.substring(F.col("feature"), F.lit(1), n))
    return named.join(features.select("feature", F.explode(starts).alias("__prefix")), "__prefix").select("bag", "feature").distinct()


def require_all(keys: DataFrame, known: DataFrame, key: str, what: str) -> None:
    """Raises with the sorted keys that are not known."""
    missing = [r[0] for r in keys.select(key).distinct().join(known, key, "left_anti").orderBy(key).limit(50).collect()]
    if missing:
        raise ValueError(f"no {what} for: {', '.join(map(str, missing))}")


def not_yet(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose output does not exist yet."""
    return df.join(done.select(*on), on, "left_anti")


def first_found(df: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """Of the places where a key is found, the most preferred."""
    return df.groupBy(key).agg(F.min_by(value, rank).alias(value))
