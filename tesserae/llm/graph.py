"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. large: every neighbour above u is linked to the least node around u;
    small: u and its neighbours below it are linked to the least of them."""
    if large:
        seen = edges.union(edges.select("b", "a"))
    else:
        seen = edges.select(F.greatest("a", "b"), F.least("a", "b"))
    seen = seen.toDF("u", "v")
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = seen.join(least, "u")
    if large:
        out = linked.where("v > u").select("v", "m")
    else:
        out = linked.select("v", "m").union(least.select("u", "m"))
    return out.toDF("a", "b").where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: bigint); root is the least node of its component.

    Alternates large-star and small-star steps until the edge set stands still; the number of rounds
    grows with the logarithm of the component sizes. A node with a huge neighbourhood is only ever
    aggregated (min) or joined, never collected. Self loops and nulls are ignored; an empty edge list
    gives an empty table.
    """
    edges = materialize(edges.toDF("a", "b").where("a != b").distinct(), "cc-edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        edges = materialize(_star(_star(edges, large=True), large=False), "cc-edges")
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
