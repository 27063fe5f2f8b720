"""Mixing sources to target weights with equal-token blocks and Sainte-Lague apportionment.

1. A document's size is its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0).
2. Sources in code point order (null last) weigh ``weights`` in turn and share ``share`` of all sizes; a
   target stops at ``cap`` times its source's size and the excess is shared anew by weight.
3. The targets are apportioned in blocks of equal size: seats go to the highest quotients target/(2k+1).
4. Each source's documents lie in seeded shards; its blocks become integer quotas of its shards, again by
   highest quotients, of the shards' sizes.
5. A shard lists its documents in seeded order, end to end; its quota is a run of consecutive blocks on
   that circle from a seeded start. A run of more than one turn repeats documents, so that nothing is
   taken more than ``cap`` times.

Seats are computed in closed form near the divisor and only the last few are ranked, so no quotient or
block is ever listed. Sources are few or many, but only their sums meet in one task; documents never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: A block is the least target's thousandth, within these bounds (words).
BLOCK_PARTS, MAX_BLOCK = 1000, 16
#: Rows of a shard, all sources together, and the most shards.
SHARD_ROWS, MAX_SHARDS = 256, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(seed: int, *cols: Column) -> Column:
    """A 128-bit order key that other engines can compute too."""
    return F.md5(F.concat(*[F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(":")) for c in cols], F.lit(str(seed))))


def _number(key: Column, begin: int = 1) -> Column:
    return F.conv(F.substring(key, begin, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with weight and target.

    The level that all capped targets leave is found from the sources in order of cap/weight: the first
    whose cap lies above the level that the rest would get."""
    whole = Window.partitionBy(F.lit(1))
    at = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int"))
    top = F.col("source_size").cast("double") * cap
    order = whole.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = sources.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    out = out.withColumn("capped", F.coalesce(F.sum(top).over(before), F.lit(0.0)))
    out = out.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left_weight"))
    out = out.withColumn("level", F.min(F.when(top >= F.col("level") * F.col("weight"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("v")))).over(whole)["v"])
    target = F.when(F.col("level").isNull(), top).otherwise(F.least(top, F.col("level") * F.col("weight")))
    return out.withColumn("target", F.round(target, 6)).select("source", "source_size", "weight", "target")


def seats(df: DataFrame, votes: Column, n: Column, group: list[Column], tie: list[Column]) -> DataFrame:
    """df with ``seats``: Sainte-Lague apportionment of n seats (one number in each group) to its rows."""
    w = Window.partitionBy(*group)
    df = df.withColumn("__v", votes.cast("double")).withColumn("__n", n.cast("long"))
    df = df.withColumn("__sum", F.sum("__v").over(w)).withColumn("__m", F.count(F.lit(1)).over(w))
    sure = F.floor(F.col("__v") * (F.col("__n") - F.col("__m") / 2 - 1) / F.col("__sum") + F.lit(0.5))
    df = df.withColumn("__base", F.when(F.col("__sum") > 0, F.greatest(sure, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("__rest", F.col("__n") - F.sum("__base").over(w))
    near = F.when(F.col("__v") > 0, F.least(F.col("__n") - F.col("__base"), F.floor(F.col("__v") * (F.col("__m") + 4) / F.col("__sum")) + 3)).otherwise(F.lit(0).cast("long"))
    ranked = df.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(near, F.lit(0).cast("long")))))
    # k = 0 keeps the row itself; k >= 1 is its k-th further seat
    quotient = F.when(F.col("__k") > 0, F.col("__v") / (2 * (F.col("__base") + F.col("__k")) - 1))
    ranked = ranked.withColumn("__r", F.row_number().over(w.orderBy(quotient.desc_nulls_last(), *tie)))
    won = F.sum(F.when((F.col("__k") > 0) & (F.col("__r") <= F.col("__rest")), 1).otherwise(0))
    keep = [c for c in df.columns if not c.startswith("__")]
    return ranked.groupBy(*keep, "__base").agg(won.alias("__won")).select(*keep, (F.col("__base") + F.col("__won")).alias("seats"))


def mix(docs: DataFrame, seed: int = 42, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, text_hash, source, size, source_size, target, taken.

    Empty and null texts have size 0 and nothing of them is taken; a null source is a source like any
    other, the last. Rows that repeat an id are documents of their own. An empty table gives an empty
    table; other columns are ignored.
    """
    key = seeded(seed, F.col("doc_id"), F.length("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", n_words(F.col("text")).alias("size"), key.alias("key"))
    rows = materialize(rows, "mix-sizes")
    sums = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    facts = sums.agg(F.sum("n")).first()
    shards = max(1, min(MAX_SHARDS, -(-(facts[0] or 0) // SHARD_ROWS)))
    aim = targets(sums.drop("n"), weights, share, cap)
    whole = Window.partitionBy(F.lit(1))
    least = F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole), F.lit(1.0))
    aim = aim.withColumn("block", F.greatest(F.lit(1).cast("long"), F.least(F.lit(MAX_BLOCK).cast("long"), F.floor(least / BLOCK_PARTS))))
    aim = aim.withColumn("n", F.round(F.sum("target").over(whole) / F.col("block")).cast("long"))
    quota = seats(aim, F.col("target"), F.col("n"), [F.lit(1)], [F.col("source").asc_nulls_last()])
    quota = materialize(quota.withColumnRenamed("seats", "source_seats").drop("n"), "mix-quotas")

    rows = rows.withColumn("shard", _number(F.col("key")) % shards)
    cells = rows.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    few = sized(quota, 256)
    cells = cells.join(few.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    cells = seats(cells, F.col("cell_size"), F.col("source_seats"), [F.col("source")], [F.col("shard")])
    start = _number(F.md5(F.concat(F.coalesce(F.col("source"), F.lit("")), F.lit(":"), F.col("shard"), F.lit(f":{seed}"))))
    words = F.least(F.col("seats") * F.col("block"), F.col("cell_size") * cap)
    cells = cells.withColumn("words", words).withColumn("start", (start % F.greatest(F.lit(1), F.ceil(F.col("cell_size") / F.col("block")))) * F.col("block"))
    cells = materialize(cells.select(F.col("source").alias("__s"), F.col("shard").alias("__h"), "source_size", "target", "cell_size", "words", "start"), "mix-cells")

    placed = rows.withColumn("end", F.sum("size").over(Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)))
    out = placed.join(sized(cells, 256), F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__h")))
    turns = F.when(F.col("cell_size") > 0, F.floor(F.col("words") / F.col("cell_size"))).otherwise(F.lit(0).cast("long"))
    rest = F.col("words") - turns * F.col("cell_size")
    begin, end = F.col("end") - F.col("size"), F.col("end")
    zero = F.lit(0).cast("long")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(zero, F.least(end, high) - F.greatest(begin, low))

    over = overlap(F.col("start"), F.least(F.col("start") + rest, F.col("cell_size"))) + overlap(zero, F.col("start") + rest - F.col("cell_size"))
    taken = (turns * F.col("size") + over).cast("long")
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 42, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to cap times); all columns stay.

    What is taken of a document is a share of its words; it is rounded up or down by a seeded threshold of its own, so
    that copies are expected to equal that share, however long the document is. Documents without words, null texts
    among them, have no share and go. Rows that repeat both id and text get the mean of what is taken of them; a
    null id or source is one like any other. An empty table gives an empty table."""
    taken = mix(docs, seed, weights, share, cap)
    part = F.avg(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0))
    times = taken.groupBy(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__h"), F.col("source").alias("__s")).agg(part.alias("__t"))
    threshold = _number(seeded(seed + 1, F.col("__i"), F.col("__h"))) / float(1 << 32)
    times = materialize(times.select("__i", "__h", "__s", F.floor(F.col("__t") + threshold).cast("int").alias("__t")), "mix-times")
    match = docs["doc_id"].eqNullSafe(times["__i"]) & (F.xxhash64(docs["text"]) == times["__h"]) & docs["source"].eqNullSafe(times["__s"])
    out = docs.join(sized(times, 48), match)
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__t")))).select(*docs.columns)


SQL_MIX = """
WITH d AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(CAST(length(text) AS VARCHAR), '') || ':42') AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), lv AS (
  SELECT *, CAST(source_size AS DOUBLE) / weight AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
      - coalesce(CAST(sum(source_size * 2) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM s
), best AS (
  SELECT arg_min(level, (ratio, level)) FILTER (WHERE source_size * 2 >= level * weight) AS level FROM lv
), t AS (
  SELECT lv.source, lv.source_size, round(least(source_size * 2::DOUBLE, coalesce(best.level * weight, source_size * 2::DOUBLE)), 6) AS target
  FROM lv, best
), b AS (
  SELECT *, greatest(1, least(16, CAST(floor(coalesce(min(CASE WHEN target > 0 THEN target END) OVER (), 1) / 1000) AS BIGINT))) AS block FROM t
), n AS (
  SELECT *, CAST(round(sum(target) OVER () / block) AS BIGINT) AS n, count(*) OVER () AS m, sum(target) OVER () AS total FROM b
), q AS (
  SELECT *, CASE WHEN total > 0 THEN greatest(0, CAST(floor(target * (n - m / 2 - 1) / total + 0.5) AS BIGINT)) ELSE 0 END AS base FROM n
), qk AS (
  SELECT *, row_number() OVER (ORDER BY CASE WHEN k > 0 THEN target / (2 * (base + k) - 1) END DESC NULLS LAST, source ASC NULLS LAST) AS r,
         n - (SELECT sum(base) FROM q) AS rest
  FROM (SELECT *, unnest(range(0, CASE WHEN target > 0 THEN 2 * m + 10 ELSE 1 END)) AS k FROM q)
), qs AS (
  SELECT source, source_size, target, block, base + sum(CASE WHEN k > 0 AND r <= rest THEN 1 ELSE 0 END) AS seats
  FROM qk GROUP BY source, source_size, target, block, base
), h AS (
  SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % greatest(1, least(4096, (SELECT (count(*) + 255) // 256 FROM d))) AS shard FROM d
), c AS (
  SELECT h.source, shard, CAST(sum(size) AS BIGINT) AS cell_size, any_value(qs.seats) AS n, any_value(qs.block) AS block,
         any_value(source_size) AS source_size, any_value(target) AS target
  FROM h JOIN qs ON h.source IS NOT DISTINCT FROM qs.source GROUP BY h.source, shard
), cw AS (
  SELECT *, count(*) OVER (PARTITION BY source) AS m, CAST(sum(cell_size) OVER (PARTITION BY source) AS DOUBLE) AS total FROM c
), cq AS (
  SELECT *, CASE WHEN total > 0 THEN greatest(0, CAST(floor(cell_size::DOUBLE * (n - m / 2 - 1) / total + 0.5) AS BIGINT)) ELSE 0 END AS base FROM cw
), ck AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN k > 0 THEN cell_size::DOUBLE / (2 * (base + k) - 1) END DESC NULLS LAST, shard) AS r
  FROM (SELECT *, n - sum(base) OVER (PARTITION BY source) AS rest, unnest(range(0, CASE WHEN cell_size > 0 THEN 2 * m + 10 ELSE 1 END)) AS k FROM cq)
), cs AS (
  SELECT source, shard, cell_size, block, source_size, target,
         least((base + sum(CASE WHEN k > 0 AND r <= rest THEN 1 ELSE 0 END)) * block, cell_size * 2) AS words
  FROM ck GROUP BY source, shard, cell_size, block, source_size, target, base
), w AS (
  SELECT *, ('0x' || substr(md5(coalesce(source, '') || ':' || shard || ':42'), 1, 8))::BIGINT
            % greatest(1, CAST(ceil(cell_size::DOUBLE / block) AS BIGINT)) * block AS start,
         CASE WHEN cell_size > 0 THEN words // cell_size ELSE 0 END AS turns
  FROM cs
), p AS (
  SELECT h.doc_id, h.size, w.*, words - turns * cell_size AS rest2,
         sum(size) OVER (PARTITION BY h.source, h.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS fin
  FROM h JOIN w ON h.source IS NOT DISTINCT FROM w.source AND h.shard = w.shard
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(turns * size + greatest(0, least(fin, start + rest2, cell_size) - greatest(fin - size, start))
            + greatest(0, least(fin, start + rest2 - cell_size) - greatest(fin - size, 0)) AS BIGINT) AS taken
FROM p
"""
