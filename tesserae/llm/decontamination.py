"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased; words are runs of letters and digits; shingles are ``WIDTH`` words. An item of fewer
words has one shingle, its whole word sequence. An item is contained in a document if at least ``threshold``
of its distinct shingles occur in the document.

Items are partitioned by the width of their shingles and the number q of them (powers of two). A document
that contains an item lacks at most m = q - ceil(threshold * q) of its shingles. So of the item's bottom-k
MinHash sketch with k = m + r (q at most) at least k - m occur in the document, whatever its length: no match
is missed, and r grows by one for every ``PER_HIT`` shingles. Each partition has a hash bound, the largest
in its sketches, and a least number of shingles that a document needs to contain any of its items. Of a
document only hashes under the bounds of the partitions that it is large enough for are looked up, and an
item is a candidate only with as many hits as its sketch promises. Candidates are verified with the shingles
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized

WIDTH, THRESHOLD = 5, 0.8
#: A sketch promises one hit more for every so many shingles of its item.
PER_HIT = 8


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _each(name: str, width: int, join: str) -> Column:
    """join over each run of ``width`` words of the array column. The array is bound to a lambda variable:
    a merged projection would otherwise compute it again for every run."""
    run = ", ".join(f"element_at(w, i + {k})" for k in range(1, width + 1))
    made = f"xxhash64({run})" if join == "hash" else f"concat_ws(' ', {run})"
    kind = "bigint" if join == "hash" else "string"
    runs = f"CASE WHEN size(w) >= {width} THEN transform(sequence(0, size(w) - {width}), i -> {made}) ELSE CAST(array() AS array<{kind}>) END"
    return F.expr(f"element_at(transform(array({name}), w -> {runs}), 1)")


def _needed(threshold: float) -> Column:
    """Of q shingles, how many a document must have."""
    return F.ceil(F.round(F.col("q") * F.lit(float(threshold)), 9)).cast("int")


def sketches(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, list]:
    """(item rows: item, item_id, q, shingles; sketch rows: hash, item, part, need, hits; partitions).

    ``need``: the shingles that a document needs for the item; ``hits``: those of the sketch among them. A
    partition (width, part, need, bound) has the least need and the largest hash of its items; there are a
    few per width."""
    rows = items.select("item_id", F.xxhash64("text").alias("item"), words(F.col("text")).alias("ws"))
    rows = rows.withColumn("width", F.least(F.size("ws"), F.lit(width))).where("width > 0")

    def own(kind: str) -> Column:
        made = [F.when(F.col("width") == k, F.array_distinct(_each("ws", k, kind))) for k in range(1, width + 1)]
        return F.coalesce(*made)

    rows = rows.withColumn("shingles", own("text")).withColumn("q", F.size("shingles")).withColumn("need", _needed(threshold))
    lacking = F.col("q") - F.col("need")
    hashes = F.array_sort(own("hash"))
    k = F.least(F.col("q"), lacking + 1 + F.floor(F.col("q") / PER_HIT).cast("int"))
    rows = rows.withColumns({"part": F.ceil(F.log2("q")).cast("int"), "sketch": F.slice(hashes, F.lit(1), k), "hits": k - lacking})
    held = materialize(rows.select("item_id", "item", "q", "shingles", "width", "part", "need", "hits", "sketch"), "decon-items")
    flat = held.select("item", "width", "part", "need", "hits", F.explode("sketch").alias("hash")).distinct()
    parts = held.groupBy("width", "part").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("bound"))
    return held, materialize(flat, "decon-sketch"), parts.orderBy("width", "part").collect()


def _up_to(hashes: Column, bound: Column) -> Column:
    return F.filter(hashes, lambda h: h <= bound)


def probes(docs: DataFrame, parts: list) -> DataFrame:
    """(doc_id, text_hash, width, size, hash): the hashes of each document (doc_id, text) that some partition
    asks for; size: its shingles of that width."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))
    found = []
    for width in sorted({p["width"] for p in parts}):
        size = F.size("ws") - (width - 1)
        bounds = [F.when(size >= p["need"], F.lit(p["bound"])) for p in parts if p["width"] == width]
        bound = F.greatest(*bounds, F.lit(None).cast("long"))
        found.append(F.struct(F.lit(width).alias("width"), size.alias("size"), _up_to(_each("ws", width, "hash"), bound).alias("hs")))
    if not found:
        return rows.where(F.lit(False)).select("doc_id", "text_hash", F.lit(0).alias("width"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("hash"))
    if len(found) > 1:
        rows = rows.select("doc_id", "text_hash", F.explode(F.array(*found)).alias("a"))
    else:
        rows = rows.select("doc_id", "text_hash", found[0].alias("a"))
    return rows.select("doc_id", "text_hash", "a.width", "a.size", F.explode("a.hs").alias("hash"))


def candidates(docs: DataFrame, index: DataFrame, parts: list) -> DataFrame:
    """(doc_id, text_hash, item) of documents that hit the sketch of an item as often as it promises."""
    hits = probes(docs, parts).join(sized(index, 48), ["width", "hash"]).where("size >= need")
    hits = hits.select("doc_id", "text_hash", "item", "hits", "hash").distinct()
    return hits.groupBy("doc_id", "text_hash", "item").agg(F.count(F.lit(1)).alias("n"), F.first("hits").alias("hits")).where("n >= hits").drop("n", "hits")


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, n_item, n_shared, containment) of each item (item_id, text) and
    document (doc_id, text) that contains it.

    Items without words are never found, nor is anything in a document without words; null texts count as
    empty. Rows of one doc_id and text are one document; a null doc_id is an id like any other; of several
    texts of one item_id the best counts. Empty tables give an empty table; other columns are ignored.
    """
    held, index, parts = sketches(items, width, threshold)
    found = materialize(candidates(docs, index, parts), "decon-found")

    keys = found.select(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__h")).distinct()
    keys = sized(materialize(keys, "decon-docs"), 24)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    own = own.join(keys, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("text_hash") == F.col("__h")), "left_semi")
    # shingles of two widths differ in their blanks
    each = [F.array_distinct(_each("ws", k, "text")) for k in sorted({p["width"] for p in parts})] or [F.array().cast("array<string>")]
    own = own.withColumn("ws", words(F.col("text"))).select("doc_id", "text_hash", F.concat(*each).alias("has"))
    pairs = found.select(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__h"), "item")
    near = own.join(sized(pairs, 32), F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("text_hash") == F.col("__h")))
    exact = near.join(sized(held.select("item", "item_id", "q", "shingles"), 4096), "item")
    exact = exact.withColumn("n_shared", F.size(F.array_intersect("shingles", "has"))).where(F.col("n_shared") >= _needed(threshold))
    best = F.max(F.struct((F.col("n_shared") / F.col("q")).alias("c"), F.col("q").alias("q"), F.col("n_shared").alias("s")))
    out = exact.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "text_hash", "item_id", F.col("b.q").cast("long").alias("n_item"), F.col("b.s").cast("long").alias("n_shared"), F.col("b.c").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that contain an item, and all their repeats; all columns stay. Nulls, empty
    texts and empty tables are as in ``contained_items``: a document without words stays."""
    bad = contained_items(docs, items, width, threshold).select(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__h")).distinct()
    bad = sized(materialize(bad, "decon-bad"), 24)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__i"]) & (F.xxhash64(docs["text"]) == bad["__h"]), "left_anti")


SQL_CONTAINED = r"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, w, least(len(w), 5) AS v
  FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE w <> ['']
), ds AS (
  SELECT doc_id, v, list_distinct(list_transform(range(1, greatest(1, len(w) - v + 2)), lambda k: array_to_string(w[k:k+v-1], ' '))) AS s
  FROM d CROSS JOIN (SELECT DISTINCT v FROM i)
), sh AS (
  SELECT item_id, v, unnest(list_distinct(list_transform(range(1, len(w) - v + 2), lambda k: array_to_string(w[k:k+v-1], ' ')))) AS s FROM i
), q AS (SELECT item_id, count(*) AS n_item FROM sh GROUP BY item_id),
hit AS (
  SELECT doc_id, item_id, count(*) AS n_shared
  FROM (SELECT doc_id, v, unnest(s) AS s FROM ds) JOIN sh USING (v, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS BIGINT) AS n_shared, n_shared::DOUBLE / n_item AS containment
FROM hit JOIN q USING (item_id) WHERE n_shared >= ceil(round(n_item * 0.8, 9))
"""
