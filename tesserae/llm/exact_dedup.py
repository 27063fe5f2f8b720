"""Exact deduplication as a stateful stream.

Documents arrive as a stream of files. For each content digest a RocksDB state store (on the executors'
disks, checkpointed to the shared folder, never expired) keeps the largest doc_id, the locator of that
content (file, by the hash of its path, and row) and the number of rows. When the stream has seen all
input, its state is read back; every row that hit a digest seen elsewhere is compared byte by byte with the
content that the locator names. Rows whose bytes differ (digests can collide) are regrouped by their whole
texts.

No digest's copies meet in one task: the few digests that hold more than a ten-thousandth of all rows are
joined by broadcast, and for the comparison the held content is repeated for every ``PER_KEY`` copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, scratch, sized

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a store else takes some 4 MB of disk before it holds anything, and there is one for each shuffle partition
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_PER_BATCH = 4096
#: Copies that are compared with one copy of the held content.
PER_KEY = 64
_NO_ID = -(1 << 63)


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _rows(df: DataFrame, digest) -> DataFrame:
    file, row = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), digest(F.col("text")).alias("digest"), file, row)


def _pattern(path: str) -> str:
    """path as a glob of itself: a stream takes a single file only so."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run_stream(spark: SparkSession, path: str, checkpoint: str, digest=text_digest, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Feeds the Parquet files at path that the stream with this checkpoint has not seen yet into its
    state, and returns that state: digest, keep_id, keep_file, keep_row, n. Call it again as files arrive."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        schema = spark.read.parquet(path).select("doc_id", "text").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_pattern(path))
        # numbers only, so that the aggregation hashes instead of sorting; both locators follow one order
        order = F.coalesce("doc_id", F.lit(_NO_ID))
        held = [F.max("doc_id"), F.max_by("file", order), F.max_by("row", order), F.count(F.lit(1))]
        state = _rows(stream, digest).groupBy("digest").agg(*(c.alias(f"c{k}") for k, c in enumerate(held)))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = spark.read.format("statestore").load(checkpoint)
    # the state holds the aggregates' buffers, by position
    value = F.col("value").cast("struct<keep_id: bigint, keep_file: bigint, o1: bigint, keep_row: bigint, o2: bigint, n: bigint>").alias("v")
    return held.select("key.digest", value).select("digest", "v.keep_id", "v.keep_file", "v.keep_row", "v.n")


def _is_kept() -> Column:
    return (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))


def exact_dedup(spark: SparkSession, path: str, digest=text_digest, checkpoint: str | None = None) -> DataFrame:
    """One row per row of the Parquet files at path (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the largest doc_id stays (null ids, and -2**63,
    come last, so that they stay only among themselves); of rows that repeat that id, one of them. An empty
    table gives an empty table; other columns are ignored.
    """
    held = materialize(run_stream(spark, path, checkpoint or scratch(spark, "dedup-state"), digest), "dedup-held")
    rows = _rows(spark.read.parquet(path), digest)
    keeper = ["keep_id", "keep_file", "keep_row", "n"]

    # hits: compare whole contents with the content that the locator names
    many = materialize(held.where("n > 1"), "dedup-many")
    hits = join_groups(rows, many, "digest", "n", 128).withColumn("salts", F.ceil(F.col("n") / PER_KEY).cast("int"))
    salt = F.pmod(F.xxhash64("file", "row"), F.col("salts")).cast("int")
    first = hits.where(_is_kept()).select("digest", F.col("text").alias("held_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    checked = hits.withColumn("salt", salt).join(first, ["digest", "salt"], "left")
    found = F.when(F.col("held_text").isNull(), F.raise_error(F.lit("a locator names no content"))).otherwise(F.col("text") == F.col("held_text"))
    sha = F.col("digest") if digest is text_digest else F.sha2(F.col("text").cast("binary"), 256)
    checked = materialize(checked.select("doc_id", "digest", "file", "row", *keeper, found.alias("equal"), sha.alias("sha")), "dedup-hits")
    clash = checked.where("NOT equal").select("digest").distinct()
    out = checked.drop("equal")
    if not clash.isEmpty():
        clash = sized(materialize(clash, "dedup-clash"), 80)
        torn = rows.join(clash, "digest", "left_semi")
        last = F.max(F.struct("doc_id", "file", "row")).alias("b")
        exact = torn.groupBy("digest", "text").agg(last, F.count(F.lit(1)).alias("n"))
        exact = exact.select("digest", "text", F.col("b.doc_id").alias("keep_id"), F.col("b.file").alias("keep_file"), F.col("b.row").alias("keep_row"), "n")
        out = out.join(clash, "digest", "left_anti").unionByName(torn.join(exact, ["digest", "text"]).withColumn("sha", sha).select(*out.columns))

    # a digest seen once is its own keeper, as the state has it
    once = held.where("n = 1")
    if digest is text_digest:
        single = once.withColumn("sha", F.col("digest")).withColumnsRenamed({"keep_id": "doc_id", "keep_file": "file", "keep_row": "row"})
        single = single.withColumns({"keep_id": F.col("doc_id"), "keep_file": F.col("file"), "keep_row": F.col("row")})
    else:
        single = rows.join(once.drop("digest"), _is_kept()).withColumn("sha", sha)
    both = single.select(*out.columns).unionByName(out)
    return both.select("doc_id", "keep_id", F.col("n").alias("group_size"), _is_kept().alias("kept"), F.col("sha").alias("text_sha256"))


SQL_DEDUP = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
