"""Queries of the training-data operators, and the SQL that gives the same rows where there is such SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, mixing, secrets, simhash, token_counts, token_store, toxicity, url_filter, warc_zip
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct("containment", "n_item", "n_shared")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_store.read_store(spark, store)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op9_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_mix_sources, op2_benchmark_decontamination, op3_toxicity, op4_secret_scan, op5_url_filter, op6_token_counts, op7_token_store, op8_exact_dedup, op9_warc_packages, op10_simhash)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.SQL_MIX,
        "op2_benchmark_decontamination": decontamination.SQL_CONTAINED,
        "op5_url_filter": url_filter.SQL_URLS,
        "op8_exact_dedup": exact_dedup.SQL_DEDUP,
        "op9_warc_packages": warc_zip.SQL_WARC,
    }
