"""The training corpus pipeline: five stages, each over all that the one before kept.

All stages but the last return the columns of documents, whichever they are. A null text counts as an empty one, a null
doc_id or source is a value like any other, other columns may be named as they like, and an empty table gives an empty
table. What a stage makes of empty texts and repeated rows it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontamination, jaccard, mixing, token_store, toxicity
from tesserae.llm.common import materialize, table
from tesserae.llm.queries import tokenizer_path

#: No SQL: the first stage is a trained classifier, the last a tokenizer. tests/llm compares each stage with brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier (fitted on ``labels``) calls toxic. Empty texts have the score of a text
    without a known n-gram; repeated rows share their fate."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one row of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more:
    the one of the smallest doc_id (null last). SimHash tries find candidates, which are verified and completed. Texts
    without words are one group, texts of fewer words have their word sequence as the shingle; of repeated rows one stays."""
    return jaccard.similar_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain an item of ``benchmark``: 0.8 of its shingles. Texts without words stay, and
    repeated rows share their fate; an empty benchmark drops nothing."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With each document as often as the mix takes it (0, 1 or 2 times). Documents without words have no share and go;
    rows that repeat id and text have the mean of their shares."""
    return mixing.apply_mix(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the documents, as read back: doc_id, start, n_tokens, ids_crc32. An empty text is its end id
    alone; every row is a document of its own, null ids first."""
    return token_store.read_store(spark, token_store.write_store(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", one_of_each_group),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_store", store_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
