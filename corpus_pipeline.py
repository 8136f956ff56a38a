"""The corpus pipeline: five stages from documents to token ids, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dossier.llm import tokens
from dossier.llm.decontaminate import decontaminate
from dossier.llm.minhash import keep_representatives
from dossier.llm.quality import keep_quality
from dossier.llm.secrets import redact
from dossier.sources.shared import only_last_table, remove, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many documents of their host share."""
    return keep_quality(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each class of texts that share 0.8 or more of their five-word shingles."""
    return keep_representatives(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark spans; those that hold half of an item or more go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    return redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their count, and the hashes of ids and decoded text."""
    return tokens.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup (+ minhash, jaccard)", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("bpe encoding", encode_stage),
]

#: SQL has neither classes of near texts at this size nor the vocabulary's merges; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage keeps is a Parquet table before the next one reads it.

    A stage's own tables are deleted once its result is stored, and that result once the next one is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with only_last_table(spark):
            docs = stored(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
