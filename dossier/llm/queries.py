"""The queries of the training-data operators; each covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import codebooks, decontaminate, html, kneser_ney, langid, negatives, quality, secrets, simhash, tokens, vector_dedup, warc
from dossier.llm.oracles import ORACLES  # noqa: F401

#: A document of more tokens is over the limit that op2 reports.
TOKEN_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "removed_lines", "depleted"]
    return quality.quality(docs).select("row.doc_id", *[f"report.{n}" for n in names])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html"))
    return found.select("row.page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = secrets.scan(docs)
    counts = [secrets.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("row.doc_id", *counts, _sha(secrets.listed(F.col("base"))).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    r = F.col("report")
    return found.select(
        "row.doc_id",
        r.n_words.alias("n_words"),
        r.n_hit.alias("n_hit"),
        r.n_items.alias("n_items"),
        _sha(F.array_join(r.item_ids, ",")).alias("items_sha256"),
        (r.n_hit > 0).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codebooks.compress(_table(spark, sf_dir, "embeddings"))
    rows = codebooks.with_label_error(found.rows)
    return rows.select("vec_id", codebooks.code_hex(F.col("code")).alias("code"), "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_token_counts,
        op3_html_text,
        op4_bpe_codec,
        op5_quality_classifier,
        op6_language_id,
        op7_simhash_dedup,
        op8_warc_archives,
        op9_secret_scan,
        op10_decontamination,
        op11_hard_negatives,
        op12_vector_codes,
        op13_vector_dedup,
    )
}
