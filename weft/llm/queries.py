"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import ann, decontaminate, language_id, license_scan, line_dedup, mixing, order_minhash, quality, token_counts, toxicity
from weft.sources.tables import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of a document that holds a benchmark item."""
    return decontaminate.matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line, and whether it stays."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest neighbours found of every hundredth vector."""
    return ann.neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The realised mixture: a row for each copy of a document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "block", "mix_order", "weight")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.fit_score(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", F.coalesce(toxicity.fold() == toxicity.HELD_OUT, F.lit(True)).alias("held_out"), "score", "predicted")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return order_minhash.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    found = language_id.identify(table(spark, sf_dir, "pages", "page_id", "url", "html"), table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select("page_id", "host", "declared", "lang", "posterior", "text_lang")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
    held_out = F.coalesce(quality.fold() == quality.HELD_OUT, F.lit(True)).alias("held_out")
    return scored.select("doc_id", held_out, "quality_score", "text_score", "metadata_score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after the masking of personal data."""
    counted = token_counts.counted(table(spark, sf_dir, "documents", "doc_id", "text"))
    return counted.select("doc_id", "n_tokens", "n_tokens_edited", "n_segments", "n_edits", "n_chars_reencoded")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence detections of every document."""
    scanned = license_scan.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_neighbours": op3_neighbours,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_order_minhash": op6_order_minhash,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_mix_sources": mixing.oracle(),
}
