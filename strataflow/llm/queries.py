"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import infill, langid, license_scan, line_dedup, media, merge_tokens, minhash, mixing, packing, quality, token_counts, vector_codes, warc
from strataflow.llm.common import load


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(load(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(load(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated_pages(load(spark, sf_dir, "pages"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", license_scan.document_path().alias("path"))
    return license_scan.scan_licenses(docs, "doc_id", "path", "text").withColumnRenamed("id", "doc_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), token_counts.tokenizer_path("word_bpe_49k.json"))


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(load(spark, sf_dir, "documents"))


def op8_curriculum_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(load(spark, sf_dir, "documents"))


def op9_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with the proportions of the mixture's weights, as long as the sources last."""
    return packing.pack(load(spark, sf_dir, "documents"), token_counts.tokenizer_path("byte_bpe_50k.json"), weights=mixing.WEIGHTS)


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), maximal=True)
    return out.select("doc_id", "n_lines", "n_deleted", F.col("text").alias("kept_text"))


def op11_prefix_table_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_tokens.round_trips(load(spark, sf_dir, "documents"), token_counts.tokenizer_path("piece_bpe_32k.model"))


def op12_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed_vectors(load(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infilled_documents(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_divergence": op1_quality_divergence,
    "op2_media_columns": op2_media_columns,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_superminhash": op4_superminhash,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_cross_parsing": op7_cross_parsing,
    "op8_curriculum_mixture": op8_curriculum_mixture,
    "op9_deficit_packing": op9_deficit_packing,
    "op10_line_runs": op10_line_runs,
    "op11_prefix_table_tokens": op11_prefix_table_tokens,
    "op12_segment_mean_codes": op12_segment_mean_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op12_segment_mean_codes": vector_codes.oracle(),
    "op13_fill_in_middle": infill.ORACLE,
}
